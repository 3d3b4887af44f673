"""Main texts of pages: against the generator's own structure, and on pages of hosts whose labels tell nothing."""

import html as references
import random
import re

import pytest
from pyspark.sql import functions as F

from engrama.llm import pages, queries

WORDS = "river stone cloud amber forest signal copper meadow winter lantern harbour violet engine paper saddle thunder".split()


def alone(page):
    reader = pages.Reader()
    none = frozenset()
    return pages.extract(*reader.read(page), none, none, none)


def truth(page):
    """What a page of the given tables holds between article tags."""
    found = re.search("<article>(.*?)</article>", page or "", re.S)
    parts = re.split("</?(?:p|h1)>", re.sub("</?b>|<br>", lambda m: " " if m[0] == "<br>" else "", found[1])) if found else []
    parts = [" ".join(references.unescape(p).split()) for p in parts]
    return "\n".join(p for p in parts if p)


def test_given_pages(spark):
    sf = "/root/testdata/sf0.01"
    want = sorted((r["page_id"], r["url"], truth(r["html"]), len(truth(r["html"]))) for r in spark.read.parquet(f"{sf}/pages.parquet").collect())
    assert sorted(tuple(r) for r in queries.op13_html_text(spark, sf).collect()) == want


@pytest.mark.parametrize(
    "page,text",
    [
        ("", ""),
        ("just text &amp; more", "just text & more"),
        ("<p>One<p>Two <i>three</i>four</p>", "One\nTwo threefour"),
        ("<div>a<br>b&nbsp; c</div><script>x<y</script><style>p{}</style>", "a b c"),
        ("<body><header>Site</header><nav><a href=/>Home</a></nav><main><h1>T</h1><p>Text of it.</main><footer>f</footer>", "T\nText of it."),
        ("<article><header><h1>T</h1></header><p>Body here.</p><aside>Pull</aside><section class='comments'><article class=comment><p>Nice one, I agree with all of it!</p></article></section></article>", "T\nBody here."),
        ("<body class='has-sidebar'><div id=content><p>Long enough text of the article.</p><form><label>Name</label><input><button>Go</button></form></div><div class='sidebar-left'><p>Side text</p></div><div class=cookie-notice>We use cookies</div></body>", "Long enough text of the article."),
        ("<article><ul><li>one<li>two<ul><li>in</ul></ul><table><tr><td>a<td>b<tr><td>c</table></article>", "one\ntwo\nin\na\nb\nc"),
        ("<article><p>shown</p><p hidden>not</p><div style='display:none'>nor this</div><!-- <p>no</p> --><p>end", "shown\nend"),
        ("<p title='a > b'>x</p><textarea><p>typed</p></textarea><svg><text>drawn</text></svg>", "x"),
        ("<title>t</title><article><b>bold<p>para</p></b> tail</article>", "bold\npara\ntail"),
        ("<article><p>Fünf &lt;b&gt; &#x263A; &eacute;", "Fünf <b> ☺ é"),
        ("<script>never closed <p>x</p>", ""),
    ],
)
def test_a_page_by_itself(page, text):
    assert alone(page) == text


def site(rng, i, labels, shuffled=False):
    """A page of a host whose classes are opaque; what is article text is returned beside it."""
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + f" {i}."
    title, paragraphs = say(5), [say(rng.randint(20, 40)) for _ in range(rng.randint(3, 7))]
    menu = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in rng.sample(WORDS, rng.randint(5, 9)))
    parts = [f"<div class={labels[0]}><ul>{menu}</ul></div>", f"<div class={labels[1]}><h2>{title}</h2>" + "".join(f"<p>{p}</p>" for p in paragraphs) + f"<div class={labels[2]}><p>Was this of use to you? Tell us.</p></div></div>", f"<div class={labels[3]}><span>Printed on green paper</span></div>"]
    if shuffled:
        rng.shuffle(parts)
    return "<html><head><title>x</title></head><body>" + "".join(parts) + "</body></html>", "\n".join([title, *paragraphs])


def test_template_of_a_host(spark):
    """Opaque classes: the menu, the saying under each article and the foot go by the template; a page of another layout is read by itself."""
    rng = random.Random(3)
    made = [(i, "https://A.example:80/p", *site(rng, i, ["k1", "k2", "k3", "k4"])) for i in range(40)]
    made += [(100, "https://a.example/odd", "<article><h1>Odd</h1><p>Another layout.</p></article>", "Odd\nAnother layout."), (101, None, "<p>No host", "No host"), (102, "https://a.example/none", None, "")]
    df = spark.createDataFrame([r[:3] for r in made], "page_id long, url string, html string")
    for limit in (1_000_000, 0):  # by broadcast and by shuffle
        got = {r["page_id"]: r["text"] for r in pages.main_text(df, limit).collect()}
        assert got == {r[0]: r[3] for r in made}
    template = pages.templates(df.withColumn("host", F.lit("a.example")).where("page_id < 100")).first()
    assert len(template["fixed"]) == 2 and set(template["main"]) < set(template["slots"])


def test_class_without_one_order_is_no_template(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([("h", site(rng, i, ["k1", "k2", "k3", "k4"], True)[0]) for i in range(40)], "host string, html string")
    ordered = spark.createDataFrame([("h", site(rng, i, ["k1", "k2", "k3", "k4"])[0]) for i in range(40)], "host string, html string")
    size = lambda rows: sum(len(r["slots"]) for r in rows)
    assert size(pages.templates(df).collect()) < size(pages.templates(ordered).collect())


def test_copies_and_near_copies_lose_nothing(spark):
    """Copies are not different pages, and paragraphs that many pages share are no template: their element has another vector."""
    rng = random.Random(5)
    page, text = site(rng, 1, ["k1", "article", "ad", "footer"])
    near = [page.replace("</h2>", f" {i}</h2>") for i in range(20)]
    rows = [(i, "http://c.example/", page) for i in range(20)] + [(100 + i, "http://n.example/", p) for i, p in enumerate(near)]
    got = {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == text for i in range(20))
    first, rest = text.split("\n", 1)
    assert all(got[100 + i].split("\n")[0] == f"{first} {i}" and got[100 + i].split("\n", 1)[1] == rest for i in range(20))


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "http://x.example/", "<article>a</article>", "old", 5), (1, "http://x.example/", "<article>a</article>", "old", 5)], "page_id long, url string, html string, Text string, host int")
    assert [(r["text"], r["host"]) for r in pages.main_text(df).collect()] == [("a", 5)] * 2
    assert pages.main_text(df.limit(0)).count() == 0
    long = "<div>" * 3000 + "deep" + "<p>x" * 20_000 + "<a " * 5000
    assert alone(long).startswith("deep\nx\nx")
