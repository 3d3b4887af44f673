"""Main texts of web pages, by equivalence classes of template tokens.

Tokens are elements, told apart by their path of tags, classes and ids, and texts at their path. A token's occurrence
vector is its number in each page of a host; it is kept as sums of hashes over pages, so tokens with equal vectors are found by
two aggregations whatever the size of a host. Tokens that share a vector on enough pages form a class; a class is valid if its
tokens come in one order, over and over, on the host's pages (paths nest by themselves). Valid classes nested in each other are the
host's template. A text in the class of the element that it stands in is said by every such element and goes. What its elements leave open are slots; the
host's slots are weighed together (labels, text, links), and what stands in the main ones is extracted from each page. A page of
a host without template, or one that has none of its main slots, is weighed by itself in the same way.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrama.llm.shared import if_small, materialise, without

#: Different pages that must share an element, or a text, before it counts as template, and one in how many pages of a host.
PAGES, SAYING, SHARE = 4, 8, 50
#: One in how many pages may have a class's tokens in another order.
DISORDER = 50
#: Share of text that a region must hold to be taken for its label alone, and that a child must hold to be gone down to.
LABELLED, DOMINANT = 0.3, 0.8
#: Share of linked text from which a part of an unlabelled region is a menu.
LINKED = 0.5

BOILER, ARTICLE, MAIN, CONTENT, BLOCK, LINK, HEADER, HOLDER = 1, 2, 4, 8, 16, 32, 64, 128

# Elements of HTML by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dd dt".split())
#: Those that hold blocks of other kinds, and so can be a page's main part.
HOLDERS = frozenset("html body div section main article center table tbody tr td".split())
#: What an element closes when it opens, and where the search for that ends.
CLOSES = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select", "datalist")), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",))}
IN_HEAD = frozenset("base link meta title script style noscript template".split())
#: Elements that never hold an article's text.
BOILER_TAGS = frozenset("head nav footer aside form noscript template object canvas audio video svg select button textarea label fieldset dialog menu search datalist script style".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
#: Words of classes and ids that name what is not the article.
BOILER_WORDS = frozenset(
    "nav navbar navigation menu menus submenu topbar toolbar masthead footer sidebar sidebars aside ad ads adv advert adverts advertisement advertising adsense banner banners "
    "sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup "
    "login signin search share sharing social comment comments commentlist respond reply replies disqus discussion related recommended recommendations breadcrumb breadcrumbs "
    "pagination pager widget widgets skip alert paywall outbrain taboola copyright form".split()
)
CONTENT_WORDS = frozenset("article content post entry story main body text".split())
#: First words of classes that tell how a page is laid out, not what a part is.
LAYOUT = frozenset("has with no without is not".split())

TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]+|\"[^\"]*\"|'[^']*')*)>?", re.S)
TELLING = re.compile(r"\b(?:class|id|role|hidden|style|itemprop)\b", re.I)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
LABEL_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
DIGITS = re.compile(r"\d+")
HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:@]+)"

#: Labels and paths that a worker remembers.
REMEMBERED = 1 << 16


def _label(tag: str, attributes: str) -> tuple[str, int]:
    """What tells an element apart beside its path, and its flags."""
    flags = BLOCK * (tag in BLOCKS) | LINK * (tag == "a") | BOILER * (tag in BOILER_TAGS) | ARTICLE * (tag == "article") | MAIN * (tag == "main") | HEADER * (tag == "header") | HOLDER * (tag in HOLDERS)
    if not attributes or not TELLING.search(attributes):
        return tag, flags
    has = {k.lower(): v[1:-1] if v[:1] in "\"'" and v else v for k, v in reversed(ATTRIBUTE.findall(attributes))}
    names, role = [*has.get("class", "").split(), has.get("id", "")], has.get("role", "").lower()
    words: set[str] = set()
    for name in names:
        own = LABEL_WORD.findall(name)
        if own and own[0].lower() not in LAYOUT:
            words |= {w.lower() for w in own}
    flags |= ARTICLE * (role == "article" or has.get("itemprop", "").lower() == "articlebody") | MAIN * (role == "main") | BOILER * (role in BOILER_ROLES)
    flags |= CONTENT * bool(words & CONTENT_WORDS)
    if tag not in ("html", "body", "main"):
        flags |= BOILER * bool(words & BOILER_WORDS or "hidden" in has or has.get("aria-hidden", "").lower() == "true" or HIDES.search(has.get("style", "")))
        flags |= HEADER * ("header" in words and not words & CONTENT_WORDS)
    return f"{tag}.{DIGITS.sub('0', ' '.join(names))}", flags


class Reader:
    """From html to elements (path, parent's place, flags) and texts (element's place, block, whether linked, text); remembers labels and paths."""

    def __init__(self):
        self.labels: dict[tuple[str, str], tuple[str, int]] = {}
        self.paths: dict[tuple[int, str], int] = {}

    def label(self, tag: str, attributes: str) -> tuple[str, int]:
        if tag == "a" or len(attributes) > 200:
            return _label(tag, attributes)
        got = self.labels.get((tag, attributes))
        if got is None:
            if len(self.labels) >= REMEMBERED:
                self.labels.clear()
            got = self.labels[tag, attributes] = _label(tag, attributes)
        return got

    def path(self, parent: int, label: str) -> int:
        got = self.paths.get((parent, label))
        if got is None:
            if len(self.paths) >= REMEMBERED:
                self.paths.clear()
            got = self.paths[parent, label] = signed(xxhash.xxh64_intdigest(label, seed=parent & (1 << 64) - 1))
        return got

    def read(self, page: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, bool, str]]]:
        elements, texts = [(0, -1, 0)], []
        stack, names = [0], ["#"]  # places of open elements, and their tags
        block, links, at = 0, 0, 0

        def close(depth: int) -> None:
            nonlocal block, links
            for i in range(len(stack) - 1, depth - 1, -1):
                flags = elements[stack[i]][2]
                block += bool(flags & BLOCK)
                links -= bool(flags & LINK)
            del stack[depth:], names[depth:]

        while at < len(page):
            m = TAG.search(page, at)
            start = m.start() if m else len(page)
            if start > at:
                raw = page[at:start]
                if not raw.isspace():
                    if names[-1] == "head":
                        close(len(stack) - 1)
                    texts.append((stack[-1], block, links > 0, references.unescape(raw) if "&" in raw else raw))
                elif texts:  # white space between inline elements parts words
                    texts.append((stack[-1], block, links > 0, " "))
            if m is None:
                break
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                if tag in ("html", "body") or tag not in names:
                    continue
                depth = len(names) - 1 - names[::-1].index(tag)
                if tag in BLOCKS or tag == "head" or not any(elements[stack[i]][2] & BLOCK for i in range(depth + 1, len(stack))):
                    close(depth)
                continue
            if names[-1] == "head" and tag not in IN_HEAD:
                close(len(stack) - 1)
            if tag in ("html", "body") and tag in names:
                continue
            if tag in ENDS_P:
                for i in range(len(stack) - 1, 0, -1):
                    if names[i] == "p":
                        close(i)
                        break
                    if elements[stack[i]][2] & BLOCK:
                        break
            if tag in CLOSES:
                ends, within = CLOSES[tag]
                cut = None
                for i in range(len(stack) - 1, 0, -1):
                    if names[i] in within:
                        break
                    if names[i] in ends:
                        cut = i
                        if tag != "tr" and not tag.startswith("t"):
                            break
                if cut is not None:
                    close(cut)
            if tag in VOID:
                if tag == "hr":
                    block += 1
                elif tag == "br":
                    texts.append((stack[-1], block, links > 0, " "))
                continue
            if tag in RAW:
                end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
                if end is None:
                    break
                close_at = page.find(">", end.end())
                at = len(page) if close_at < 0 else close_at + 1
                continue
            label, flags = self.label(tag, m[3])
            parent = stack[-1]
            block += bool(flags & BLOCK)
            links += bool(flags & LINK)
            stack.append(len(elements))
            names.append(tag)
            elements.append((self.path(elements[parent][0], label), parent, flags))
            if m[3].endswith("/") and tag in ("svg", "path"):
                close(len(stack) - 1)
        return elements, texts


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def token_of(path: int, text: str) -> int:
    """The token of a text at a path; white space does not matter."""
    return signed(xxhash.xxh64_intdigest(" ".join(text.split()), seed=path & (1 << 64) - 1))


def main_slots(nodes: dict[int, tuple[int, int, float, float]]) -> set[int]:
    """The nodes whose text is the article's. nodes: path -> parent (or one that is no node), flags, characters of plain and of linked text; parents come first."""
    boiler, inside, below, linked = {}, {}, {}, {}
    for path, (parent, flags, _, _) in nodes.items():
        above = inside.get(parent, 0)
        inside[path] = above | flags
        boiler[path] = boiler.get(parent, False) or bool(flags & BOILER) or bool(flags & HEADER and not above & (ARTICLE | MAIN))
    for path, (parent, _, plain, links) in reversed(nodes.items()):
        if not boiler[path]:
            below[path] = below.get(path, 0) + plain + links
            linked[path] = linked.get(path, 0) + links
            if parent in nodes:
                below[parent] = below.get(parent, 0) + below[path]
                linked[parent] = linked.get(parent, 0) + linked[path]
    total = sum(plain + links for path, (_, _, plain, links) in nodes.items() if not boiler[path])
    clear = [p for p in nodes if not boiler[p]]

    def outermost(flag: int, among) -> list[int]:
        return [p for p in among if nodes[p][1] & flag and not inside.get(nodes[p][0], 0) & flag]

    def held(roots) -> float:
        return sum(below[p] for p in roots)

    articles = outermost(ARTICLE, clear)
    in_main = [p for p in articles if inside[p] & MAIN]
    for roots, strict in ((in_main, False), (articles, False), (outermost(MAIN, clear), True), (outermost(CONTENT, clear), True)):
        if roots and held(roots) >= LABELLED * total and (held(roots) > 0 or total == 0):
            break
    else:
        children: dict[int, list[int]] = {}
        for p in clear:
            children.setdefault(nodes[p][0], []).append(p)
        roots, strict = [p for p in clear if nodes[p][0] not in nodes], True
        while len(roots) == 1 and (best := max(children.get(roots[0], []), key=lambda p: below[p], default=None)) is not None and below[best] >= DOMINANT * below[roots[0]] and nodes[best][1] & HOLDER:
            roots = [best]
    main: set[int] = set(roots)
    for p in clear:
        parent, flags = nodes[p][:2]
        if parent in main and p not in main:
            menu = strict and flags & BLOCK and linked[p] > LINKED * below[p] > 0
            if not menu:
                main.add(p)
    return main


def weighed(elements: list, texts: list) -> dict[int, tuple[int, int, float, float]]:
    """Nodes of one page for main_slots()."""
    nodes = {}
    for path, parent, flags in elements:
        nodes.setdefault(path, [elements[parent][0] if parent >= 0 else None, flags, 0, 0])
    for e, _, link, text in texts:
        nodes[elements[e][0]][3 if link else 2] += len(text.strip())
    return {p: tuple(v) for p, v in nodes.items()}


def extract(elements: list, texts: list, slots: frozenset[int], main: frozenset[int], fixed: frozenset[int]) -> str:
    """The blocks of a page's main slots, one per line. slots: the template's elements; main: those that hold the article; fixed: texts that belong to the template."""
    if not any(e[0] in main for e in elements):
        slots = main = main_slots(weighed(elements, texts))
        slots = frozenset(e[0] for e in elements)
    keep: list[bool] = []
    above: list[int] = []
    for path, parent, flags in elements:
        over = above[parent] if parent >= 0 else 0
        above.append(over | flags)
        if path in slots:
            keep.append(path in main)
        else:
            keep.append(parent >= 0 and keep[parent] and not flags & BOILER and not (flags & HEADER and not over & (ARTICLE | MAIN)))
    blocks: dict[int, list[str]] = {}
    for e, block, _, text in texts:
        if keep[e] and not (fixed and token_of(elements[e][0], text) in fixed):
            blocks.setdefault(block, []).append(text)
    joined = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(b for b in joined if b)


TOKENS = "host string, digest long, seq array<long>, tokens array<struct<token:bigint,parent:bigint,flags:int,n:bigint,at:bigint,plain:bigint,linked:bigint>>"
#: Kind of a token that is a text; elements have their flags.
TEXT = -1


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = Reader()
    kind = pa.list_(pa.struct([("token", pa.int64()), ("parent", pa.int64()), ("flags", pa.int32()), ("n", pa.int64()), ("at", pa.int64()), ("plain", pa.int64()), ("linked", pa.int64())]))
    for b in batches:
        digests, seqs, lists = [], [], []
        for i in range(b.num_rows):
            page = b.column(1)[i].as_py() or ""
            elements, texts = reader.read(page)
            seq, mine = [], {}
            of: dict[int, list[tuple[int, bool, str]]] = {}
            for e, _, link, text in texts:
                if text != " ":
                    of.setdefault(e, []).append((0, link, text))
            for place, (path, parent, flags) in enumerate(elements):
                seq.append(path)
                row = mine.setdefault(path, [elements[max(parent, 0)][0], flags, 0, len(seq), 0, 0])
                row[2] += 1
                for _, link, text in of.get(place, ()):
                    n = len(text.strip())
                    row[5 if link else 4] += n
                    token = token_of(path, text)
                    seq.append(token)
                    said = mine.setdefault(token, [path, TEXT, 0, len(seq), n, 0])
                    said[2] += 1
            digests.append(signed(xxhash.xxh64_intdigest(page)))
            seqs.append(seq)
            lists.append([{"token": t, "parent": r[0], "flags": r[1], "n": r[2], "at": r[3], "plain": r[4], "linked": r[5]} for t, r in mine.items()])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.int64()), pa.array(seqs, pa.list_(pa.int64())), pa.array(lists, kind)], ["host", "digest", "seq", "tokens"])


def _templates(pdf: pd.DataFrame) -> pd.DataFrame:
    """One host's template from its frequent tokens and their classes."""
    rows = pdf.sort_values(["at", "token"])
    known = {r.token: r for r in rows.itertuples(index=False)}
    element = [r for r in rows.itertuples(index=False) if r.flags != TEXT]
    order, seen = [], set()
    by_parent: dict[int, list] = {}
    for r in element:
        by_parent.setdefault(r.parent, []).append(r)
    queue = [r for r in element if r.parent == r.token or r.parent not in known]  # a page's root is its own parent
    while queue:  # parents first
        r = queue.pop(0)
        if r.token not in seen:
            seen.add(r.token)
            order.append(r)
            queue += by_parent.get(r.token, [])
    nearest: dict[int, int | None] = {}
    weights: dict[int, list] = {}
    for r in order:
        over = nearest.get(r.parent) if r.parent != r.token else None
        if r.in_template:
            weights[r.token] = [over, r.flags, r.plain, r.linked]
            nearest[r.token] = r.token
        else:
            nearest[r.token] = None if r.flags & BOILER else over
            if nearest[r.token] is not None:
                weights[over][2] += r.plain
                weights[over][3] += r.linked
    fixed = [r.token for r in rows.itertuples(index=False) if r.flags == TEXT and r.in_template]
    for r in rows.itertuples(index=False):  # what every page says weighs nothing
        if r.flags == TEXT and r.in_template and (at := nearest.get(r.parent)) is not None:
            weights[at][2] = max(0, weights[at][2] - r.plain)
    main = main_slots({t: tuple(w) for t, w in weights.items()}) if weights else set()
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "slots": [list(weights)], "main": [sorted(main)], "fixed": [fixed]})


def templates(pages: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """(host, slots, main, fixed): the template of each host of pages (host, html): its elements, those of them that hold the article, and texts that it says itself. Hosts without one have no row."""
    read = materialise(pages.where("host <> ''").select("host", "html").mapInArrow(_tokens, TOKENS), "page-tokens")
    each = read.select("host", "digest", F.explode("tokens").alias("t")).select("host", "digest", "t.*")
    part = lambda seed: F.sum(F.pmod(F.xxhash64("digest", "n", F.lit(seed)), F.lit((1 << 31) - 1)))
    vectors = each.groupBy("host", "token").agg(
        F.min("parent").alias("parent"), F.min("flags").alias("flags"), F.count("*").alias("pages"), F.sum("n").alias("n"), part(1).alias("v1"), part(2).alias("v2"),
        F.bit_or(F.expr("shiftleft(1L, CAST(pmod(digest, 63) AS INT))")).alias("seen"), F.avg("at").alias("at"), F.sum("plain").alias("plain"), F.sum("linked").alias("linked"),
    )
    sizes = read.groupBy("host").agg(F.count("*").alias("of"))
    often = vectors.where(F.bit_count("seen") >= PAGES).join(sizes, "host").where(F.col("pages") * SHARE >= F.col("of"))
    often = materialise(often, "page-vectors")
    vector = ["host", "pages", "n", "v1", "v2"]
    is_text = F.col("flags") == TEXT
    around = often.where(~is_text).select(*vector, F.col("token").alias("parent"))
    said = often.where(is_text & (F.bit_count("seen") >= SAYING)).join(around, [*vector, "parent"], "left_semi")
    often = materialise(often.where(~is_text).unionByName(said.select(*often.columns)), "page-candidates")
    grouped = often.groupBy(*vector, is_text.alias("said")).agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("c")).select(*vector, F.transform("c", lambda x: x["token"]).alias("tokens"))
    # elements and texts of a vector are one class, but are ordered apart: a menu that is shuffled does not unmake the layout
    sized = often.groupBy(*vector).agg(F.count("*").alias("members")).where("members >= 2").drop("members")
    classes = materialise(grouped.join(sized, vector, "left_semi").select("host", "tokens", "pages"), "page-classes")
    lists = classes.groupBy("host").agg(F.collect_list(F.struct("tokens", "pages")).alias("classes"))
    lists = if_small(materialise(lists, "page-class-lists"), limit, "classes")

    def disordered(c):
        mine = F.filter("seq", lambda x: F.array_contains(c["tokens"], x))
        return mine != F.flatten(F.array_repeat(c["tokens"], F.floor(F.size(mine) / F.size(c["tokens"])).cast("int")))

    wrong = read.join(lists, "host").select("host", F.explode(F.filter("classes", disordered)).alias("c"))
    wrong = wrong.groupBy("host", F.col("c.tokens").alias("tokens"), F.col("c.pages").alias("pages")).agg(F.count("*").alias("wrong")).where(F.col("wrong") * DISORDER > F.col("pages"))
    valid = classes.join(wrong, ["host", "tokens", "pages"], "left_anti").select("host", F.explode("tokens").alias("token")).distinct().withColumn("in_template", F.lit(True))
    rows = often.join(valid, ["host", "token"], "left").select("host", "token", "parent", "flags", "at", F.col("plain").cast("double").alias("plain"), F.col("linked").cast("double").alias("linked"), F.coalesce("in_template", F.lit(False)).alias("in_template"))
    out = rows.groupBy("host").applyInPandas(_templates, "host string, slots array<long>, main array<long>, fixed array<long>")
    return out.where(F.size("slots") > 0)


def main_text(pages: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """Adds text, a page's main text, to each row of pages (url, html); the html is not returned.

    Blocks (paragraphs, headings, list items, table cells and the like) stand on a line each, with character references decoded and white
    space made one space. Null and empty html, and pages without a main text, give an empty one. A page whose url names no host is read by itself, as
    is one of a host with fewer than PAGES different pages. Repeated rows are all returned, an empty table gives
    none, and a column named text is replaced. Templates of up to `limit` hosts are broadcast, more are joined by shuffle.
    """
    rest = without(pages, "text", "html")
    packed = pages.select(F.struct(*[rest[c] for c in rest.columns]).alias("row"), F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)).alias("host"), F.col("html"))
    found = if_small(materialise(templates(packed.select("host", "html"), limit), "page-templates"), limit, "slots", "main", "fixed")
    both = packed.join(found, "host", "left").select("row", "html", "slots", "main", "fixed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, none = Reader(), frozenset()
        known: dict[tuple, tuple] = {}
        for b in batches:
            texts = []
            for i in range(b.num_rows):
                lists = [b.column(c)[i].as_py() for c in (2, 3, 4)]
                key = tuple(map(tuple, lists)) if lists[0] else ()
                if key not in known:
                    if len(known) >= 1024:
                        known.clear()
                    known[key] = tuple(map(frozenset, key)) or (none, none, none)
                texts.append(extract(*reader.read(b.column(1)[i].as_py() or ""), *known[key]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["row", "text"])

    return both.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, text string").select("row.*", "text")
