"""Brute-force versions of the operators, on literal rows and on the smallest tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from engrama.llm import decontaminate, licenses, line_dedup, pieces, pii, quality, reshard, shared, simhash, tokens, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOREM = "the quick brown fox jumps over the lazy dog while seven tall trees sway in a soft wind and rivers run slowly to the distant sea below"
ODD = [None, "", " \n\t", "one", "a b c d e f g h " * 3, LOREM, LOREM, LOREM.upper(), "É é ß 日本 " * 40, "x" * 50_000, "\n".join([LOREM] * 5), LOREM + " twice\n" + LOREM]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(ODD)] + [(3, "one", "en", "s", 3), (None, LOREM, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def by_id(df, *cols):
    return sorted(((r["doc_id"], *(r[c] for c in cols)) for r in df.collect()), key=repr)


def both(request, docs, table):
    return [docs, table]


# quality


def brute_features(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_features(docs, table):
    for df in (docs, table):
        got = by_id(quality.quality(df), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        want = []
        for i, t in pairs(df):
            f = brute_features(t)
            want.append((i, *f, f[0] < 20 or 100 * f[4] > 30 * f[0]))
        assert got == sorted(want, key=repr)


def test_quality_model_finds_junk(table, spark):
    out = quality.quality(table).join(spark.read.parquet("/root/testdata/sf0.001/labels.parquet"), "doc_id")
    junk = out.where("quality = 0")
    good = out.where("quality = 1 AND NOT base_failed")
    assert junk.where("kept").count() <= 0.1 * junk.count()
    assert good.where("kept").count() >= 0.95 * good.count()


def brute_em(votes):
    """Posterior of each text by an EM over the texts themselves: -1, 0 and 1 as three outcomes, one pseudo-count for each that occurs."""
    x = np.array(votes)
    p = np.where((x == -1).any(axis=1), 0.1, 0.9)
    for _ in range(500):
        logit = np.log((p.sum() + 1) / ((1 - p).sum() + 1)) * np.ones(len(x))
        for column in x.T:
            kinds = [v for v in (-1, 0, 1) if (column == v).any()]
            for v in kinds:
                here = column == v
                logit += here * np.log((p[here].sum() + 1) / (p.sum() + len(kinds)) / (((1 - p)[here].sum() + 1) / ((1 - p).sum() + len(kinds))))
        before, p = p, 1 / (1 + np.exp(-logit))
        if abs(p - before).max() < 1e-9:
            break
    return p


def test_quality_posterior(table):
    rows = quality.quality(table).select("p_good", "kept", "base_failed", *(f"vote_{r}" for r in quality.RULES)).collect()
    want = brute_em([r[3:] for r in rows])
    assert [r["p_good"] for r in rows] == pytest.approx(want.tolist(), abs=1e-6)
    assert all(r["kept"] == (not r["base_failed"] and p >= 0.5) for r, p in zip(rows, want, strict=True) if abs(p - 0.5) > 1e-6)


@pytest.mark.parametrize("share", [0.3, 0.8])
def test_quality_em_finds_what_was_simulated(share):
    rng, n, right = np.random.default_rng(0), 200_000, (0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.5)
    good = rng.random(n) < share
    votes = np.stack([np.where(rng.random(n) < 0.3, 0, np.where((rng.random(n) < r) == good, 1, -1)) for r in right], axis=1)
    model = quality.fit(sorted(Counter(map(tuple, votes.tolist())).items()), tuple("abcdefgh"))
    assert abs(model.prior - share) < 0.02
    for rule, r in zip("abcdefgh", right, strict=True):
        assert model.weights[rule][1] == pytest.approx(math.log(r / (1 - r)), abs=0.1)
        assert model.weights[rule][-1] == pytest.approx(-math.log(r / (1 - r)), abs=0.1)
        assert abs(model.weights[rule][0]) < 0.1


def test_quality_em():
    assert quality.fit([]).weights["symbols"] == {-1: 0.0, 0: 0.0, 1: 0.0}
    model = quality.fit([((1, 1, 1), 900), ((-1, -1, 0), 60), ((-1, 0, -1), 40)], ("a", "b", "c"))
    assert all(w[-1] < 0 < w[1] for w in model.weights.values()) and 0.8 < model.prior < 0.95


def test_quality_empty_and_clashing(spark, docs):
    assert quality.quality(docs.where("false")).count() == 0
    out = quality.quality(docs.withColumn("kept", F.lit("x")).withColumn("N_Words", F.lit(1)))
    assert dict(out.dtypes)["kept"] == "boolean" and out.count() == docs.count()
    assert quality.keep_good(docs).columns == docs.columns
    odd = docs.withColumn("_d", F.lit(1)).withColumn("_T", F.lit("t")).withColumn("digest", F.lit(2)).withColumn("kept", F.lit(None).cast("int"))
    got = quality.keep_good(odd)
    assert got.columns == odd.columns and sorted(pairs(got), key=repr) == sorted(pairs(quality.keep_good(docs)), key=repr)
    assert quality.keep_good(docs.where("false")).count() == 0 and None not in [t for _, t in pairs(got)]


# decontamination


def brute_hits(text, items, size=10):
    words = ALNUM.findall((text or "").translate(FOLD))
    hit, found = set(), set()
    for i, item in items:
        w = ALNUM.findall((item or "").translate(FOLD))
        n = min(size, len(w))
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for k in range(len(words) - n + 1):
            if tuple(words[k : k + n]) in grams:
                hit |= set(range(k, k + n))
                found |= {str(i)} if i is not None else set()
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_contamination(spark, docs, limit):
    items = [(1, LOREM), (2, "Fox jumps"), (10, "É é"), (3, None), (4, "!!"), (5, "nowhere to be found at all here"), (None, "lazy dog"), (1, LOREM)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench, broadcast_windows=limit)
    cols = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert by_id(got, *cols) == sorted(((i, *brute_hits(t, items)) for i, t in pairs(docs)), key=repr)
    assert decontaminate.contamination(docs, bench.where("false")).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.where("false"), bench).count() == 0


def test_decontaminate(spark, docs):
    bench = spark.createDataFrame([(1, "brown fox jumps over the lazy dog while seven tall")], "item_id long, text string")
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(pairs(clean), key=repr) == sorted(((i, t) for i, t in pairs(docs) if not brute_hits(t, [(1, bench.first()["text"])])[4]), key=repr)
    cut = dict(pairs(decontaminate.decontaminate(docs, bench, "spans", broadcast_rows=0)))
    assert cut[5].split() == [w for i, w in enumerate(LOREM.split()) if not 2 <= i < 12] and cut[3] == "one" and len(cut[9]) == 50_000


@pytest.mark.parametrize("action", ["documents", "spans"])
def test_decontaminate_keeps_other_columns(spark, docs, action):
    bench = spark.createDataFrame([(1, "brown fox jumps over the lazy dog while seven tall")], "item_id long, text string")
    odd = docs.withColumns({c: F.lit(c) for c in ("_t", "_d", "hits", "digest", "_row", "_w", "items", "Contaminated")})
    plain, got = (decontaminate.decontaminate(x, bench, action, broadcast_rows=n) for x, n in ((docs, 10**6), (odd, 0)))
    assert got.columns == odd.columns and sorted(pairs(got), key=repr) == sorted(pairs(plain), key=repr)
    assert got.where("hits = 'hits' AND digest = 'digest'").count() == got.count() > 0
    assert decontaminate.decontaminate(docs.where("false"), bench, action).count() == 0
    assert sorted(pairs(decontaminate.decontaminate(docs, bench.where("false"), action)), key=repr) == sorted(pairs(docs), key=repr)
    assert all(r["n_chars"] == len(r["text"] or "") for r in plain.where("n_chars IS NOT NULL").collect())


def test_personal_data_replaces_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a@b.cd", "x"), (2, None, "y"), (2, None, "y")], "doc_id long, text string, N_Email string")
    assert sorted((r["doc_id"], r["n_email"], r["spans"]) for r in pii.personal_data(df).collect()) == [(1, 1, "email:0:6"), (2, 0, ""), (2, 0, "")]


# simhash


def brute_print(text):
    words = WORD.findall((text or "").translate(FOLD))
    if not words:
        return 0
    n = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    label = list(range(len(prints)))
    near = [[j for j in range(len(prints)) if (prints[i] ^ prints[j]).bit_count() <= 4] for i in range(len(prints))]
    while (new := [min(label[j] for j in n) for n in near]) != label:
        label = new
    return label


@pytest.mark.parametrize("agree", [2, 3, 4])
def test_blocks_miss_no_pair(spark, agree):
    """Every two fingerprints at most four bits apart are linked, directly or through others, whichever blocks agree."""
    rng = np.random.default_rng(agree)
    centre = rng.integers(0, 2**63, size=20, dtype=np.uint64)
    fps = sorted({int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for c in rng.choice(centre, 300)})
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    got = simhash.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), agree=agree))
    root = {f: f for f in signed} | {r["fp"]: r["root"] for r in got.collect()}
    label = brute_components(fps)
    groups = lambda names: sorted(sorted(k for k in range(len(fps)) if names[k] == n) for n in set(names))
    assert groups([root[f] for f in signed]) == groups(label)


@pytest.mark.parametrize("limit,hot", [(8192, 1 << 16), (2, 1)])
def test_near_duplicates(docs, table, limit, hot):
    for df in (docs.where("doc_id IS NOT NULL"), table):
        rows = sorted(pairs(df))
        label = brute_components([brute_print(t) for _, t in rows])
        want = sorted((i, brute_print(t), rows[k][0]) for (i, t), k in zip(rows, label, strict=True))
        got = sorted((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(df, limit, hot).collect())
        assert got == want
    assert simhash.near_duplicates(docs.where("false")).count() == 0
    assert simhash.near_duplicates(docs).where("doc_id IS NULL").first()["component_id"] == 5
    odd = docs.withColumn("fp", F.lit("x")).withColumn("_d", F.lit(1)).withColumn("component_id", F.lit(2))
    assert simhash.keep_one(odd).columns == odd.columns and sorted(pairs(simhash.keep_one(odd)), key=repr) == sorted(pairs(simhash.keep_one(docs)), key=repr)
    assert simhash.keep_one(docs.where("false")).count() == 0


def test_trie_join_against_all_pairs():
    rng = np.random.default_rng(1)
    for n in (2, 40, 500):
        centre = rng.integers(0, 2**63, size=max(1, n // 8), dtype=np.uint64)
        flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(n)]
        fps = np.unique(np.array([int(c) ^ f for c, f in zip(rng.choice(centre, n), flips, strict=True)], np.uint64))
        assert simhash.trie_join(fps, np.array([0, len(fps)])).tolist() == brute_components([int(x) for x in fps])


# line dedup


def brute_removed(rows, t=0.8, least=1):
    lines = [(i, k, set(WORD.findall(x))) for i, text in sorted(rows) for k, x in enumerate((text or "").split("\n"))]
    lines = [x for x in lines if len(x[2]) >= least]
    out = {i: [] for i, _ in rows}
    for n, (i, k, s) in enumerate(lines):
        if any(len(s & o) >= t * len(s | o) - 1e-9 for _, _, o in lines[:n]):
            out[i].append(k)
    return sorted((i, len((text or "").split("\n")), len(out[i]), ",".join(map(str, out[i]))) for i, text in rows)


def test_line_duplicates(spark, table):
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.randint(3, 14))) for _ in range(12)]
    rows = []
    for i in range(60):
        lines = [" ".join(w if rng.random() > 0.06 else "zz" for w in rng.choice(base).split()) for _ in range(rng.randint(0, 4))]
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, LOREM * 50), (103, LOREM * 50 + " x"), *((200 + i, LOREM + f" v{i}") for i in range(30))]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    for df in (made, table):
        assert by_id(line_dedup.line_duplicates(df), "n_lines", "n_removed", "removed") == sorted(brute_removed(pairs(df)), key=repr)
    assert by_id(line_dedup.line_duplicates(made, broadcast_rows=0), "n_removed") == by_id(line_dedup.line_duplicates(made), "n_removed")
    # lists of any length are cut into parts that meet two by two
    for limit in (1, 3, 20):
        assert by_id(line_dedup.line_duplicates(made, list_rows=limit), "n_removed", "removed") == by_id(line_dedup.line_duplicates(made), "n_removed", "removed")
    assert line_dedup.line_duplicates(made.where("false")).count() == 0


def test_words_of_any_length_are_told_apart():
    """By bytes, length and place alike: steps of eight bytes, longer words, closing zero bytes, bytes at every offset."""
    rng = random.Random(5)
    made = [bytes(rng.choice(b"ab\x00\xc3") for _ in range(n)) for n in (1, 2, 7, 8, 9, 15, 16, 17, 63, 64, 65, 66, 200) for _ in range(6)] + [b"a", b"a\x00", b"a" * 8, b"a" * 8 + b"\x00"]
    seen = {}
    for _ in range(20):
        text = b"".join(rng.choice([b" ", b"\n", b"\t\x0b"]) + w for w in rng.sample(made, 40))
        start, end, hashes = line_dedup.words(np.frombuffer(text, np.uint8))
        assert [text[a:b] for a, b in zip(start, end, strict=True)] == text.split()
        for w, h in zip(text.split(), hashes.tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_line_dedup_groups_by_hash_and_sorts_by_one_number(spark, monkeypatch):
    """Equal lines take no sort, entries are sorted by a single long, and words meet as strings: arrays of binary intersect by trying every two elements."""
    written, whole = {}, line_dedup.materialise
    monkeypatch.setattr(line_dedup, "materialise", lambda df, what: written.setdefault(what, df) and whole(df, what))
    long = "x" * 70 + " " + "y" * 64
    texts = [f"{LOREM} {long}\nb a\na b", f"{LOREM} {long} z\nb a", f"{long} q w e\n{long} q w r\n{long} q w e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert by_id(line_dedup.line_duplicates(docs), "n_lines", "n_removed", "removed") == brute_removed(list(enumerate(texts)))
    plan = lambda what: written[what]._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" not in plan("equal-lines")
    sorts = [x for x in plan("first-pairs").splitlines() if "Sort [" in x]
    assert len(sorts) == 1 and sorts[0].count(" ASC ") == 1
    assert written["line-words"].schema["w"].dataType.simpleString() == "array<string>"


def test_line_dedup_keeps_other_columns(docs):
    odd = docs.withColumn("doc", F.lit("mine")).withColumn("removed", F.lit(1)).withColumn("_row", F.lit(2)).withColumn("line", F.lit(3)).withColumn("Key", F.lit(4))
    got = line_dedup.dedup_lines(odd)
    assert got.columns == odd.columns and sorted(pairs(got), key=repr) == sorted(pairs(line_dedup.dedup_lines(docs)), key=repr)
    assert {tuple(r) for r in got.select("doc", "removed", "_row", "line", "Key").distinct().collect()} == {("mine", 1, 2, 3, 4)}
    assert all(r["n_chars"] == len(r["text"] or "") for r in got.where("n_chars IS NOT NULL").collect())
    assert line_dedup.dedup_lines(odd.where("false")).count() == 0


def test_line_duplicates_with_repeated_and_null_ids(docs):
    got = line_dedup.dedup_lines(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    assert [r["text"] for r in got.where("doc_id = 3").collect()] == ["one", "one"]
    assert got.where("doc_id IS NULL").first()["text"] == LOREM  # null comes first, so its line stays
    assert got.where("doc_id = 5").first()["text"] == ""


# personal data, licences


def brute_personal(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 12, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == "phone" or pii.luhn(digits)):
                out.append((kind, *m.span()))
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_base_spans():
    rng = random.Random(0)
    for _ in range(4000):
        t = "".join(rng.choice("aZ09.@+- 12()%_-é3.@4") for _ in range(rng.randint(0, 40)))
        assert pii.find(t)[0] == brute_personal(t)


@pytest.mark.parametrize(
    "text,spans",
    [
        ("write to john [at] example [dot] com.", "email:9:36"),
        ("jane at mail dot example dot org", "email:0:32"),
        ("jоhn@exаmple.com", "email:0:16"),
        ("call five five five one two three four five six seven", "phone:5:53"),
        ("４０１２ ８８８８ ８８８８ １８８１", "card:0:19"),
        ("we meet at noon. A dot on the map. One two three.", ""),
        ("plain a.b@c.de", "email:6:14"),
    ],
)
def test_disguises(text, spans):
    assert pii.listed(pii.find(text)[1]) == spans


def test_personal_data_rows(docs, table):
    for df in (docs, table):
        got = by_id(pii.personal_data(df, masked=True), "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
        want = []
        for i, t in pairs(df):
            base = brute_personal(t or "")
            want.append((i, *(sum(k == kind for k, _, _ in base) for kind in pii.KINDS), hashlib.sha256(pii.listed(base).encode()).hexdigest()))
        assert got == sorted(want, key=repr)
    assert pii.personal_data(docs.where("false")).count() == 0
    assert pii.mask("x a@b.cd y") == "x <email> y"


def test_licenses(docs, table, spark):
    more = spark.createDataFrame([(1, "CC BY cc by; All Rights\nReserved"), (2, "blah " + next(t for label, t in licenses.TEXTS if label == "mit").replace(" merge ", " blend ")), (3, "Licensed under CC BY-NC 4.0.")], "doc_id long, text string")
    for df in (docs.select("doc_id", "text"), table.select("doc_id", "text"), more):
        want = []
        for i, t in pairs(df):
            w = ALNUM.findall((t or "").translate(FOLD))
            at = sorted((k, label) for p, label in licenses.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
            want.append((i, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))))
        assert by_id(licenses.licenses(df), "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=repr)
    got = {r["doc_id"]: (r["labels"], round(r["score"], 2)) for r in licenses.licenses(more).collect()}
    assert got == {1: ("cc-by,reserved", got[1][1]), 2: ("mit", 0.99), 3: ("cc-by,cc-by-nc-4.0", 1.0)}
    assert licenses.licenses(docs.where("false")).count() == 0


@pytest.mark.parametrize(
    "text,labels",
    [
        ("Distributed under the Apache License, Version 2.0", "apache-2.0"),
        ("Apache License, Version 2.0", "apache-2.0"),
        ("Distributed under the MIT License", "mit"),
        ("MIT License\n\nCopyright (c) 2020 X", "mit"),
        ("GNU General Public License v3", "gpl,gpl-3.0"),
        ("use it under CC BY-SA 4.0, please", "cc-by,cc-by-sa-4.0"),
        ("see the Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc-4.0"),
        (dict(reversed(licenses.TEXTS))["mit"], "mit"),
        (licenses.TEXTS[6][1], "mit"),
        (licenses.TEXTS[4][1][100:], "apache-2.0"),
        (licenses.TEXTS[11][1], "bsd"),
        (licenses.TEXTS[13][1], "isc"),
        ("the apache helicopter, version 2.0 of it, has no licence", ""),
        ("she went to MIT; the driving license came later", ""),
        ("without warranty of any kind", ""),
    ],
)
def test_license_wordings(text, labels):
    """Names whatever stands around them, and passages that stand alone; words in common with a licence are none."""
    assert licenses.scanner().scan(text.encode())["labels"] == labels


def test_licenses_replace_clashing_columns(spark):
    df = spark.createDataFrame([(1, "the MIT License", "x"), (1, None, "y")], "doc_id long, text string, Labels string")
    assert sorted((r["n_words"], r["labels"]) for r in licenses.licenses(df).collect()) == [(0, ""), (3, "mit")]


def test_every_template_gives_its_label():
    for label, words in licenses.TEMPLATES:
        assert label in licenses.scanner().scan(words.encode())["labels"].split(",")


def test_automaton_against_substrings():
    rng = random.Random(4)
    texts = [[rng.choice("abc") for _ in range(rng.randint(1, 25))] for _ in range(6)]
    auto = licenses.Automaton(texts)
    inside = lambda w: any(t[i : i + len(w)] == w for t in texts for i in range(len(t)))
    for _ in range(200):
        q = [rng.choice("abc") for _ in range(rng.randint(4, 30))]
        longest = []  # of the matches that end at each place
        for e in range(1, len(q) + 1):
            longest.append(next(n for n in range(e, -1, -1) if n == 0 or inside(q[e - n : e])))
        want = [(e - n, e) for e, n in enumerate(longest, 1) if n >= 4 and (e == len(q) or longest[e] <= n and longest[e] != n + 1)]
        assert [(a, b) for a, b, _ in auto.matches([auto.ids[w] for w in q], 0, 4)] == want


# tokenizers


def test_token_counts(docs, table):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for df, chunk, overlap in ((docs, 1 << 16, 512), (docs, 40, 8), (table, 700, 64)):
        want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in pairs(df)]
        assert by_id(tokens.token_counts(df, path, chunk=chunk, overlap=overlap), "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert tokens.token_counts(docs.where("false"), path).count() == 0


def test_token_counts_of_odd_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, enc, rng = Tokenizer.from_file(path), tokens.Encoder(path), random.Random(0)
    parts = ["a", "thes", "Ünï", "é", "é", "́", " ", "\n", " ", "\x1c", "<|endoftext|>", "'s", "12", "!!", "日本", "Σ", "İ", "🙂", "<|", "|>"]
    for _ in range(500):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        want = len(library.encode(t, add_special_tokens=False).ids)
        assert [enc.count(t, c, o) for c, o in ((1 << 16, 512), (8, 2), (20, 4))] == [want] * 3


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunks_are_spliced_at_proven_places(name):
    """Small chunks of texts with and without blanks: counts equal the library's, by each kind of splice and by widening."""
    enc, rng = tokens.Encoder(public_tokenizers.path(name)), random.Random(1)
    kinds = (
        lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz'") for _ in range(rng.randint(1, 12))) for _ in range(n)),
        lambda n: "".join(rng.choice("abcdeéthinsor") for _ in range(3 * n)),
        lambda n: "".join(rng.choice("日本語中文字漢") for _ in range(2 * n)),
        lambda n: "".join(rng.choice("0123456789") for _ in range(2 * n)),
        lambda n: "ab" * n,
        lambda n: "".join(rng.choice(["<|endoftext|>", "!!'", "'s", "e\u0301", "\u0301", " ", "the", "  ", "İ"]) for _ in range(n)),
    )
    for k in range(240):
        t = kinds[k % len(kinds)](rng.randint(50, 400))
        want = len(enc.library.encode(t, add_special_tokens=False).ids)
        assert [enc.count(t, c, o) for c, o in ((64, 16), (100, 40), (200, 8))] == [want] * 3
    assert all(enc.seen[k] for k in ("between", "inside", "widened", "grown")), enc.seen
    long = "".join(rng.choice("abcdefghij") for _ in range(60_000)) + " end " * 5000  # no blank for several chunks
    assert enc.counts([long, "", "short"]) == [len(enc.library.encode(x, add_special_tokens=False).ids) for x in (long, "", "short")]


def test_token_counts_replace_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x", True), (1, None, "y", None)], "doc_id long, text string, N_Tokens string, over_limit boolean")
    got = sorted(map(tuple, tokens.token_counts(df, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()))
    assert got == [(1, 0, 0, False), (1, 3, 2, False)]


def test_sentencepiece(docs, table):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, model = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Pieces(path)
    for df in (docs, table):
        out = pieces.encode(df, path)
        assert by_id(out, "ids") == sorted(((i, library.encode(t or "")) for i, t in pairs(df)), key=repr)
        assert out.where("NOT round_trip").count() == 0
    rng = random.Random(0)
    parts = ["a", "the", "th", "日本", "  ", "\n", "▁", "\t", "🙂", "́", "привет", "000", "!!!", "\x00", "tion"]
    for _ in range(500):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert model.encode(t) == library.encode(t) and model.decode(model.encode(t)) == t.replace("▁", " ")
    t = "".join(rng.choice("abcdeéthin") for _ in range(5000))
    assert model.encode(t) == library.encode(t)
    assert pieces.encode(docs.where("false"), path).count() == 0


def test_sentencepiece_streams(table, monkeypatch):
    """Ordinary documents are committed bit by bit from a narrow window, in blocks of any size and without the memory of words."""
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [t for _, t in pairs(table.where("doc_id < 40"))]
    for block, whole in ((37, False), (1 << 15, True)):
        monkeypatch.setattr(pieces, "BLOCK", block)
        model = pieces.Pieces(path)
        if whole:  # one pass over the text itself
            model.stretches = re.compile("(?s:.+)")
        assert [model.encode(t) for t in texts] == [library.encode(t or "") for t in texts]
        assert model.commits > 1000 and model.widest <= 2 * model.longest
    assert model.commits > sum(len(t or "") for t in texts) / 10
    t = "aé" * 40_000  # no structural boundary at all
    assert model.encode(t) == library.encode(t) and model.widest <= 2 * model.longest
    for letters in ("therinsadol", "tionmeal "):  # words without end, whose pieces run into each other
        t = "".join(random.Random(1).choices(letters, k=40_000))
        assert model.encode(t) == library.encode(t)
    assert model.walks > 0 and model.widest <= 2 * model.longest


def test_sentencepiece_passes_over_whole_blocks(table):
    """What the memory does not answer goes through one pass over all that follows it; a second reading is answered by the memory alone."""
    model = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    texts, seen, real = [t or "" for _, t in pairs(table)], [], model.viterbi
    model.viterbi = lambda text, ends: seen.append(len(text)) or real(text, ends)
    first = [model.packed(t) for t in texts]
    assert max(seen) > 20 * model.longest and sum(seen) > sum(map(len, texts)) / 10 and model.commits > 10_000 and model.widest <= 2 * model.longest
    hits, passed = model.hits, sum(seen)
    assert [model.packed(t) for t in texts] == first and model.hits > hits and sum(seen) - passed < passed / 10


def test_sentencepiece_pairs_stay_apart_as_by_the_merge_rules(monkeypatch):
    """Both sides' steps up to the boundary say of two pieces what the merge rules on their joined text do; forgotten pairs are asked again."""
    model = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))

    def merged(text: str) -> list[str]:
        parts = list(text)
        while True:
            found = [(-model.score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in model.score]
            if not found:
                return parts
            at = min(found)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    rng, ids = random.Random(5), sorted(model.name)
    asked = [(rng.choice(ids), rng.choice(ids)) for _ in range(20_000)]
    words = [i for i in ids if len(model.name[i]) > 5]
    for i in rng.sample(words, 5_000):  # both parts of a longer piece, which often do merge
        name = model.name[i]
        asked += [(model.vocab[name[:k]], model.vocab[name[k:]]) for k in range(1, len(name)) if name[:k] in model.vocab and name[k:] in model.vocab]
    monkeypatch.setattr(pieces, "PAIRS", 1000)
    for (a, b), fits in zip(asked, [model.apart[a][b] if b in model.apart[a] else model.fit(a, b) for a, b in asked]):
        assert fits == (merged(model.name[a] + model.name[b]) == [model.name[a], model.name[b]])
    assert model.pairs <= 1000 and sum(map(len, model.apart)) == model.pairs


def test_sentencepiece_decodes_any_ids_as_the_library_does():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, model, rng = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Pieces(path), random.Random(0)
    for k in range(3000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(4)]) if k % 3 else rng.randrange(3, 259) for _ in range(rng.randint(1, 30))]
        assert model.decode(ids) == library.decode(ids)


def test_sentencepiece_replaces_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, None, None)], "doc_id long, text string, IDS string")
    out = pieces.encode(df, public_tokenizers.path("piece_bpe_32k.model"))
    assert out.columns == ["doc_id", "n_ids", "ids_sha256", "decoded_sha256", "round_trip", "ids"] and out.count() == 3
    assert out.where("doc_id = 2").first()["n_ids"] == 0


# sharding, archives


def test_min_cost_flow():
    flow = reshard.min_cost_flow({0: 10, 1: 2}, {0: 4, 1: 4, 2: 4})
    assert sum(v for (i, j), v in flow.items() if i != j) == 6 and flow[0, 0] == 4 and flow[1, 1] == 2
    with pytest.raises(ValueError):
        reshard.min_cost_flow({0: 5}, {0: 4})


def test_min_cost_flow_moves_the_fewest_units():
    """Against all ways to fill the new shards, unit by unit."""
    rng = random.Random(3)
    for _ in range(60):
        old = {i: rng.randint(0, 4) for i in range(rng.randint(1, 3))}
        room = {j: rng.randint(0, 4) for j in range(rng.randint(1, 3))}
        room[0] += max(0, sum(old.values()) - sum(room.values()))
        best = {tuple(room.values()): 0}  # room left -> fewest moved so far
        for i, n in old.items():
            for _unit in range(n):
                step: dict = {}
                for left, moved in best.items():
                    for k, j in enumerate(room):
                        if left[k]:
                            to = (*left[:k], left[k] - 1, *left[k + 1 :])
                            step[to] = min(step.get(to, 10**9), moved + (i != j))
                best = step
        flow = reshard.min_cost_flow(old, room)
        assert sum(v for (i, j), v in flow.items() if i != j) == min(best.values())
        assert all(sum(v for (i, _), v in flow.items() if i == k) == n for k, n in old.items())
        assert all(sum(v for (_, j), v in flow.items() if j == k) <= n for k, n in room.items())


def test_resharded_moves_little_and_takes_clashing_columns(spark, table, tmp_path):
    """Bytes of rows that change their shard are those of the flow, up to the rows at its cuts."""
    odd = table.withColumn("shard", F.lit("s")).withColumn("_FILE", F.lit("f")).withColumn("rid", F.lit(1)).withColumn("old", F.lit(2))
    rows = reshard.resharded(odd, F.pmod("doc_id", F.lit(3)), 4, str(tmp_path / "r"), keep=("doc_id", "rid", "old")).collect()
    assert len(rows) == table.count() and {(r["rid"], r["old"]) for r in rows} == {(1, 2)}
    held = Counter()
    for r in rows:
        held[r["old_shard"]] += r["size"]
    flow = reshard.min_cost_flow(dict(held), reshard.equal_capacities(sum(held.values()), 4))
    least = sum(v for (i, j), v in flow.items() if i != j)
    longest = max(r["size"] for r in rows)
    assert abs(sum(r["size"] for r in rows if r["old_shard"] != r["shard"]) - least) <= longest * len(flow)


def test_reshard(docs, table):
    for df, old in ((docs, F.lit(None)), (table, F.pmod(F.xxhash64("source"), F.lit(3)))):
        rows = reshard.reshard(df, old, 4).collect()
        texts = Counter((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in pairs(df))
        assert Counter((r["doc_id"], r["text_crc32"], r["size"]) for r in rows) == texts
        for s in range(4):
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(4)]
    assert max(sizes) - min(sizes) <= 0.01 * sum(sizes)
    assert reshard.reshard(docs.where("false"), F.lit(0), 4).count() == 0


def test_rewrite_touches_affected_shards_only(spark, table, tmp_path):
    root = str(tmp_path)
    table.select("doc_id", F.rpad(F.col("doc_id").cast("string"), 9, "x").alias("text")).withColumn("shard", (F.col("doc_id") >= 100).cast("int") + (F.col("doc_id") >= 150).cast("int")).write.partitionBy("shard").parquet(f"{root}/v0")
    out = {r["shard"]: r for r in reshard.rewrite(root, 0, 3, spark).collect()}
    assert all(r["rewritten"] for r in out.values()) and sum(r["rows"] for r in out.values()) == 200
    got = [r["doc_id"] for s in out.values() for r in spark.read.parquet(s["path"]).collect()]
    assert sorted(got) == list(range(200))
    again = reshard.rewrite(root, 1, 3, spark).collect() if max(r["bytes"] for r in out.values()) != min(r["bytes"] for r in out.values()) else []
    assert all(not r["rewritten"] or r["rows"] for r in again)


def test_warc(spark, tmp_path):
    long = "<p>" + "é" * 100
    rows = [(5, "http://a", long), (2, "http://b\r\nX: y", long), (7, None, long), (1, "u", "short"), (3, "u", "short"), (4, "u", None), (None, "n", long), (2, "again", long), (9, "100%", "z\r\n\r\nz" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write(pages, path)
    got = warc.read(spark, path)
    seen = Counter((r["page_id"], r["url"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in got.collect())
    want = Counter()
    for i, u, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and h == long and i != 2
        want[i, u, "revisit" if again else "response", 2 if again else None, len(b), hashlib.sha256(b).hexdigest()] += 1
    assert seen == want
    assert {bytes(r["payload"]) for r in got.where("record_type = 'response'").collect()} == {(h or "").encode() for _, _, h in rows}
    plan = got.where("record_type = 'revisit' AND url LIKE 'http%'")
    assert [r["page_id"] for r in plan.collect()] == [5]
    assert all(r["payload"] is None for r in warc.read(spark, path, payload=False).collect())
    empty = str(tmp_path / "e")
    warc.write(pages.where("false"), empty)
    assert warc.read(spark, empty).count() == 0


def foreign(kind, url, block, extra="", http=True):
    return (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\n{extra}Content-Type: {'application/http; msgtype=response' if http else 'text/plain'}\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_warc_of_other_writers(spark, tmp_path):
    """One gzip member per record, one per file, none, and files divided by bytes."""
    import gzip

    rng = random.Random(0)
    bodies = [bytes(rng.choice(b"<>abc \r\n") for _ in range(rng.choice([0, 10, 3000]))) for _ in range(60)]
    records = [foreign("warcinfo", "x", b"software: test\r\n", http=False)]
    for i, b in enumerate(bodies):
        records += [foreign("request", f"http://a/{i}", b"GET / HTTP/1.1\r\n\r\n"), foreign("response", f"http://a/{i}", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + b, "WARC-Payload-Digest: sha1:ABC\r\n"), foreign("metadata", f"http://a/{i}", b"fetch: 1", http=False)]
    files = {"members.warc.gz": b"".join(gzip.compress(r) for r in records), "one.warc.gz": gzip.compress(b"".join(records)), "plain.warc": b"".join(records)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
        for split in (warc.SPLIT, 700):
            got = warc.read(spark, str(tmp_path / name), split=split)
            rows = got.collect()
            assert Counter(r["record_type"] for r in rows) == {"warcinfo": 1, "request": 60, "response": 60, "metadata": 60}
            assert {r["url"]: bytes(r["payload"]) for r in rows if r["record_type"] == "response"} == {f"http://a/{i}": b for i, b in enumerate(bodies)}
            assert all(r["payload"] is None and r["page_id"] is None for r in rows if r["record_type"] != "response")
            some = got.where("record_type = 'response' AND url LIKE 'http://a/1%'").collect()
            assert sorted(r["url"] for r in some) == sorted(f"http://a/{i}" for i in range(60) if str(i).startswith("1"))
    assert warc.read(spark, str(tmp_path)).count() == 3 * 181
    mixed = tmp_path / "mixed"
    warc.write(spark.createDataFrame([(1, "u", "é" * 200), (2, "u", "é" * 200)], "page_id long, url string, html string").coalesce(1), str(mixed))
    mine = next(mixed.glob("*.warc.gz"))
    (tmp_path / "both.warc.gz").write_bytes(files["members.warc.gz"] + mine.read_bytes() + files["members.warc.gz"])
    for split in (warc.SPLIT, 500):
        assert Counter(r["record_type"] for r in warc.read(spark, str(tmp_path / "both.warc.gz"), split=split).collect()) == {"warcinfo": 2, "request": 120, "response": 121, "metadata": 120, "revisit": 1}
    warc.write(spark.createDataFrame([(3, "v", "x")], "page_id long, url string, html string"), str(mixed))  # a second write is added
    assert warc.read(spark, str(mixed)).count() == 3


def test_warc_pushdown_skips_payloads():
    reader = warc.Reader({"path": "x"})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.EqualTo(("payload",), b"")]))
    assert len(left) == 1 and reader.wanted({"record_type": "response"}) and not reader.wanted({"record_type": "revisit"})


def test_shared_dir_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert shared.shared_dir(spark) == named.rstrip("/")
    assert math.isclose(spark.createDataFrame([(1.0,)], "x double").select(shared.let(F.col("x"), lambda v: v + v)).first()[0], 2.0)
