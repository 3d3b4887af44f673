"""What showed on odd inputs and larger tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from engrama.operators import extras, grams, graph, knn, ledger, lexical, postings, recall, scoping


def test_a_null_text_is_not_the_longest(spark):
    made = [("a", None, [1.0, 0.0], "s1"), ("b", "said", [1.0, 0.0], "s2"), ("c", "", [1.0, 0.0], "s1")]
    made = spark.createDataFrame([(*m, "session") for m in made], "id string, text string, embedding array<double>, session_id string, tier string")
    got = {r["id"]: r["tier"] for r in scoping.promotions(made).collect()}
    assert got == {"a": None, "b": "long_term", "c": None}


def test_a_pair_at_the_limit_is_close(spark):
    """Its cosine is 2/5, the product of its unit rows 0.39999999999999997."""
    made = [("a", "said", [1.0, 0.0, 2.0, 0.0], "s1", "session"), ("b", "said so", [2.0, 1.0, 0.0, 0.0], "s2", "session")]
    made = spark.createDataFrame(made, "id string, text string, embedding array<double>, session_id string, tier string")
    assert {r["id"]: r["tier"] for r in scoping.promotions(made, 0.4).collect()} == {"a": None, "b": "long_term"}
    assert scoping.promotions(made, 0.41).isEmpty()


def test_blocks_of_a_side_do_not_grow_with_the_rows():
    """Every row goes to each block of the other side, so what is shuffled grows with blocks times rows."""
    assert [knn._blocks(n, 64) for n in (1, 2_048, 10_000, 100_000, 600_000)] == [1, 1, 5, 12, 12]
    assert knn._blocks(10_000_000, 64) == 77  # of 64 MB each


def test_tiles_give_what_one_product_gives(monkeypatch):
    monkeypatch.setattr(knn, "STEP", 7)
    monkeypatch.setattr(knn, "TILE", 5)
    rng = np.random.default_rng(3)
    q, m = rng.integers(-1, 2, (30, 3)).astype(float), rng.integers(-1, 2, (40, 3)).astype(float)
    ids, pos = np.array([f"m{i % 35}" for i in range(40)], object), rng.permutation(40)
    for gate in (None, 0.5):
        for k in (1, 4):
            rows, cols, sims = knn._nearest(q, m, ids[:30], ids, pos, k, gate)
            for i in range(30):
                all_ = sorted((-s, pos[j], j) for j, s in enumerate(q[i] @ m.T) if ids[j] != ids[i] and (gate is None or s >= gate))[:k]
                assert [(-s, pos[c], c) for s, c in zip(sims[rows == i], cols[rows == i], strict=True)] == all_


def test_best_so_far_keeps_ties_by_place_and_skips_the_rest():
    best = lexical.Best(2, 2, 9)
    ids = np.array(["a", "b", "c"], object)
    best.add(np.array([[1.0, 2.0, 2.0 + 1e-13], [0.0, 0.0, 0.0]]), np.array([5, 9, 8]), ids)
    best.add(np.array([[2.0 - 1e-13, 0.5, 2.0], [0.0, 0.0, 1.0]]), np.array([1, 2, 20]), ids)
    got = best.rows(np.array(["p", "q"], object))
    assert list(zip(got["q_id"], got["_pos"], strict=True)) == [("p", 1), ("p", 8), ("q", 20), ("q", 1)]
    assert len(best.row) == 4


def test_all_queries_are_one_pass(spark, monkeypatch):
    """The memories are read once for many queries, in parts of a matrix' size."""
    mem = spark.createDataFrame([(f"m{i}", i, f"w{i % 7} w{i % 3} x") for i in range(60)], "id string, _pos long, text string").cache()
    asks = spark.createDataFrame([(f"q{i}", f"w{i % 9} x") for i in range(25)], "q_id string, text string")
    whole = [sorted(map(tuple, f(asks, mem, 4).collect())) for f in (recall.keyword_recall, extras.bm25)]
    monkeypatch.setattr(lexical, "QUERIES", 4)
    monkeypatch.setattr(lexical, "MEMORIES", 9)
    assert [sorted(map(tuple, f(asks, mem, 4).collect())) for f in (recall.keyword_recall, extras.bm25)] == whole
    assert len(list(lexical.query_blocks(asks.selectExpr("q_id", "split(text, ' ') AS tok")))) == 1


@pytest.mark.parametrize("dense", [0, 1 / 64, 0.3, 2])
def test_words_in_a_product_or_one_by_one(monkeypatch, dense):
    monkeypatch.setattr(lexical, "DENSE", dense)
    rng = np.random.default_rng(5)
    asked, held = rng.random((20, 30)) * (rng.random((20, 30)) < 0.2), rng.random((30, 15)) * (rng.random((30, 15)) < 0.3)
    w, q = np.nonzero(asked.T)
    assert np.allclose(lexical._product((w, q, asked[q, w]), held, np.count_nonzero(held, axis=1), 20), asked @ held, atol=1e-12)


def test_single_precision_only_leaves_out_what_cannot_rank():
    """Similarities that differ by less than single precision tells, among many that it does tell."""
    rng = np.random.default_rng(4)
    q, m = rng.normal(size=(5, 8)), rng.normal(size=(3000, 8))
    m[::3] = q[0] + 1e-6 * rng.normal(size=(1000, 8))
    q, m = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (q, m))
    exact = np.einsum("ik,jk->ij", q, m)
    rows, cols, sims = knn._nearest(q, m, np.array([f"q{i}" for i in range(5)], object), np.array([f"m{i}" for i in range(3000)], object), np.arange(3000), 4, 0.2)
    for i in range(5):
        assert np.allclose(sims[rows == i], np.sort(exact[i])[::-1][:4], rtol=0, atol=1e-15)


def test_many_buckets_share_the_blocks(spark):
    """64 buckets of 10,000 were 5 x 5 pairs of blocks each, 1,600 in all, and each row went to 5 of them twice."""
    sizes = spark.createDataFrame([(i, 10_000) for i in range(64)], "key long, c long")
    assert {r["n"] for r in knn.shared_out(sizes, 64).collect()} == {2}
    assert knn.shared_out(sizes.where("key = 1"), 64).first()["n"] == 5


def test_edges_are_searched_once_for_all_strategies(spark):
    searched = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            searched.add(len(b))
            yield b

    links = spark.createDataFrame([("a", "b", 0.9, 1), ("b", "c", 0.8, 1), ("c", "d", 0.7, 1)], "src string, dst string, sim double, rnk int").coalesce(1)
    seeds = spark.createDataFrame([("q", "a", 1)], "q_id string, id string, rnk int")
    got = graph.reach(links.mapInPandas(count, links.schema), seeds, spark.createDataFrame([("c",)], "id string"))
    assert {(r["strategy"], r["found"], r["noise"]) for r in got.collect()} == {("forward-1", 0, 1), ("forward-2", 1, 1), ("bidirectional-1", 0, 1), ("bidirectional-2", 1, 1)}
    assert searched.value == 3


def test_gains_are_not_computed_for_each_pair(spark):
    """No hyperbolic tangent is left in what runs over the pairs, and pairs on both sides of every limit come out as by the formula."""
    pairs = spark.createDataFrame([(str(i), round(0.2 + i / 400, 6)) for i in range(160)] + [("none", None)], "pair string, cos double")
    out = ledger.timescale(pairs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any("tanh" in line.lower() and "cos" in line for line in plan.splitlines())
    for r in out.collect():
        learn = next((n for n in range(1, 61) if r["cos"] is not None and r["cos"] + 0.3 * math.tanh(n * 0.1) >= 0.55), None)
        left = lambda n: learn * 0.1 * 0.95**n
        forget = next((n for n in range(1, 501) if learn and r["cos"] + 0.3 * math.tanh(left(n) if left(n) >= 0.05 else 0) < 0.55), None)
        assert (r["learn"], r["forget"]) == (learn, forget and forget * 10)


@pytest.mark.parametrize("zeros", [1 << 20, 0])
def test_only_memories_with_a_vector_are_sorted(spark, monkeypatch, zeros):
    """Ranks of bare memories are counted: queries without a direction, similarities of 0, ties and null texts among them."""
    monkeypatch.setattr(knn, "ZEROS", zeros)
    rng = np.random.default_rng(9)
    v = rng.integers(-1, 2, size=(120, 3)).astype(float)
    rows = [(str(i), i * 100, None if i % 4 == 1 else v[i].tolist(), None if i % 7 == 0 else f"Word{i % 5} and more") for i in range(120)]
    mem = spark.createDataFrame(rows, "id string, _pos long, embedding array<double>, text string")
    lone = next(str(i) for i in range(120) if i % 4 != 1 and not v[i].any())
    asked = ["0", "2", "7", lone]
    asks = mem.where(F.col("id").isin(*asked)).select(F.col("id").alias("q_id"), "embedding")
    terms = {"0": "WORD1", "2": "", "7": None, lone: "none"}
    ranked = knn.ranking(asks, mem, spark.createDataFrame(list(terms.items()), "q_id string, term string"))
    got = {(r["q_id"], r["rnk"]): (r["id"], r["is_target"]) for r in ranked.collect()}
    unit = lambda i: v[i] / (np.linalg.norm(v[i]) or 1) if i % 4 != 1 else np.zeros(3)
    for q in asked:
        order = sorted((i for i in range(120) if str(i) != q), key=lambda i: (-round(float(unit(int(q)) @ unit(i)), 12), i))
        holds = lambda i: terms[q] is not None and i % 7 != 0 and terms[q].lower() in rows[i][3].lower()
        assert [got[q, n] for n in range(1, 120)] == [(str(i), holds(i)) for i in order]
    if zeros:
        sorted_ = [line for line in ranked._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in line]
        assert len(sorted_) == 1  # over rows of memories with a vector


def test_copies_are_not_gathered_all_at_once(monkeypatch):
    """Of equal vectors every pair reaches the floor; they are multiplied again in parts, and the first by place rank."""
    most, einsum = [0], np.einsum
    monkeypatch.setattr(np, "einsum", lambda how, x, y: most.__setitem__(0, max(most[0], len(x))) or einsum(how, x, y))
    v, ids = np.full((600, 4), 0.5), np.array([f"m{i}" for i in range(600)], object)
    rows, cols, _ = knn._nearest(v, v, ids, ids, np.arange(600)[::-1], 2, 0.2)
    assert most[0] <= knn.PAIRS
    assert cols[rows == 0].tolist() == [599, 598] and cols[rows == 599].tolist() == [598, 597]


@pytest.mark.parametrize("exact", [True, False])
def test_all_among_themselves_meet_once(spark, monkeypatch, exact):
    """A row goes to as many tasks as there are blocks, not to twice as many for each direction, in single precision where that is what it holds; the results are those in place."""
    rng = np.random.default_rng(6)
    v = rng.integers(-2, 3, (150, 5)) / (4 if exact else 3)
    mem = spark.createDataFrame([(f"m{i % 140}" if i < 140 else f"x{i}", i, v[i].tolist()) for i in range(150)] + [("none", 150, None)], "id string, _pos long, embedding array<double>").cache()
    rows = lambda df: sorted(map(tuple, df.collect()))
    plain = rows(knn.search(mem.withColumnRenamed("id", "q_id"), mem, 3, gate=0.25))
    assert rows(knn.neighbours(mem, 3, 0.25)) == plain
    monkeypatch.setattr(knn, "FEW_BYTES", 0)
    assert rows(knn.neighbours(mem, 3, 0.25)) == plain == rows(knn.search(mem.withColumnRenamed("id", "q_id"), mem, 3, gate=0.25))
    sent = knn._among(mem.where("embedding IS NOT NULL"), knn.OWN, 3, 0.25, knn._single(mem.where("embedding IS NOT NULL"))[2])
    plan = sent._jdf.queryExecution().optimizedPlan().toString()
    assert ("array<float>" in plan) == exact


@pytest.mark.parametrize("side", [2, 3, 5, 7])
def test_every_two_blocks_lie_on_one_line(spark, side):
    """A row goes to side + 1 tasks of side blocks, and no two blocks share two of them or none."""
    lines = {}
    mem = spark.range(40 * side * side).select(F.col("id").cast("string").alias("id"))
    for r in knn._lined(mem, side).select("_b", "_line").distinct().collect():
        lines.setdefault(r["_b"], set()).add(r["_line"])
    assert len(lines) == side * side and len(set().union(*lines.values())) == side * (side + 1)
    assert all(len(x) == side + 1 and sum(line >= side * side for line in x) == 1 for x in lines.values())
    assert all(len(lines[a] & lines[b]) == 1 for a in lines for b in lines if a < b)


def test_what_is_sent_grows_with_the_rows(spark, monkeypatch):
    """All memories among themselves: beyond one small block nothing goes through the driver, and a row is sent to OWN + 1 tasks, until a line outgrows its bytes."""
    assert [knn._side(x) for x in (1, 64 * 615_384 * 8, knn.BLOCK_BYTES * 6, knn.BLOCK_BYTES * 8)] == [5, 5, 7, 11]
    rng = np.random.default_rng(8)
    mem = spark.createDataFrame([(f"m{i}", i, v) for i, v in enumerate(rng.integers(-3, 4, (90, 4)).astype(float).tolist())], "id string, _pos long, embedding array<double>")
    rows = lambda df: sorted(map(tuple, df.collect()))
    plain = rows(knn.neighbours(mem, 2, 0.2))
    monkeypatch.setattr(knn, "BLOCK", 40)
    monkeypatch.setattr(knn, "_in_place", None)
    for most in (knn.BLOCK_BYTES, 400):  # 5 and 11 blocks a side, some of these empty
        monkeypatch.setattr(knn, "BLOCK_BYTES", most)
        assert rows(knn.neighbours(mem, 2, 0.2)) == plain


@pytest.mark.parametrize("listed,cells,at_once", [(0, 1 << 17, 1 << 21), (1 / 400, 40, 3), (2, 7, 50), (2, 1 << 17, 1 << 21)])
def test_words_as_lists_give_the_product(monkeypatch, listed, cells, at_once):
    for name, value in (("LISTED", listed), ("CELLS", cells), ("AT_ONCE", at_once), ("QUERIES", 8)):
        monkeypatch.setattr(lexical, name, value)
    rng = np.random.default_rng(6)
    asked, held = rng.random((20, 30)) * (rng.random((20, 30)) < 0.3), rng.random((15, 30)) * (rng.random((15, 30)) < 0.3)
    (q, w), (column, word) = np.nonzero(asked), np.nonzero(held)
    for plain in (False, True):  # with weights; as counts
        a, h = (asked > 0, held > 0) if plain else (asked, held)
        asks = lexical.Asks(20, 30, q, w, None if plain else asked[q, w])
        got = np.concatenate([asks.meet(i, word, column, None if plain else held[column, word], 15) for i in range(len(asks.parts))])
        assert len(asks.parts) == 3 and np.allclose(got, a.astype(float) @ h.T.astype(float), atol=1e-12)
        needed = np.arange(8) % 3 == 0
        assert np.allclose(asks.meet(0, word, column, None if plain else held[column, word], 15, needed)[needed], got[:8][needed], atol=1e-12)


def test_groups_hold_every_query_and_memory_once(monkeypatch):
    """Queries and memories of two languages; each group's memories come together, with their own words."""
    monkeypatch.setattr(lexical, "FEW", 3)
    monkeypatch.setattr(lexical, "MEMORIES", 5)
    block = [(f"q{i}", [f"{'ab'[i % 2]}{j}" for j in range(6) if (i + j) % 4]) for i in range(20)] + [("none", [])]
    of = lexical.gathered(block)
    assert sorted(of.names) == sorted(q for q, _ in block)
    assert {(of.names[r], of.words[c]) for r, c in zip(of.rows, of.cols, strict=True)} == {(q, w) for q, tok in block for w in tok}
    assert dict(zip(of.names, of.size, strict=True)) == {q: len(tok) for q, tok in block}
    texts = [" ".join(f"{'ab'[i % 2]}{j}" for j in range(i % 7)) for i in range(23)]
    place = {w: i for i, w in enumerate(of.words)}
    word, column, _, _ = lexical.counted(texts, {w.encode(): i for w, i in place.items()})
    seen = {}
    for some, words, columns, weight in lexical.alike(of, word, column, None, len(texts)):
        assert len(some) <= 5 and weight is None
        for j, i in enumerate(some.tolist()):
            assert i not in seen
            seen[i] = {of.words[x] for x in words[columns == j]}
    assert seen == {i: set(t.split()) for i, t in enumerate(texts)}


def test_words_inside_runs():
    """Words of up to eight bytes, of eight, and longer ones."""
    words = ["a", "sea", "seaside", "overseas", "overseasx", "verseasxy", "overseasxyz", "zz"]
    place = {w: i for i, w in enumerate(words)}
    texts = ["Overseasxyz, sea!", None, "", "xseasidezz overseas", "ovErseasx", "OVERSEASX"]
    word, column, weight = lexical.inside(place)(texts)
    assert weight is None
    for j, text in enumerate(texts):
        assert {words[w] for w in word[column == j]} == {w for w in words if w in (text or "").lower()}


def test_word_searches_shuffle_no_texts(spark):
    """The texts were joined with vectors and labels, so all of them were shuffled for each pass."""
    from engrama import queries

    for query in (queries.bm25_topk, queries.keyword_fallback):
        assert "Join" not in query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_grams_of_many_texts_are_marked_at_once(monkeypatch):
    monkeypatch.setattr(grams, "TEXTS", 8)
    texts, at = ["sea_1 x", None, "", "a", "ab", "äbcö dé", "x" * 50, "9"], np.array([0, 3, 7, 8, 9, 800, 2040, 2047])
    want = {}
    for text, place in zip(texts, at.tolist(), strict=True):
        for run in lexical.RUN.findall(text or ""):
            for g in {run[i : i + n] for n in (1, 2, 3) for i in range(len(run) - n + 1)}:
                want[g] = want.get(g, 0) | 1 << place
    assert {g: int.from_bytes(b, "little") for g, b in grams._marked(texts, at)} == want
    known = grams._Words(["sea", "sea_1", "xxxx", "bc", "zzzz"])
    word, place = known.holding(want, dict(zip(at.tolist(), texts, strict=True)))
    assert sorted(zip(word.tolist(), place.tolist(), strict=True)) == [(0, 0), (1, 0), (2, 2040), (3, 800)]
    assert (np.diff(place) >= 0).all()


@pytest.mark.parametrize("most", [-1.0, 2.0])
def test_blocks_scored_together_or_one_by_one(spark, monkeypatch, most):
    mem = spark.createDataFrame([(f"m{i}", i, " ".join(f"w{j}" for j in range(12) if (i * j) % 5 == 1)) for i in range(90)], "id string, _pos long, text string").cache()
    asks = spark.createDataFrame([(f"q{i}", f"w{i % 12} w{i % 5} none") for i in range(11)], "q_id string, text string")
    monkeypatch.setattr(postings, "MOST", most)
    monkeypatch.setattr(lexical, "QUERIES", 4)
    held, stats = postings.build(mem, 10)
    assert sorted(map(tuple, postings.search(asks, mem, held, stats, 3).selectExpr("q_id", "rnk", "id", "round(score, 9)").collect())) == sorted(map(tuple, extras.bm25(asks, mem, 3).selectExpr("q_id", "rnk", "id", "round(score, 9)").collect()))


def test_two_options_share_the_stores_and_the_field_runs_only_for_cases_that_look_at_it(spark, monkeypatch):
    from engrama import queries
    from engrama.plans import recall_plan, replay

    calls, fields, whole, run = [], [], replay.replay, recall_plan.run
    monkeypatch.setattr(replay, "replay", lambda *a: calls.append(1) or whole(*a))
    monkeypatch.setattr(recall_plan, "run", lambda q, m, options, **kw: fields.append(options.field) or run(q, m, options, **kw))
    assert {r["kind"] for r in queries.ab_evaluated(spark, "/root/testdata/sf0.001").collect()} >= {"all"}
    assert len(calls) == 1 and fields == [False, False]


def test_a_block_without_queries_or_words():
    assert len(lexical.gathered([]).names) == 0
    of = lexical.gathered([("q", []), ("r", [])])
    assert sorted(of.names) == ["q", "r"] and of.words == []
    none = np.zeros(0, np.int64)
    for some in (lexical.gathered([]), of):
        assert sum(len(p) for p, *_ in lexical.alike(some, none, none, None, 3)) == 3
