"""Block-max postings against scoring every memory."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from engrama import queries
from engrama.operators import extras, lexical, postings


def rows(df):
    return sorted((r["q_id"], r["rnk"], r["id"], round(r["score"], 9)) for r in df.collect())


@pytest.fixture(scope="module")
def mem(spark):
    rng = random.Random(1)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    texts = [None, "", "!", *(" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(300))]
    # some blocks speak of a subject that others don't
    texts = [t if t is None or i // 20 != 7 else t + " harbour lantern" for i, t in enumerate(texts)]
    return spark.createDataFrame([(f"m{i}", i, t) for i, t in enumerate(texts)], "id string, _pos long, text string").cache()


@pytest.mark.parametrize("block,first", [(1, 1), (20, 2), (1000, 2)])
def test_equal_to_scoring_all(spark, mem, block, first):
    asked = ["harbour lantern", "w1 w2 w3", "w1", "W900 none", "", None, "nothing", "w5 w5 harbour"]
    asks = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(asked)], "q_id string, text string")
    held, stats = postings.build(mem, block)
    for k in (1, 7):
        assert rows(postings.search(asks, mem, held, stats, k, first)) == rows(extras.bm25(asks, mem, k))


def test_blocks_that_cannot_rank_are_skipped(spark, mem):
    held, stats = postings.build(mem, 20)
    asks = spark.createDataFrame([("q", "harbour lantern w1 w2")], "q_id string, text string")
    assert postings.skipped(asks, held, stats, 5) > 0.5


def test_whole_turns(spark):
    sf = "/root/testdata/sf0.01"
    assert rows(queries.bm25_pruned(spark, sf)) == rows(queries.bm25_topk(spark, sf))


def test_no_memories(spark, mem):
    none = mem.where(F.lit(False))
    held, stats = postings.build(none)
    assert postings.search(spark.createDataFrame([("q", "w1")], "q_id string, text string"), none, held, stats, 5).count() == 0


def test_queries_and_blocks_do_not_meet_as_rows(spark, mem):
    """A block is one row of the index; nothing is exploded, and what is shuffled are the rows that tasks hand on."""
    held, stats = postings.build(mem, 20)
    assert held.count() == 16
    asks = spark.createDataFrame([(f"q{i}", "w1 w2 harbour") for i in range(9)], "q_id string, text string")
    plan = postings.search(asks, mem, held.checkpoint(), stats, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Join") == 1


def test_words_of_few_pairs_are_added_together(monkeypatch):
    rng = np.random.default_rng(8)
    asked, held = rng.random((20, 30)) * (rng.random((20, 30)) < 0.2), rng.random((30, 15)) * (rng.random((30, 15)) < 0.3)
    w, q = np.nonzero(asked.T)
    for lone, at_once in ((0, 9), (1 << 20, 9), (1 << 20, 1 << 20), (20, 50)):
        monkeypatch.setattr(lexical, "LONE", lone)
        monkeypatch.setattr(lexical, "AT_ONCE", at_once)
        monkeypatch.setattr(lexical, "DENSE", 2)
        assert np.allclose(lexical._product((w, q, asked[q, w]), held, np.count_nonzero(held, axis=1), 20), asked @ held, atol=1e-12)
