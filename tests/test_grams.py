"""The index of grams against a search through all texts."""

import random

import pytest
from pyspark.sql import functions as F

from engrama import queries
from engrama.operators import grams, recall

SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted((r["q_id"], r["rnk"], r["id"], round(r["score"], 9)) for r in df.collect())


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(1)
    words = ["sea", "seaside", "a", "of", "under_way", "x1", "overseas", "Ärger", "STONE", "stones", "lastone"]
    texts = [None, "", "!?", *(" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(60))]
    return spark.createDataFrame([(f"m{i}", i * 1500 + 7, t) for i, t in enumerate(texts)], "id string, _pos long, text string").cache()


@pytest.mark.parametrize("matrix", [64 << 20, 1 << 16])
def test_equal_to_a_search_through_all_texts(spark, small, monkeypatch, matrix):
    monkeypatch.setattr(grams, "MATRIX", matrix)
    asked = ["sea", "of stone", "under_way a", "nothing here", "", None, "!!", "ton sid", "Stones OVERSEAS x1", "zzzz"]
    asks = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(asked)], "q_id string, text string")
    postings = grams.build(small).cache()
    for k in (1, 5):
        assert rows(grams.keyword_recall(asks, small, postings, k)) == rows(recall.keyword_recall(asks, small, k))


def test_words_between_grams_are_verified(spark):
    """All grams of a word can stand in a text that does not hold it."""
    mem = spark.createDataFrame([("a", 0, "abcx bcde"), ("b", 1, "abcde")], "id string, _pos long, text string")
    postings = grams.build(mem)
    held = {(r["word"], r["bucket"]) for r in grams.holding(["abcde"], mem, postings).collect()}
    assert held == {("abcde", 0)}
    got = grams.keyword_recall(spark.createDataFrame([("q", "abcde")], "q_id string, text string"), mem, postings, 5)
    assert [(r["id"], r["score"]) for r in got.collect()] == [("b", 1.0)]
    assert grams.reads(spark.createDataFrame([("q", "abcde"), ("r", "abc")], "q_id string, text string"), postings).orderBy("q_id").collect() == [("q", 2), ("r", 0)]


def test_persisted_and_read_in_part(spark, tmp_path):
    """A written index answers as a fresh one, its filter on grams reaches the files, and few memories are read for rare words."""
    mem = queries.memories(spark, SF).select("id", "_pos", "text")
    grams.write(grams.build(mem), str(tmp_path / "i"))
    postings = spark.read.parquet(str(tmp_path / "i"))
    asks = mem.where("_pos % 50 = 0").select(F.col("id").alias("q_id"), F.substring("text", 1, 60).alias("text"))
    assert rows(grams.keyword_recall(asks, mem, postings, 5)) == rows(recall.keyword_recall(asks, mem))
    rare = spark.createDataFrame([("q", "apache licensed hunter2hunter2")], "q_id string, text string")
    read, hits = grams.reads(rare, postings).first()["memories"], mem.where("lower(text) LIKE '%apache%' OR lower(text) LIKE '%licensed%'").count()
    assert hits <= read < mem.count() / 4


def test_no_memories(spark, small):
    none = small.where("false")
    asks = spark.createDataFrame([("q", "sea")], "q_id string, text string")
    assert grams.keyword_recall(asks, none, grams.build(none), 5).count() == 0
    assert grams.keyword_recall(asks.where("false"), small, grams.build(small), 5).count() == 0


def test_words_and_memories_do_not_meet_as_rows(spark, small, monkeypatch):
    """Each bucket's bitmaps and texts meet in one task, and nothing is exploded, by the build or the search; several buckets of a task give the same."""
    asks = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(["overseas stones", "a of", "zzzz"])], "q_id string, text string")
    postings = grams.build(small)
    found = grams.keyword_recall(asks, small, postings, 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("FlatMapCoGroupsInArrow") == 1
    monkeypatch.setattr(grams, "TASKS", 4)
    assert rows(grams.keyword_recall(asks, small, postings, 3)) == rows(found) == rows(recall.keyword_recall(asks, small, 3))
