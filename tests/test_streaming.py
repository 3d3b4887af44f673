from datetime import datetime, timedelta

from engrama.operators import ledger
from engrama.plans.store import MemoryStore
from engrama.streaming import streams
from pyspark.sql import functions as F


def run(spark, df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def source(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def test_access_stream_equals_batch(spark, tmp_path):
    t = datetime(2024, 1, 1)
    log = source(spark, tmp_path, [("a", t), ("a", t + timedelta(seconds=5)), ("b", t)], "id string, at timestamp")
    got = {r["id"]: r["n"] for r in run(spark, streams.access_stream(log), "access", "complete").collect()}
    assert got == {"a": 2, "b": 1}


def test_sessions(spark, tmp_path):
    t = datetime(2024, 1, 1)
    log = source(spark, tmp_path, [("a", t), ("a", t + timedelta(seconds=5)), ("a", t + timedelta(seconds=60)), ("a", t + timedelta(hours=1))], "id string, at timestamp")
    assert sorted(r["n"] for r in streams.sessions(log.select("id", "at")).transform(lambda d: run(spark, d, "sessions", "append")).collect()) == [1, 2]  # the watermark has not passed the last one


def test_ledger_stream_equals_fold(spark, tmp_path):
    rows = [("a", "b", t, 0.1) for t in (1, 2, 15, 99)] + [("a", "c", t, 0.02) for t in (3, 44)]
    bumps = source(spark, tmp_path, rows, "a string, b string, t long, alpha double")
    got = {(r["a"], r["b"]): round(r["w"], 9) for r in run(spark, streams.ledger_stream(bumps), "ledger", "update").collect()}
    upto = lambda t: ledger.decay_fold(spark.createDataFrame(rows, "a string, b string, t long, alpha double").where(F.col("t") <= t), F.lit(t))
    want = {(r["a"], r["b"]): round(r["w"], 9) for r in upto(99).collect()}
    assert got[("a", "b")] == want[("a", "b")]
    # a weight is told as of the pair's own last epoch; brought forward it is the fold's
    assert got[("a", "c")] == round(upto(44).where("b = 'c'").first()["w"], 9)


def test_windowed_counts(spark, tmp_path):
    t = datetime(2024, 1, 1)
    log = source(spark, tmp_path, [(t,), (t + timedelta(minutes=4),), (t + timedelta(minutes=6),), (t + timedelta(hours=1),)], "at timestamp")
    assert [(r["start"], r["n"]) for r in run(spark, streams.windowed_counts(log), "windows", "append").orderBy("start").collect()] == [(t, 2), (t + timedelta(minutes=5), 1)]


def test_save_stream(spark, tmp_path):
    t = datetime(2024, 1, 1)
    texts = source(spark, tmp_path, [(t, "I like tea"), (t + timedelta(seconds=1), "I like mate"), (t + timedelta(seconds=2), "I like tea")], "at timestamp, text string")
    store = MemoryStore(spark, str(tmp_path / "m"))
    streams.save_stream(texts, store, str(tmp_path / "c")).awaitTermination(120)
    assert [r["text"] for r in store.read().orderBy("_pos").collect()] == ["I like tea", "I like mate"]


def test_faded_edges_leave_the_state(spark, tmp_path):
    """As recalls go on, weak edges fall under the floor: each comes out with weight 0 and its key is dropped; the others stay as the fold has them."""
    rows = [("a", "b", t, 0.1) for t in range(1, 30)] + [("a", "c", 3, 0.06), ("b", "c", 4, 0.05)]
    schema = "a string, b string, t long, alpha double"
    path = tmp_path / "in"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path))
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))
    q = streams.ledger_stream(log, prune=True).writeStream.outputMode("update").format("memory").queryName("fading").start()
    try:
        q.processAllAvailable()
        before = q.lastProgress["stateOperators"][0]["numRowsTotal"]
        for t in (60, 61, 62):
            spark.createDataFrame([("a", "b", t, 0.1)], schema).coalesce(1).write.mode("append").parquet(str(path))
            q.processAllAvailable()
        after = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        q.stop()
    got = spark.table("fading").collect()
    assert {(r["a"], r["b"]) for r in got if r["w"] == 0} == {("a", "c"), ("b", "c")}
    assert after < before
    everything = spark.createDataFrame([*rows, *(("a", "b", t, 0.1) for t in (60, 61, 62))], schema)
    want = ledger.decay_fold(everything, F.lit(62)).collect()
    assert [(r["a"], r["b"]) for r in want] == [("a", "b")]
    assert round(max((r["e"], r["w"]) for r in got if r["b"] == "b")[1], 9) == round(want[0]["w"], 9)
