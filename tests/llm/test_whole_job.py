"""Queries as registered, on tables that show whether they do the whole job."""

import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from engrama.llm import oracle, pii, queries, reshard
from test_llm_small import brute_removed

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_short_lines_are_deduplicated(spark, tmp_path):
    """Repeats of short lines, four words inside five, lines that cycle through few words; unequal short ones stay."""
    texts = ["Menu\nAll rights reserved.\n\na b c d", "Menu\n \na b c d e\nall rights reserved.", "a b c\nx y x y x y\nMenu Menu", "y x\na b\nAll rights reserved.\na b c", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op6_line_dedup(spark, str(tmp_path)).collect()))
    assert got == brute_removed(list(enumerate(texts)), least=1)
    assert [r[3] for r in got] == ["", "0,2", "2", "0,2,3", "", ""]
    left = {r["doc_id"]: r["text"] for r in dict(corpus_pipeline.STAGES)["line dedup"](spark, docs, "").collect()}
    assert left == {0: texts[0], 1: " \nall rights reserved.", 2: "a b c\nx y x y x y", 3: "a b", 4: None, 5: ""}


def test_short_lines_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(oracle.OP6).fetchall()
    assert sorted(map(tuple, queries.op6_line_dedup(spark, sf).collect())) == sorted(want)


@pytest.mark.parametrize(
    "kind,text",
    [
        ("email", "john@example dot com"),
        ("email", "john(@)example.com"),
        ("email", "john [ @ ] example{.}com"),
        ("email", "john at example.com"),
        ("email", "john @ example.com"),
        ("email", "john dot smith at mail dot com"),
        ("email", "john(dot)smith at mail dot example[.]com"),
        ("email", "jоhn dot smith arroba exаmple punto com"),
        ("ip", "192 dot 168 dot 0 dot 1"),
        ("ip", "192[.]168[.]0[.]1"),
        ("ip", "192(dot)168[punkt]0 dot 1"),
        ("ip", "one nine two dot one six eight dot zero dot one"),
        ("ip", "one nine two.one six eight.zero.one"),
        ("ip", "1 9 2 dot one six eight [.] zero dot 1"),
        ("phone", "plus one 555 123 4567"),
        ("phone", "555 one two three four five six seven"),
        ("email", "john_at_example_dot_com"),
        ("email", "john_dot_smith@example.com"),
        ("card", "4012 eight eight eight eight 8888 one eight eight one"),
    ],
)
def test_each_disguise_is_found_whole(kind, text):
    lead, tail = "write to: ", ", or not"
    spans = pii.find(lead + text + tail)[1]
    assert (kind, len(lead), len(lead) + len(text)) in spans
    assert pii.mask(lead + text + tail) == f"{lead}<{kind}>{tail}"


@pytest.mark.parametrize("text", ["priced at 3.5 dollars", "two dot five", "one point two and three. Four (.) five", "we met at noon. The dot of one two three", "see [at] and (dot)", "chapter 12, 13 and one", "one of the years 2019, 2020, 2021, 2022, 2023", "un 12, 13, 14, 15, 16, 17"])
def test_no_disguise(text):
    assert pii.find(text)[1] == []


def test_a_long_text_of_addresses_takes_linear_time():
    import time

    text = "a@b.cd, c at d dot ef; " * 4000
    began = time.process_time()
    base, every = pii.find(text)
    assert len(base) == 4000 and len(every) == 8000 and time.process_time() - began < 5


def test_at_before_an_address():
    assert pii.mask("reach him at john.smith at mail dot com now") == "reach <email> now"


def test_second_rewrite_reads_untouched_shards(spark, tmp_path):
    root = str(tmp_path)
    # shard 0 has its share already; 1 and 2 differ
    rows = [(i, "x" * 9, 0 if i < 100 else 1 if i < 260 else 2) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, shard int").write.partitionBy("shard").parquet(f"{root}/v0")
    once = {r["shard"]: r for r in reshard.rewrite(root, 0, 3, spark).collect()}
    assert {s for s, r in once.items() if r["rewritten"]} == {1, 2} and once[0]["path"] == f"{root}/v0/shard=0"
    for version, shards in ((1, 3), (2, 5), (3, 2)):
        out = reshard.rewrite(root, version, shards, spark).collect()
        assert sum(r["rows"] for r in out) == 300 and len(out) == shards
        assert sorted(r["doc_id"] for p in out for r in spark.read.parquet(p["path"]).collect()) == list(range(300))
        assert sorted(r["doc_id"] for r in reshard.stored(root, version + 1, spark).collect()) == list(range(300))


def test_reshard_query_reads_new_files(spark, tmp_path, monkeypatch):
    rows = [(i, None if i % 50 == 0 else f"té {i} " * (i % 30), "s" if i % 3 else f"s{i % 20}") for i in range(400)] + [(7, "same", "s")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op2_reshard(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    for s in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    # a text that is damaged in a new shard shows in its checksum
    whole = reshard.stored
    monkeypatch.setattr(reshard, "stored", lambda root, version, spark_: whole(root, version, spark_).withColumn("text", F.lit("damaged")) if version == 1 else whole(root, version, spark_))
    assert {r["text_crc32"] for r in queries.op2_reshard(spark, str(tmp_path)).collect()} == {zlib.crc32(b"damaged")}
    monkeypatch.undo()
    empty = reshard.resharded(docs.where("false"), F.lit(0), 4, str(tmp_path / "empty"))
    assert empty.count() == 0 and empty.columns == queries.op2_reshard(spark, str(tmp_path)).select("doc_id", "size", "text_crc32", "law", "old_shard", "shard", "slot", "grown_shard").columns


def test_warc_of_urls_of_any_length(spark, tmp_path):
    """URLs of 0 to 100,000 random letters, whose headers go past the first step, before payloads of 0 to 2,000 bytes."""
    import random

    from engrama.llm import warc

    rng = random.Random(2)
    rows = [(i * 10 + j, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n)), "".join(rng.choices("xyz <>&é", k=m)) or None) for i, n in enumerate((0, 100, 900, 1000, 1100, 1200, 3000, 100_000)) for j, m in enumerate((0, 9, 99, 400, 2000))]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "a"))
    whole = {r["page_id"]: (r["url"], bytes(r["payload"]).decode() if r["payload"] is not None else None) for r in warc.read(spark, str(tmp_path / "a")).collect()}
    assert whole == {i: (u, t or "") for i, u, t in rows}
    assert warc.read(spark, str(tmp_path / "a"), payload=False).count() == len(rows)


def test_lines_of_every_length_are_deduplicated_by_default(spark):
    from engrama.llm import line_dedup

    docs = spark.createDataFrame([(1, "All rights reserved."), (2, "All rights reserved.")], "doc_id long, text string")
    assert [r["n_removed"] for r in line_dedup.line_duplicates(docs).orderBy("doc_id").collect()] == [0, 1]


def test_windows_that_many_items_hold_are_not_broadcast(spark):
    """The limit counts the items that windows hold, too; both ways agree."""
    from engrama.llm import decontaminate

    passage = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, passage), (2, "x " + passage + " y"), (3, "none of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(f"i{i}", passage) for i in range(50)], "item_id string, text string")
    rows = lambda limit: sorted(map(tuple, decontaminate.contamination(docs, bench, broadcast_windows=limit).select("doc_id", "n_hit", "n_items", "items_sha256").collect()))
    assert rows(10) == rows(1_000_000) and [r[2] for r in rows(10)] == [50, 50, 0]
