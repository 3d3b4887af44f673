"""JSON Lines stores, sidecar files and the embedding cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engrama.functions.text import content_hash
from engrama.schema import MEMORY, normalise


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def read_store(spark: SparkSession, path: str, as_of: Column) -> DataFrame:
    """Memories of a JSON Lines file, with _pos in file order. A missing file is an empty store; bad lines are skipped."""
    if not _exists(spark, path):
        return spark.createDataFrame([], MEMORY).withColumn("_pos", F.lit(0).cast("long"))
    lines = spark.read.text(path).where("value <> ''").withColumn("_pos", F.monotonically_increasing_id())
    return normalise(lines, as_of)


def read_corpus(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Evaluation cases; unlike a store, a bad line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def last_per_id(records: DataFrame) -> DataFrame:
    """One row per id, the last in file order."""
    names = [c for c in records.columns if c not in ("id", "_pos")]
    best = records.groupBy("id").agg(F.max_by(F.struct("_pos", *names), "_pos").alias("r"))
    return best.select("id", "r.*")


def lookup(records: DataFrame, id_: object) -> DataFrame:
    """The first row with an id, deleted or not."""
    return records.where(F.col("id") == F.lit(str(id_))).orderBy("_pos").limit(1)


def read_access(spark: SparkSession, path: str) -> DataFrame:
    """(id, n, last) of an access sidecar {"counts": {id: {n, last}}}; a missing or corrupt file counts nothing."""
    schema = "counts map<string, struct<n: bigint, last: timestamp>>"
    rows = _whole(spark, path).select(F.from_json("value", schema).alias("j"))
    return rows.select(F.explode("j.counts").alias("id", "v")).select("id", "v.n", "v.last")


def read_ledger(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b, w) and (recalls) of a ledger file {"recalls": n, "edges": {"a:b": w}}."""
    rows = _whole(spark, path).select(F.from_json("value", "recalls bigint, edges map<string, double>").alias("j"))
    edges = rows.select(F.explode("j.edges").alias("key", "w")).select(F.split_part("key", F.lit(":"), F.lit(1)).alias("a"), F.split_part("key", F.lit(":"), F.lit(2)).alias("b"), "w")
    return edges, rows.agg(F.coalesce(F.max("j.recalls"), F.lit(0)).alias("recalls"))


def write_access(counts: DataFrame, path: str) -> None:
    """The sidecar of access counts (id, n, last) as one JSON object in a folder of one file, which read_access() reads; replaced whole. A sidecar is small by design: a store consolidates it."""
    entry = F.struct("id", F.struct("n", "last"))
    counts.agg(F.to_json(F.struct(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("counts"))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_ledger(edges: DataFrame, recalls: int, path: str) -> None:
    """A ledger (a, b, w) and its recalls as one JSON object, which read_ledger() reads; replaced whole."""
    entry = F.struct(F.concat_ws(":", "a", "b"), "w")
    edges.agg(F.to_json(F.struct(F.lit(recalls).alias("recalls"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("edges"))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True) if _exists(spark, path) else spark.createDataFrame([], "value string")


def cached_embeddings(texts: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """texts with the cache's (hash, embedding), and the distinct texts that it lacks."""
    keyed = texts.withColumn("hash", content_hash(F.col("text")))
    return keyed.join(cache.select("hash", "embedding"), "hash", "left"), keyed.select("hash", "text").distinct().join(cache, "hash", "left_anti")
