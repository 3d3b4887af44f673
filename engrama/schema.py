"""The memory record, and how older shapes of it are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engrama.functions.text import is_constraint

MEMORY = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("created", T.TimestampType()),
    T.StructField("modified", T.TimestampType()),
    T.StructField("text", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.DoubleType())),
    T.StructField("importance", T.DoubleType()),
    T.StructField("access_count", T.LongType()),
    T.StructField("last_access", T.TimestampType()),
    T.StructField("valid_from", T.TimestampType()),
    T.StructField("valid_to", T.TimestampType()),
    T.StructField("last_confirmed", T.TimestampType()),
    T.StructField("superseded_by", T.StringType()),
    T.StructField("supersedes", T.StringType()),
    T.StructField("revision", T.IntegerType()),
    T.StructField("needs_review", T.BooleanType()),
    T.StructField("source", T.StringType()),
    T.StructField("is_constraint", T.BooleanType()),
    T.StructField("deleted", T.BooleanType()),
])


def _json(path: str, raw: Column) -> Column:
    return F.try_variant_get(raw, f"$.{path}", "variant")


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _number(value: Column, default: float, kind: str) -> Column:
    """Numbers only; a number in a string is not one."""
    is_number = _kind(value).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)")
    return F.when(is_number, F.try_variant_get(value, "$", "double")).otherwise(F.lit(default)).cast(kind)


def _text(value: Column) -> Column:
    """null, the empty string, false and zero count as absent."""
    s = F.try_variant_get(value, "$", "string")
    return F.when(~s.isin("", "false", "0"), s)


def _time(value: Column) -> Column:
    return F.try_to_timestamp(_text(value))


def _truth(value: Column) -> Column:
    s = F.try_variant_get(value, "$", "string")
    return F.coalesce(~s.isin("", "false", "0") & (_kind(value) != "VOID"), F.lit(False))


def normalise(lines: DataFrame, as_of: Column, raw: str = "value") -> DataFrame:
    """Memory records, in MEMORY's columns and _pos, from lines of JSON (columns raw and _pos). Lines that do not parse to an object are skipped.

    as_of stands in where a record has no time at all.
    """
    doc = lines.withColumn("_v", F.try_parse_json(raw)).where(F.col("_v").isNotNull() & F.startswith(_kind(F.col("_v")), F.lit("OBJECT")))
    get = lambda name: _json(name, F.col("_v"))
    as_id = lambda name: F.try_variant_get(get(name), "$", "string")
    created = F.coalesce(_time(get("created")), _time(get("ts")), as_of)
    doc = doc.withColumns({"_created": created, "_modified": F.coalesce(_time(get("modified")), created)})
    text = F.try_variant_get(get("text"), "$", "string")
    return doc.select(
        as_id("id").alias("id"), F.col("_created").alias("created"), F.col("_modified").alias("modified"), text.alias("text"),
        F.when(F.startswith(_kind(get("embedding")), F.lit("ARRAY")), F.try_variant_get(get("embedding"), "$", "array<double>")).alias("embedding"),
        _number(get("importance"), 0.0, "double").alias("importance"), _number(get("access_count"), 0, "long").alias("access_count"),
        _time(get("last_access")).alias("last_access"), F.coalesce(_time(get("valid_from")), F.col("_created")).alias("valid_from"),
        _time(get("valid_to")).alias("valid_to"), F.coalesce(_time(get("last_confirmed")), F.col("_modified")).alias("last_confirmed"),
        as_id("superseded_by").alias("superseded_by"), as_id("supersedes").alias("supersedes"), _number(get("revision"), 1, "int").alias("revision"),
        _truth(get("needs_review")).alias("needs_review"), F.coalesce(_text(get("source")), F.lit("user_stated")).alias("source"),
        F.when(_kind(get("is_constraint")) == "BOOLEAN", F.try_variant_get(get("is_constraint"), "$", "boolean")).otherwise(is_constraint(text)).alias("is_constraint"),
        _truth(get("deleted")).alias("deleted"), "_pos",
    )
