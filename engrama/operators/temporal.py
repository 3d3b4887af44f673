"""Validity intervals, supersession and access accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engrama.functions.text import has_cue
from engrama.operators.knn import search

FLOOR = 0.535


def chains(facts: DataFrame, slot: str, at: str, id_: str) -> DataFrame:
    """Adds valid_from, valid_to, supersedes, superseded_by and revision: within a slot each fact closes the one before it, exactly where it opens."""
    order = Window.partitionBy(slot).orderBy(at, id_)
    return facts.withColumns({
        "valid_from": F.col(at), "valid_to": F.lead(at).over(order), "supersedes": F.lag(id_).over(order),
        "superseded_by": F.lead(id_).over(order), "revision": F.row_number().over(order),
    })


def as_of(facts: DataFrame, at: Column) -> DataFrame:
    """Facts that held at a time; intervals are half-open."""
    return facts.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (at < F.col("valid_to"))))


def as_of_join(times: DataFrame, facts: DataFrame, key: str, at: str, opened: str, id_: str, span: str = "30 days") -> DataFrame:
    """times with fact, the facts' row (a struct) that held at each time: the last of the key that opened at or before it (of one time the greatest id_); null where none had.

    Both sides go by (key, period of `span`) and time, so a key's history is cut into periods and no task holds the
    whole of a key; the fact that a period begins with is the last of the periods before, found among one row each.
    Null keys and times have no fact, repeated rows are all returned, and columns may have the same names.
    """
    period = lambda t: F.floor(F.unix_micros(t.cast("timestamp")) / (F.unix_micros(F.lit("1970-01-01").cast("timestamp") + F.expr(f"INTERVAL {span}")) - F.unix_micros(F.lit("1970-01-01").cast("timestamp"))))
    fact = facts.select(F.col(key).alias("_k"), F.col(opened).alias("_at"), F.col(id_).alias("_id"), F.struct(*facts.columns).alias("_f")).where("_k IS NOT NULL AND _at IS NOT NULL").withColumn("_p", period(F.col("_at")))
    ask = times.select(F.col(key).alias("_k"), F.col(at).alias("_at"), F.struct(*times.columns).alias("_t")).withColumn("_p", period(F.col("_at")))
    known = ask.where("_k IS NOT NULL AND _at IS NOT NULL")
    lasts = fact.groupBy("_k", "_p").agg(F.max_by("_f", F.struct("_at", "_id")).alias("_l"))
    periods = lasts.join(known.select("_k", "_p").distinct(), ["_k", "_p"], "full")
    before = F.last("_l", True).over(Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))  # one row per key and period
    carried = periods.withColumn("_c", before).select("_k", "_p", "_c")
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    both = fact.select("_k", "_p", "_at", "_id", "_f", none(ask, "_t")).unionByName(known.select("_k", "_p", "_at", none(fact, "_id"), none(fact, "_f"), "_t"))
    order = Window.partitionBy("_k", "_p").orderBy("_at", F.col("_t").isNotNull(), "_id").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("_h", F.last("_f", True).over(order)).where(F.col("_t").isNotNull()).join(carried, ["_k", "_p"], "left")
    out = held.select("_t", F.coalesce("_h", "_c").alias("fact")).unionByName(ask.where("_k IS NULL OR _at IS NULL").select("_t", F.lit(None).cast(fact.schema["_f"].dataType).alias("fact")))
    return out.select(*[F.col("_t")[c].alias(c) for c in times.columns], "fact")


def supersession_targets(new: DataFrame, current: DataFrame, floor: float = FLOOR) -> DataFrame:
    """(q_id, id, sim): for each new memory (id, text, embedding) that announces a change, the most similar current one at or above floor; ties go to the earlier."""
    asking = new.where(F.col("embedding").isNotNull() & has_cue(F.col("text"))).select(F.col("id").alias("q_id"), "embedding")
    return search(asking, current, 1, gate=floor).select("q_id", "id", "sim")


def supersede(memories: DataFrame, targets: DataFrame, at: Column) -> DataFrame:
    """memories with each target closed at `at` by its successor, and the successors linked back. One commit carries both changes."""
    closing = targets.groupBy("id").agg(F.min("q_id").alias("_by"))
    opening = targets.select(F.col("q_id").alias("id"), F.col("id").alias("_old"))
    revisions = memories.select(F.col("id").alias("_old"), (F.col("revision") + 1).alias("_rev"))
    out = memories.join(closing, "id", "left").join(opening.join(revisions, "_old"), "id", "left")
    closed, opened = F.col("_by").isNotNull(), F.col("_old").isNotNull()
    return out.withColumns({
        "valid_to": F.when(closed, at).otherwise(F.col("valid_to")), "superseded_by": F.when(closed, F.col("_by")).otherwise(F.col("superseded_by")),
        "modified": F.when(closed, at).otherwise(F.col("modified")), "supersedes": F.when(opened, F.col("_old")).otherwise(F.col("supersedes")),
        "revision": F.when(opened, F.col("_rev")).otherwise(F.col("revision")).cast("int"),
    }).select(*memories.columns)


def restatements(new: DataFrame, current: DataFrame) -> DataFrame:
    """(new_id, id): the first current memory with exactly the text of a new one."""
    first = current.groupBy("text").agg(F.min_by("id", "_pos").alias("id"))
    return new.select(F.col("id").alias("new_id"), "text").join(first, "text").select("new_id", "id")


def access_counts(log: DataFrame) -> DataFrame:
    """(id, n, last) of an access log (id, at)."""
    return log.groupBy("id").agg(F.count("*").alias("n"), F.max("at").alias("last"))


def fold_access(memories: DataFrame, counts: DataFrame) -> DataFrame:
    """memories with counts added to what they stored; importance becomes the count of those that were accessed."""
    got = counts.select("id", F.col("n").alias("_n"), F.col("last").alias("_last"))
    total = F.coalesce("access_count", F.lit(0)) + F.coalesce("_n", F.lit(0))
    return memories.join(got, "id", "left").withColumns({
        "access_count": total.cast("long"), "last_access": F.coalesce("_last", "last_access"),
        "importance": F.when(F.col("_n").isNotNull(), total.cast("double")).otherwise(F.col("importance")),
    }).select(*memories.columns)


def prune_access(counts: DataFrame, memories: DataFrame) -> DataFrame:
    """counts of ids that still exist."""
    return counts.join(memories.select("id"), "id", "left_semi")


def patch(memories: DataFrame, patches: DataFrame) -> DataFrame:
    """memories with the non-null columns of patches (keyed by id, unique) put in; every row of an id is patched, deleted ones too."""
    names = [c for c in patches.columns if c != "id"]
    got = patches.select("id", *[F.col(c).alias(f"_new_{c}") for c in names])
    return memories.join(got, "id", "left").withColumns({c: F.coalesce(f"_new_{c}", c) for c in names}).select(*memories.columns)


def next_id(memories: DataFrame, now_ms: Column) -> DataFrame:
    """(next_id): now in milliseconds, or one more than the largest numeric id if that is not smaller."""
    return memories.agg(F.max(F.expr("try_cast(id AS BIGINT)")).alias("m")).select(F.greatest(now_ms.cast("long"), F.coalesce("m", F.lit(0)) + 1).alias("next_id"))


def backfill(memories: DataFrame, vectors: DataFrame) -> DataFrame:
    """memories with vectors (id, embedding) put in where they had none."""
    got = vectors.select("id", F.col("embedding").alias("_v"))
    return memories.join(got, "id", "left").withColumn("embedding", F.coalesce("embedding", "_v")).select(*memories.columns)


def vacuum(memories: DataFrame) -> DataFrame:
    """memories without the removed ones."""
    return memories.where(~F.col("deleted"))
