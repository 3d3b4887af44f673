"""Ranked recall and its lexical fallback, for a batch of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrama.functions.text import listing_line, tokens
from engrama.operators import lexical
from engrama.operators.knn import search

RETURNED, SEEDS = 5, 15


def in_scope(memories: DataFrame, historical: bool) -> DataFrame:
    """Live memories; those that no longer hold only for historical queries."""
    live = memories.where(~F.col("deleted"))
    return live if historical else live.where(F.col("valid_to").isNull())


def recall(queries: DataFrame, memories: DataFrame, seeds: int = SEEDS, within: str | None = None) -> DataFrame:
    """(q_id, rnk, id, sim) of the `seeds` best of each query's scope; the first RETURNED are its answer. queries: q_id, embedding, historical."""
    out = None
    for historical in (False, True):
        part = search(queries.where(F.col("historical") == historical).drop("historical"), in_scope(memories, historical), seeds, within=within)
        out = part if out is None else out.unionByName(part)
    return out


def keyword_recall(queries: DataFrame, memories: DataFrame, k: int = RETURNED) -> DataFrame:
    """(q_id, rnk, id, score) by share of query words found; best first, ties by place. Without any hit a query still gets its first row.

    queries: q_id, text. Each block of queries is one pass over the memories, which are not shuffled.
    """
    asked = queries.select(F.col("q_id").cast("string").alias("q_id"), tokens(F.col("text")).alias("tok"))
    parts = [lexical.ranked(block, {}, True, memories, lexical.inside, k, 12) for block in lexical.query_blocks(asked)]
    best = lexical.top(parts, k, 12)
    return best.where((F.col("score") > 0) | (F.col("rnk") == 1))


def listing(ranked: DataFrame, memories: DataFrame, related: DataFrame | None = None, k: int = RETURNED) -> DataFrame:
    """(q_id, listing): the answer as text, with related memories below."""
    mem = memories.select("id", "text", "valid_to")
    lines = ranked.where(F.col("rnk") <= k).join(mem, "id").select("q_id", F.struct("rnk", listing_line(F.col("rnk"), F.col("id"), F.col("text"), F.col("valid_to")).alias("line")).alias("l"))
    out = lines.groupBy("q_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("listing"))
    if related is None:
        return out
    more = related.join(mem, "id").select("q_id", F.struct("rnk", F.concat(F.lit("- [id "), "id", F.lit("] "), "text").alias("line")).alias("l"))
    more = more.groupBy("q_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("more"))
    return out.join(more, "q_id", "left").select("q_id", F.concat("listing", F.when(F.col("more").isNull(), "").otherwise(F.concat(F.lit("\n\nRelated:\n"), "more"))).alias("listing"))
