"""Scopes, tiers and sessions: who sees a memory, how long it stays, and what makes it lasting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engrama.functions.text import bounded
from engrama.operators.graph import components
from engrama.operators.knn import BLOCK, _matrix

# What marks a memory as passing or lasting.
TRANSIENT = r"(?i)\b(right now|currently|today|this (morning|afternoon|week)|working on|debugging|about to|in a meeting)\b"
DURABLE = r"(?i)\b(always|never|i am|i'?m allergic|i prefer|my (wife|husband|dog|cat|kid|son|daughter)|remember that)\b"
TTL_DAYS = 7
SAME = 0.9
#: A product of unit rows that comes so near to a limit does not say on which side of it a cosine lies.
EVEN = 1e-12


def initial_tier(text: Column) -> Column:
    """long_term, unless a text is marked as passing and not as lasting."""
    return F.when(F.coalesce(text.rlike(bounded(DURABLE)), F.lit(False)), "long_term").when(F.coalesce(text.rlike(bounded(TRANSIENT)), F.lit(False)), "session").otherwise("long_term")


def visible(memories: DataFrame, scope: str, session: str | None, include_session: bool = True) -> DataFrame:
    """Memories (scope, tier, session_id) of a scope that a session sees: the lasting ones, and of the passing ones its own."""
    own = (F.col("session_id") == F.lit(session)) & F.lit(include_session)
    return memories.where((F.col("scope") == scope) & ((F.col("tier") == "long_term") | F.coalesce(own, F.lit(False))))


def expired_sessions(memories: DataFrame, now: Column, session: str | None, days: int = TTL_DAYS) -> DataFrame:
    """(id, deleted, delete_reason) for passing memories of other sessions that were last confirmed, or else created, over `days` days ago."""
    age = (F.unix_timestamp(now) - F.unix_timestamp(F.coalesce("last_confirmed", "created"))) / 86400
    old = memories.where((F.col("tier") == "session") & (age > days) & ~F.coalesce(F.col("session_id") == F.lit(session), F.lit(False)))
    return old.select("id", F.lit(True).alias("deleted"), F.lit("session_expired").alias("delete_reason"))


def _cosines(vectors: pd.Series, other: np.ndarray) -> np.ndarray:
    """Cosines from sums in the order of the vectors' numbers, as an engine computes them that takes one pair at a time; 0 where a side is a zero vector."""
    a, b = np.stack([np.asarray(v, np.float64) for v in vectors]), np.asarray(other, np.float64)
    total = lambda x: np.add.accumulate(x, axis=1)[:, -1]
    size = np.sqrt(total(a * a) * total((b * b)[None, :]))
    return np.clip(np.divide(total(a * b), size, out=np.zeros(len(a)), where=size > 0), -1.0, 1.0)


def close_links(memories: DataFrame, least: float = SAME) -> DataFrame:
    """(a, b): enough of the pairs of memories at or above a similarity to connect all that are; at most one per memory and pair of blocks."""
    mem = memories.where(F.col("embedding").isNotNull()).select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    n = max(1, -(-mem.count() // BLOCK))
    mine = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    both = mem.withColumn("_b", mine).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    both = both.withColumns({"_lo": F.least("_b", "_o"), "_hi": F.greatest("_b", "_o")})

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(pdf["embedding"])
        left, ids, links = np.ones(len(pdf), bool), pdf["id"].to_numpy(object), []
        while left.any():  # one component after the other
            start = int(np.argmax(left))
            left[start] = False
            front = [start]
            while front:
                at = front.pop()
                sims = m @ m[at]
                even = np.flatnonzero(left & (np.abs(sims - least) <= EVEN))
                if len(even):
                    sims[even] = _cosines(pdf["embedding"].iloc[even], pdf["embedding"].iloc[at])
                near = np.flatnonzero(left & (sims >= least))
                left[near] = False
                links += [(ids[at], ids[x]) for x in near]
                front += near.tolist()
        return pd.DataFrame(links, columns=["a", "b"], dtype=object)

    return both.groupBy("_lo", "_hi").applyInPandas(join, "a string, b string")


def promotions(memories: DataFrame, least: float = SAME, sessions: int = 2) -> DataFrame:
    """(id, tier, promoted_from, deleted): patches for clusters of passing memories (id, text, embedding, tier, session_id) that `sessions` sessions have said: the longest text becomes lasting, the smaller id of equals, and the others go; a null text is shorter than any. One write for all."""
    mine = memories.where((F.col("tier") == "session") & F.col("embedding").isNotNull())
    groups = components(mine.select("id"), close_links(mine, least))
    named = mine.join(groups, "id").select("id", "component", "session_id", F.coalesce(F.length("text"), F.lit(-1)).alias("n"))
    told = named.groupBy("component").agg(F.count_distinct("session_id").alias("s"), F.min_by("id", F.struct(-F.col("n"), F.col("id"))).alias("keep")).where(F.col("s") >= sessions)
    stays = F.col("id") == F.col("keep")
    return named.join(told, "component").select("id", F.when(stays, "long_term").alias("tier"), F.when(stays, "session").alias("promoted_from"), (~stays).alias("deleted"))
