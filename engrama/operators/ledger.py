"""The co-activation ledger: weights that grow with joint recalls and decay by epoch.

A bump at recall t is decayed at every full epoch from t on. Weights that
fall under the floor after a decay start again from nothing, so each pair is
folded over its epochs; pairs are independent, recalls are one clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engrama.functions.text import snippet
from engrama.functions.vector import MAX_BONUS, cosine, pair

# How weights grow and fade.
ALPHA_PRIMARY, ALPHA_RELATED = 0.1, 0.02
BETA, FLOOR, EPOCH = 0.95, 0.05, 10


def bumps(recalls: DataFrame, *keys: str) -> DataFrame:
    """(a, b, t, alpha) of each pair that a recall (t, id, role) brings up: two primary rows, or a primary and a related one. A recall returns a bounded list, so pairs are made inside it. keys: columns that tell recalls with one t apart."""
    lists = recalls.groupBy("t", *keys).agg(F.array_sort(F.collect_set(F.struct("id", "role"))).alias("_list"))
    primary = F.filter("_list", lambda x: x["role"] == "primary")
    related = F.filter("_list", lambda x: x["role"] != "primary")
    strong = F.flatten(F.transform(primary, lambda x, i: F.transform(F.slice(primary, i + 2, F.size(primary)), lambda y: F.struct(x["id"].alias("x"), y["id"].alias("y"), F.lit(ALPHA_PRIMARY).alias("alpha")))))
    weak = F.flatten(F.transform(primary, lambda x: F.transform(related, lambda y: F.struct(x["id"].alias("x"), y["id"].alias("y"), F.lit(ALPHA_RELATED).alias("alpha")))))
    each = lists.select("t", F.explode(F.concat(strong, weak)).alias("p")).where("p.x <> p.y")
    a, b = pair(F.col("p.x"), F.col("p.y"))
    return each.select(a.alias("a"), b.alias("b"), "t", F.col("p.alpha").alias("alpha"))


def coactivation(bumps_: DataFrame) -> DataFrame:
    """(a, b, w) without decay."""
    return bumps_.groupBy("a", "b").agg(F.sum("alpha").alias("w"))


def _decayed(w: Column, epochs: Column) -> Column:
    faded = w * F.pow(F.lit(BETA), epochs)
    return F.when((epochs > 0) & (faded < FLOOR), F.lit(0.0)).otherwise(faded)


def fold_state(bumps_: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """(a, b, w, e): each pair's weight as of e, the epoch in which it was last touched, from the state (a, b, w, e) of earlier bumps and later ones.

    A bump of an epoch before its pair's state counts in the state's epoch. Only the state's
    pairs and the new bumps are read, so a store folds its tail into a snapshot and never its whole history.
    """
    epoch = F.floor((F.col("t") - 1) / EPOCH)
    rows = bumps_.groupBy("a", "b", epoch.alias("e")).agg(F.sum("alpha").alias("s")).withColumn("had", F.lit(False))
    if state is not None:
        rows = rows.unionByName(state.select("a", "b", "e", F.col("w").alias("s"), F.lit(True).alias("had")))
    lists = rows.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct((~F.col("had")).alias("late"), "e", "s"))).alias("h"))
    start = F.struct(F.lit(0).cast("long").alias("e"), F.lit(0.0).alias("w"))
    step = lambda acc, x: F.struct(F.greatest(x["e"], acc["e"]).alias("e"), (_decayed(acc["w"], F.greatest(x["e"] - acc["e"], F.lit(0))) + x["s"]).alias("w"))
    return lists.select("a", "b", F.aggregate("h", start, step).alias("z")).select("a", "b", "z.w", "z.e")


def as_of(state: DataFrame, recalls: Column) -> DataFrame:
    """(a, b, w, e) of a state after `recalls` recalls, w brought forward; pairs that were pruned by then are gone. A weight that is not touched only falls, so one test at the end of a gap is exact."""
    return state.select("a", "b", _decayed(F.col("w"), F.floor(recalls / EPOCH) - F.col("e")).alias("now"), "w", "e").where("now > 0").select("a", "b", F.col("now").alias("w"), "e")


def decay_fold(bumps_: DataFrame, recalls: Column) -> DataFrame:
    """(a, b, w) after `recalls` recalls; pairs that were pruned and not met again are gone."""
    return as_of(fold_state(bumps_), recalls).drop("e")


def telemetry(ledger: DataFrame) -> DataFrame:
    """One row: edges, weak (under 0.1), strong (0.5 and more), and the extremes."""
    w = F.col("w")
    return ledger.agg(F.count("*").alias("edges"), F.count_if(w < 0.1).alias("weak"), F.count_if(w >= 0.5).alias("strong"), F.max(w).alias("max_w"), F.avg(w).alias("avg_w"), F.min(w).alias("min_w"))


def beside(ledger: DataFrame, memories: DataFrame) -> DataFrame:
    """Edges (a, b, w) with snippets of both memories and their plain similarity, null where one is gone or has no vector."""
    side = lambda name: memories.select(F.col("id").alias(name), snippet(F.col("text")).alias(f"text_{name}"), F.col("embedding").alias(f"v_{name}"))
    out = ledger.join(side("a"), "a", "left").join(side("b"), "b", "left")
    both = F.col("v_a").isNotNull() & F.col("v_b").isNotNull()
    return out.select("a", "b", "w", F.when(both, cosine(F.col("v_a"), F.col("v_b"))).alias("cos"), "text_a", "text_b")


def strongest(ledger: DataFrame, memories: DataFrame, k: int = 5) -> DataFrame:
    """The k heaviest edges."""
    return beside(ledger.orderBy(F.desc(F.round("w", 9)), "a", "b").limit(k), memories)  # a report of k rows


def leaps(ledger: DataFrame, memories: DataFrame, k: int = 5, most: float = 0.55) -> DataFrame:
    """The k heaviest edges between memories less similar than `most`."""
    return beside(ledger, memories).where(F.col("cos") < most).orderBy(F.desc(F.round("w", 9)), "a", "b").limit(k)  # a report of k rows


def timescale(pairs: DataFrame, gate: float = 0.55, most_recalls: int = 60, most_epochs: int = 500) -> DataFrame:
    """For each pair (pair, cos): learn, the joint recalls until cos and bonus reach the gate, and forget, the recalls until decay takes it under again. null where neither comes within the limits."""
    bonus = lambda w: F.lit(MAX_BONUS) * F.tanh(w)
    faded = lambda n: F.col("learn") * ALPHA_PRIMARY * F.pow(F.lit(BETA), n)
    # what a pair gains depends on numbers of recalls and epochs alone, so it is computed once for each and not for each pair
    learnt = pairs.sparkSession.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(most_recalls)), lambda n: bonus(n * ALPHA_PRIMARY)).alias("_gains"))
    fades = pairs.sparkSession.range(1, most_recalls + 1).select(F.col("id").cast("int").alias("learn")).select("learn", F.transform(F.sequence(F.lit(1), F.lit(most_epochs)), lambda n: bonus(F.when(faded(n) < FLOOR, 0.0).otherwise(faded(n)))).alias("_fades"))
    first = lambda gains, passes: F.nullif(F.array_position(F.transform(gains, lambda g: passes(F.col("cos") + g)), True), F.lit(0)).cast("int")
    out = pairs.crossJoin(F.broadcast(learnt)).withColumn("learn", first("_gains", lambda x: x >= gate)).drop("_gains")
    out = out.join(F.broadcast(fades), "learn", "left").withColumn("forget", first("_fades", lambda x: x < gate) * EPOCH)  # most_recalls rows
    return out.select(*pairs.columns, "learn", "forget")
