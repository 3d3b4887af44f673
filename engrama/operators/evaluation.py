"""Scoring of recall cases and the gate against a golden scorecard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engrama.functions.text import contains_all, contains_none
from engrama.operators.knn import ranks_of
from engrama.operators.lexical import first_holding


def score(results: DataFrame) -> DataFrame:
    """Adds pass, reasons (array) and first_hit_turn to results: output, contains, excludes (arrays or null), current_only (boolean or null)."""
    output = F.coalesce("output", F.lit(""))
    has, clear = contains_all(F.col("contains"), output), contains_none(F.col("excludes"), output)
    fresh = ~(F.coalesce("current_only", F.lit(False)) & shows_superseded(output))
    reasons = [F.when(~has, F.concat(F.lit("missing "), F.to_json("contains"))), F.when(~clear, F.concat(F.lit("surfaced excluded "), F.to_json("excludes"))), F.when(~fresh, F.lit("drew on a superseded fact"))]
    return results.withColumns({"pass": has & clear & fresh, "reasons": F.filter(F.array(*reasons), lambda r: r.isNotNull()), "first_hit_turn": F.when(has, 1)})


def shows_superseded(output):
    """Whether a listing marks one of its rows as no longer current."""
    return F.coalesce(output.rlike("(?i)no longer current"), F.lit(False))


def with_prefix(cases: DataFrame, prefix: str | None) -> DataFrame:
    """Cases whose id begins with a prefix; all of them without one."""
    return cases if prefix is None else cases.where(F.startswith("id", F.lit(prefix)))


def target_rank(queries: DataFrame, memories: DataFrame, targets: DataFrame) -> DataFrame:
    """(q_id, id, rank): the first memory (by place) other than the query itself whose text holds a query's target term, whatever the case, and its exact rank among all memories, by counting; 0 without such a memory. queries: q_id, embedding; targets: q_id, term; both a stated set."""
    first = first_holding(targets, memories).checkpoint()
    return ranks_of(queries, memories, first)


def quality_figures(ranked: DataFrame, expected: DataFrame, memories: DataFrame, k: int = 5) -> DataFrame:
    """One row: cases, recall_at_k, mrr and staleness_rate. ranked: q_id, rnk, id. expected: q_id, id (one each). Stale are cases whose first row no longer holds."""
    hit = expected.select("q_id", F.col("id").alias("want")).join(ranked.select("q_id", "rnk", F.col("id").alias("want")), ["q_id", "want"], "left")
    first = ranked.where("rnk = 1").join(memories.select("id", F.col("valid_to").isNotNull().alias("old")), "id").select("q_id", "old")
    out = hit.join(first, "q_id", "left")
    return out.agg(F.count("*").alias("cases"), F.avg((F.coalesce("rnk", F.lit(1 << 30)) <= k).cast("double")).alias("recall_at_k"), F.avg(F.coalesce(1 / F.col("rnk"), F.lit(0.0))).alias("mrr"), F.avg(F.coalesce("old", F.lit(False)).cast("double")).alias("staleness_rate"))


def duplicate_rate(near: DataFrame, memories: DataFrame, least: float = 0.95) -> DataFrame:
    """(memories, duplicated, rate): memories that have another at or above a similarity, by their nearest neighbour (q_id, id, sim)."""
    has = near.where(F.col("sim") >= least).select(F.col("q_id").alias("id"), F.lit(1).alias("_h")).distinct()
    out = memories.select("id").join(has, "id", "left").agg(F.count("*").alias("memories"), F.count("_h").alias("duplicated"))
    return out.select("memories", "duplicated", (F.col("duplicated") / F.greatest("memories", F.lit(1))).alias("rate"))


def false_supersessions(memories: DataFrame, still_true: DataFrame) -> DataFrame:
    """(id): memories that were closed though they still hold (ids of still_true)."""
    return memories.where("valid_to IS NOT NULL").join(still_true.select("id"), "id", "left_semi").select("id")


def store_growth(writes: DataFrame, every: int = 100) -> DataFrame:
    """(block, writes, bytes): UTF-8 bytes of texts per `every` writes (_pos from 0)."""
    return writes.groupBy(F.floor(F.col("_pos") / every).alias("block")).agg(F.count("*").alias("writes"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).cast("long").alias("bytes"))


def exact_percentile(values: DataFrame, column: str, q: float, bins: int = 4096) -> float | None:
    """The exact percentile (linear between neighbours) of a column's values that are neither null nor NaN; None without any.

    Histograms narrow the range in which the value lies: they are merged by bin, so no task holds or sorts
    the values, and each pass divides what is left into `bins`; a bin of one value ends it.
    """
    v = F.col(column).cast("double")
    rows = values.select(v.alias("v")).where(v.isNotNull() & ~F.isnan(v))
    n, low, high = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None

    def at(rank: int) -> float:
        lo, hi, left = low, high, rank
        while lo < hi:
            step = F.least(F.floor((F.col("v") - lo) / F.lit(hi - lo) * bins), F.lit(bins - 1))
            found = rows.where(F.col("v").between(lo, hi)).groupBy(step.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect()  # at most `bins` rows
            for r in found:
                if left < r["n"]:
                    break
                left -= r["n"]
            lo, hi = r["lo"], r["hi"]
        return lo

    place = q * (n - 1)
    below = at(int(place))
    return below if place == int(place) else below + (at(int(place) + 1) - below) * (place - int(place))


def latency_p95(log: DataFrame, ms: str = "ms") -> DataFrame:
    """(p95): one row, null for an empty log."""
    return log.sparkSession.createDataFrame([(exact_percentile(log, ms, 0.95),)], "p95 double")


def compare(results: DataFrame, a: str, b: str, even: float = 0.02) -> DataFrame:
    """(kind, a, b, delta, mark): shares of passes (kind, variant, pass) of two variants, per kind and over all, and whether the second is better, worse or even."""
    rate = lambda v: F.avg(F.when(F.col("variant") == v, F.col("pass").cast("double")))
    out = results.where(F.col("variant").isin(a, b)).groupingSets([["kind"], []], "kind").agg(rate(a).alias("a"), rate(b).alias("b"), F.grouping("kind").alias("g"))
    delta = F.col("b") - F.col("a")
    mark = F.when(delta > even, "better").when(delta < -even, "worse").otherwise("even")
    return out.select(F.when(F.col("g") == 1, "all").otherwise(F.col("kind")).alias("kind"), "a", "b", delta.alias("delta"), mark.alias("mark"))


def soak(memories: DataFrame, checkpoints: tuple[int, ...] = (100, 250, 500, 1000)) -> DataFrame:
    """(updates, current, superseded, removed, bytes) of a store (_pos from 0, text, valid_to, deleted) after its first so many writes, and after all of them. Rows are counted between two checkpoints; these few sums then add up."""
    marks = F.array(*map(F.lit, checkpoints))
    step = F.size(F.filter(marks, lambda c: c <= F.col("_pos")))
    live, old = ~F.col("deleted"), F.col("valid_to").isNotNull()
    parts = memories.groupBy(step.alias("s")).agg(F.count_if(live & ~old).alias("current"), F.count_if(live & old).alias("superseded"), F.count_if(~live).alias("removed"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).cast("long").alias("bytes"), F.max("_pos").alias("last"))
    upto = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)  # a row per checkpoint
    end = (F.max("last").over(Window.partitionBy()) + 1).cast("int")
    sums = parts.select("s", *[F.sum(c).over(upto).alias(c) for c in ("current", "superseded", "removed", "bytes")], end.alias("end"))
    return sums.select(F.coalesce(F.get(marks, F.col("s")), "end").cast("int").alias("updates"), "current", "superseded", "removed", "bytes")


def score_repeat(turns: DataFrame) -> DataFrame:
    """(case_id, pass, first_hit_turn): turns (case_id, turn from 1, hit, want). A null want does not matter; a case without any needs a hit in its last turn."""
    out = turns.groupBy("case_id").agg(
        F.min(F.when(F.col("hit"), F.col("turn"))).alias("first_hit_turn"),
        F.bool_and(F.coalesce(F.col("hit") == F.col("want"), F.lit(True))).alias("agrees"),
        F.count("want").alias("wanted"), F.max_by("hit", "turn").alias("last"),
    )
    return out.select("case_id", F.when(F.col("wanted") > 0, F.col("agrees")).otherwise(F.col("last")).alias("pass"), "first_hit_turn")


def signals(shown: DataFrame, expected: DataFrame) -> DataFrame:
    """(case_id, rescued, bled, appended) from the rows of each case's related block (case_id, text): all of contains among them, how many excluded terms, how many rows."""
    block = shown.groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("block"), F.count("*").alias("appended"))
    both = expected.join(block, "case_id", "left").withColumns({"block": F.coalesce("block", F.lit("")), "appended": F.coalesce("appended", F.lit(0))})
    bled = F.size(F.filter(F.coalesce("excludes", F.array().cast("array<string>")), lambda t: F.contains(F.lower("block"), F.lower(t))))
    return both.select("case_id", contains_all(F.col("contains"), F.col("block")).alias("rescued"), bled.alias("bled"), "appended")


def case_key(id_, kind, field):
    """Constraint cases run twice and carry the mode in their key."""
    mode = F.when(field, " [field:on]").otherwise(" [field:off]")
    return F.when(kind == "constraint", F.concat(id_, mode)).otherwise(id_)


def scorecard(results: DataFrame) -> DataFrame:
    """(kind, passed, total) per kind and over all ("all")."""
    out = results.groupingSets([["kind"], []], "kind").agg(F.count_if("pass").alias("passed"), F.count("*").alias("total"), F.grouping("kind").alias("g"))
    return out.select(F.when(F.col("g") == 1, "all").otherwise(F.col("kind")).alias("kind"), "passed", "total")


def field_effect(results: DataFrame) -> DataFrame:
    """One row: cases that the field lifts, breaks, rescues (metric roc) and bleeds into (metric tbr), off and on."""
    off, on = ~F.col("field"), F.col("field")
    case = results.groupBy("id", "metric").agg(
        F.bool_or(off & F.col("pass")).alias("off_pass"), F.bool_or(on & F.col("pass")).alias("on_pass"),
        F.bool_or(off & F.col("rescued")).alias("off_rescued"), F.bool_or(on & F.col("rescued")).alias("on_rescued"),
        F.bool_or(off & (F.col("bled") > 0)).alias("off_bled"), F.bool_or(on & (F.col("bled") > 0)).alias("on_bled"), F.count_distinct("field").alias("modes"),
    )
    roc, tbr, both = F.col("metric") == "roc", F.col("metric") == "tbr", F.col("modes") == 2
    return case.agg(
        F.count_if(both & F.col("on_pass") & ~F.col("off_pass")).alias("lifted"), F.count_if(both & F.col("off_pass") & ~F.col("on_pass")).alias("broken"),
        F.count_if(roc).alias("roc_cases"), F.count_if(roc & F.col("off_rescued")).alias("roc_off"), F.count_if(roc & F.col("on_rescued")).alias("roc_on"),
        F.count_if(roc & F.col("on_rescued") & ~F.col("off_rescued")).alias("attributable"),
        F.count_if(tbr).alias("tbr_cases"), F.count_if(tbr & F.col("off_bled")).alias("tbr_off"), F.count_if(tbr & F.col("on_bled")).alias("tbr_on"),
    )


def golden_diff(golden: DataFrame, current: DataFrame) -> DataFrame:
    """(key, change) of cases in both whose verdict changed; "regressed" rows fail the gate."""
    both = golden.select("key", F.col("pass").alias("was")).join(current.select("key", F.col("pass").alias("now")), "key").where("was <> now")
    return both.select("key", F.when(F.col("was"), "regressed").otherwise("fixed").alias("change"))
