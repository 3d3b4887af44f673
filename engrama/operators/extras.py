"""Operators that were designed for this kind of store but are not part of its everyday verbs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engrama.functions.text import SPACES, bounded, trim
from engrama.operators import lexical
from engrama.operators.graph import neighbourhood
from engrama.operators.knn import search

# Weights, bands and limits of the designs.
RRF = 60
RESERVED = 0.42
CORRECTION = r"(?i)\b(actually|correction|no longer|not anymore|used to|changed to|now it'?s|instead of|scratch that)\b"
NEGATION = r"(?i)\b(not|never|no longer|doesn'?t|isn'?t|won'?t|stopped)\b"
NUMBERS, YEARS = r"\b\d+(?:\.\d+)?\b", r"\b(19|20)\d{2}\b"
#: Words that say nothing about a subject.
STOPWORDS = ("the", "and", "for", "with", "that", "this", "from", "into", "are", "was", "were", "has", "have", "had", "not", "but", "you", "your", "she", "her", "his", "him", "they", "them", "its", "our", "who", "will", "can", "now")
DUPLICATE, MERGE = 0.95, 0.88
HALF_LIVES = {"user_stated": 365, "inferred": 180, "session": 30}
SECRETS = {
    "an API key": r"\b(sk|pk|ghp|gho|xox[baprs])-[A-Za-z0-9_-]{16,}\b",
    "an AWS key": r"\bAKIA[0-9A-Z]{16}\b",
    "what looks like a card number": r"\b[0-9]{13,16}\b",
    "a private key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "a credential": r"(?i)\b(password|passwd|secret|token)\s*[:=]\s*\S{6,}",
}
FILLER = (
    r"^(i think |i guess |just so you know,? |for the record,? |it'?s worth noting that )",
    r"^(please )?(remember|note) that ",
    r"^(fyi,? |btw,? |also,? )",
)
VERBS = r"\b(is|are|was|were|has|have|likes?|prefers?|needs?|uses?|lives?|works?|owns?)\b"
DEPENDENT = r"^(which|that|who|because|so|but|then)\b"
JOINTS = r"(?i);\s+|,?\s+and also\s+"


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9_]+"), lambda w: w != "")


def bm25(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(q_id, rnk, id, score) by BM25; docs (id, _pos, text), queries (q_id, text). Two passes over the docs for each block of queries: one counts their words, one ranks; docs are not shuffled."""
    asked = queries.select(F.col("q_id").cast("string").alias("q_id"), F.array_distinct(terms(F.col("text"))).alias("tok"))
    parts = []
    for block in lexical.query_blocks(asked):
        df, n, length = lexical.document_counts(sorted({w for _, tok in block for w in tok}), docs)
        idf = {w: math.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
        parts.append(lexical.ranked(block, idf, False, docs, lexical.saturated(max(length, 1) / max(n, 1)), k, 9))
    return lexical.top(parts, k, 9).where("score > 0")


def fuse(arms: list[DataFrame], k: int) -> DataFrame:
    """Reciprocal rank fusion of rankings (q_id, id, rnk)."""
    rows = arms[0].select("q_id", "id", "rnk")
    for arm in arms[1:]:
        rows = rows.unionByName(arm.select("q_id", "id", "rnk"))
    scores = rows.groupBy("q_id", "id").agg(F.sum(1 / (F.lit(RRF) + F.col("rnk"))).alias("score"))
    ranked = scores.withColumn("rnk", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc(F.round("score", 9)), "id")))
    return ranked.where(F.col("rnk") <= k).select("q_id", "rnk", "id", "score")


def band(sim: Column) -> Column:
    return F.when(sim >= DUPLICATE, "duplicate").when(sim >= MERGE, "merge").otherwise("new")


def importance(accesses: Column, age_days: Column, source: Column, is_constraint: Column) -> Column:
    """Halves with a source's half-life; constraints never fade."""
    half = F.coalesce(*[F.when(source == s, F.lit(d)) for s, d in HALF_LIVES.items()], F.lit(180))
    fade = F.when(is_constraint, F.lit(1.0)).otherwise(F.exp(-F.log(F.lit(2.0)) / half * age_days))
    return F.least(F.lit(1.0), F.lit(0.3) + 0.1 * accesses) * fade


def prune_proposals(memories: DataFrame, score: str = "score", floor: float = 0.05) -> DataFrame:
    """Faded memories that were never accessed and bind nothing, faintest first."""
    return memories.where((F.col(score) < floor) & (F.col("access_count") == 0) & ~F.col("is_constraint")).orderBy(score, "id")


def compact(memories: DataFrame, as_of: Column, days: int = 180) -> DataFrame:
    """memories without the vectors of facts that stopped holding over `days` ago."""
    old = F.col("valid_to").isNotNull() & (F.date_diff(as_of, F.col("valid_to")) > days)
    return memories.withColumn("embedding", F.when(~old, F.col("embedding")))


def secrets(text: Column) -> Column:
    """What each secret pattern that a text matches looks like, in the order of the patterns."""
    return F.filter(F.array(*[F.when(text.rlike(bounded(p)), F.lit(name)) for name, p in SECRETS.items()]), lambda x: x.isNotNull())


def refusal(text: Column) -> Column:
    """Why a text is not saved, by the first pattern it matches; null where it may be. A refused text is never stored in part."""
    first = F.get(secrets(text), 0)
    return F.when(first.isNotNull(), F.concat(F.lit("Not saved: that looks like "), first, F.lit(". Secrets do not belong in memory.")))


def strip_filler(text: Column) -> Column:
    """White space collapsed, all openers that say nothing taken off, and a capital in front; null stays null.

    An opener may stand in front of another, so one pattern repeats over all of them.
    """
    openers = "(?i)^(?:(?:" + "|".join(p.removeprefix("^") for p in FILLER) + r")\s*)+"
    left = trim(F.regexp_replace(trim(F.regexp_replace(text, SPACES, " ")), openers, ""))
    return F.concat(F.upper(F.substring(left, 1, 1)), F.substring(left, 2, 1 << 30))


def split_facts(text: Column) -> Column:
    """The statements of a compound sentence if every one of them can stand alone, else the text itself, in an array."""
    parts = F.filter(F.transform(F.split(text, JOINTS), trim), lambda p: p != "")
    alone = lambda p: (F.size(F.split(p, r"\s+")) >= 4) & p.rlike(bounded("(?i)" + VERBS)) & ~p.rlike(bounded("(?i)" + DEPENDENT))
    return F.when((F.size(parts) >= 2) & F.forall(parts, alone), parts).otherwise(F.array(text))


def _content(text: Column) -> Column:
    """The words of a text that say what it is about."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(bounded(r"\b([a-z][a-z'-]{2,})\b")), 1), lambda w: ~w.isin(*STOPWORDS)))


def subject_overlap(a: Column, b: Column) -> Column:
    """Shared content words over those of the text that has fewer; 0 where one has none."""
    x, y = _content(a), _content(b)
    fewer = F.least(F.size(x), F.size(y))
    return F.when(fewer > 0, F.size(F.array_intersect(x, y)) / fewer).otherwise(0.0)


def value_changed(a: Column, b: Column) -> Column:
    """Whether two texts differ in their numbers, their years, or in that one denies."""
    found = lambda t, p: F.array_join(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(bounded(p)), 0), ",")
    denies = lambda t: F.coalesce(t.rlike(bounded(NEGATION)), F.lit(False))
    return (found(a, NUMBERS) != found(b, NUMBERS)) | (found(a, YEARS) != found(b, YEARS)) | (denies(a) != denies(b))


def contradiction(new: Column, old: Column) -> Column:
    """How much a new text speaks against an old one, at most 1: the same subject, another value, an explicit correction."""
    parts = F.when(subject_overlap(new, old) > 0.5, 0.5).otherwise(0.0) + F.when(value_changed(new, old), 0.3).otherwise(0.0) + F.when(F.coalesce(new.rlike(bounded(CORRECTION)), F.lit(False)), 0.4).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), parts), 6)


def reconcile(new: DataFrame, current: DataFrame, merge: float = MERGE, duplicate: float = DUPLICATE) -> DataFrame:
    """(q_id, action, id, confidence, needs_review) for each new memory (id, text, embedding): "duplicate", "supersede", or "store", the last marked for review where doubt remains; id is the current memory that it is held against.

    Only the most similar current memory at or above `merge` counts. Nothing is guessed destructively.
    """
    asked = new.where(F.col("embedding").isNotNull()).select(F.col("id").alias("q_id"), "embedding")
    top = search(asked, current, 1, gate=merge).select("q_id", F.col("id").alias("_c"), "sim")
    texts = current.select(F.col("id").alias("_c"), F.col("text").alias("_old"))
    out = new.select(F.col("id").alias("q_id"), "text").join(top.join(texts, "_c"), "q_id", "left")
    score = F.when(F.col("_c").isNotNull() & (F.col("sim") < duplicate), contradiction(F.col("text"), F.col("_old")))
    out = out.withColumn("score", score)
    action = F.when(F.col("sim") >= duplicate, "duplicate").when(F.col("score") >= 0.7, "supersede").otherwise("store")
    return out.select("q_id", action.alias("action"), F.col("_c").alias("id"), F.when(action == "supersede", F.col("score")).alias("confidence"), F.coalesce((action == "store") & (F.col("score") >= 0.4), F.lit(False)).alias("needs_review"))


def reserved_constraint(ranked: DataFrame, queries: DataFrame, memories: DataFrame, k: int = 5, gate: float = RESERVED) -> DataFrame:
    """ranked (q_id, rnk, id) with the last of k places given to the constraint most similar to the query, at or above gate, where no constraint ranks by itself. Nothing is reordered."""
    rules = memories.where("is_constraint")
    top = ranked.where(F.col("rnk") <= k).select("q_id", F.col("rnk").cast("long").alias("rnk"), "id")
    has = top.join(rules.select("id"), "id", "left_semi").select("q_id").distinct()
    seat = search(queries.select("q_id", "embedding"), rules, 1, gate=gate).join(has, "q_id", "left_anti").select("q_id", F.col("id").alias("_seat"))
    n = top.groupBy("q_id").agg(F.least(F.count("*") + 1, F.lit(k)).cast("long").alias("_at"))
    seat = seat.join(n, "q_id")
    kept = top.join(seat, "q_id", "left").where(F.col("_at").isNull() | (F.col("rnk") < F.col("_at"))).select("q_id", "rnk", "id")
    return kept.unionByName(seat.select("q_id", F.col("_at").alias("rnk"), F.col("_seat").alias("id")))


def applicable_constraints(queries: DataFrame, memories: DataFrame, edges_: DataFrame, gate: float = RESERVED, hops: int = 2, probes: int = 12, cap: int = 3) -> DataFrame:
    """(q_id, rnk, id, score): the constraints whose domain is near a query. A domain is a constraint and up to `probes` memories around it in the graph; its nearest member counts."""
    mem = memories.where(F.col("embedding").isNotNull())
    rules = mem.where("is_constraint").select(F.col("id").alias("q_id"), "id", F.lit(1).alias("rnk"))
    around = neighbourhood(edges_, rules, hops, probes).select(F.col("q_id").alias("rule"), "id")
    domain = rules.select(F.col("q_id").alias("rule"), "id").unionByName(around).join(mem.select("id", "embedding"), "id")
    near = domain.select("rule", F.concat_ws("/", "rule", "id").alias("id"), F.monotonically_increasing_id().alias("_pos"), "embedding")
    # every probe at or above the gate counts, of which a query has few; each names its rule
    found = search(queries.select("q_id", "embedding"), near, (probes + 1) * cap, gate=gate).join(near.select("id", "rule"), "id")
    best = found.groupBy("q_id", "rule").agg(F.round(F.max("sim"), 9).alias("score"))
    ranked = best.withColumn("rnk", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), "rule")))
    return ranked.where(F.col("rnk") <= cap).select("q_id", "rnk", F.col("rule").alias("id"), "score")


def typed_edges(semantic: DataFrame, ledger: DataFrame, memories: DataFrame, rescued: DataFrame | None = None) -> DataFrame:
    """(src, dst, type, w): directed edges of all kinds: semantic (src, dst, sim), co_activation both ways (a, b, w), supersession from a memory (id, supersedes) to the one it closed, constraint_bridge from a rescued rule (id, via) to what it was reached by."""
    out = semantic.select("src", "dst", F.lit("semantic").alias("type"), F.col("sim").cast("double").alias("w"))
    out = out.unionByName(ledger.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e"), "w").select("e.*", F.lit("co_activation").alias("type"), "w"))
    out = out.unionByName(memories.where("supersedes IS NOT NULL").select(F.col("id").alias("src"), F.col("supersedes").alias("dst"), F.lit("supersession").alias("type"), F.lit(1.0).alias("w")))
    if rescued is not None:
        out = out.unionByName(rescued.groupBy("id", "via").agg(F.max("sim").alias("w")).select(F.col("id").alias("src"), F.col("via").alias("dst"), F.lit("constraint_bridge").alias("type"), "w"))
    return out
