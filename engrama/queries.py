"""Driver queries: every operator over the whole of its tables.

Searches take as queries every row whose id is divisible by 50. The test
vectors are close to random, so graph queries use a gate of 0.25.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engrama.functions.text import content_hash, contains_all, contains_none, has_cue, is_constraint, is_historical, snippet, tokens
from engrama.functions.vector import bonus, cosine
from engrama.operators import cells, evaluation, extras, grams, graph, ledger, postings, recall, scoping, temporal, views
from engrama.operators.knn import lsh_search, neighbours, search
from engrama.schema import normalise

GATE = 0.25


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def memories(spark: SparkSession, sf: str) -> DataFrame:
    """documents as memories: labels stand in for constraints and removals, two sources for facts that no longer hold."""
    docs, emb, lab = _t(spark, sf, "documents"), _t(spark, sf, "embeddings"), _t(spark, sf, "labels")
    vec = emb.select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    out = docs.join(vec, "doc_id", "left").join(lab, "doc_id", "left")
    return out.select(
        F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("_pos"), "text", "embedding",
        (F.coalesce("toxic", F.lit(0)) == 1).alias("is_constraint"), (F.coalesce("quality", F.lit(1)) == 0).alias("deleted"),
        F.when(F.col("source").isin("src1", "src2"), F.lit("2024-01-01").cast("timestamp")).alias("valid_to"), "source", "lang",
    )


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """memories() of searches by words. doc_id and vec_id are keys, so the joins of memories() add no row and no text is shuffled for vectors that no word search looks at."""
    return _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("_pos"), "text")


def _asking(mem: DataFrame) -> DataFrame:
    return mem.where((F.col("_pos") % 50 == 0) & F.col("embedding").isNotNull()).select(F.col("id").alias("q_id"), "embedding")


def _turns_asking(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn of the asking conversations; q_id is conversation:turn."""
    return _t(spark, sf, "conversations").where("conv_id % 50 = 0").select(F.concat_ws(":", "conv_id", "turn").alias("q_id"), "text")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names or ("sim",)})


def recall_topk(spark, sf):
    mem = memories(spark, sf)
    return _rounded(search(_asking(mem), mem, recall.RETURNED))


def seed_pool(spark, sf):
    mem = memories(spark, sf)
    return _rounded(search(_asking(mem), mem, recall.SEEDS))


def scoped_recall(spark, sf):
    mem = memories(spark, sf)
    asks = _asking(mem).withColumn("historical", F.col("q_id").cast("long") % 100 == 0)
    return _rounded(recall.recall(asks, mem, recall.RETURNED))


def keyword_fallback(spark, sf):
    asks = _turns_asking(spark, sf)
    return _rounded(recall.keyword_recall(asks, _texts(spark, sf)), "score")


def keyword_indexed(spark, sf):
    """keyword_fallback by postings of grams, which are written once."""
    _set_checkpoints(spark)
    mem = _texts(spark, sf)
    return _rounded(grams.keyword_recall(_turns_asking(spark, sf), mem, grams.build(mem).checkpoint(), recall.RETURNED), "score")


def current_scope(spark, sf):
    return recall.in_scope(memories(spark, sf), False).select("id", "source")


def active_scope(spark, sf):
    return recall.in_scope(memories(spark, sf), True).select("id", "valid_to")


def _chains(spark, sf):
    return temporal.chains(_t(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_orderkey")


def validity_chain(spark, sf):
    return _chains(spark, sf).select("o_orderkey", "o_custkey", "valid_from", "valid_to", "supersedes", "superseded_by", "revision")


def as_of(spark, sf):
    return temporal.as_of(_chains(spark, sf), F.lit("1996-06-30").cast("timestamp")).select("o_orderkey", "o_custkey", "o_totalprice")


#: What some rows say before their own text, by a number of theirs modulo 20, so that every branch of the operators on texts occurs.
PHRASES = (
    "I am allergic to nuts and never eat dairy.", "Where did I live back then, and what was my old job?", "Actually I moved, the gate code is 12.", "The gate code is 12.", "The gate code is 9.",
    "Right now debugging the build.", "I always prefer tea.", "My password: hunter2hunter2", "Please remember that the cat is on the mat; the dog is in the old house", "It is no longer current.",
)


def _phrased(number, text):
    """text behind the phrase of its number."""
    out = F.when(number % 20 == 0, F.concat(F.lit(PHRASES[0] + " "), text))
    for i, phrase in enumerate(PHRASES[1:], 1):
        out = out.when(number % 20 == i, F.concat(F.lit(phrase + " "), text))
    return out.otherwise(text)


def _said(spark, sf):
    """conversations with phrases in some turns."""
    conv = _t(spark, sf, "conversations")
    return conv.withColumn("text", _phrased(F.col("conv_id") + F.col("turn"), F.col("text")))


def as_of_join(spark, sf):
    """The order of a customer of the same number that was their last at each event's time, moved to the orders' years."""
    at = F.timestamp_micros(F.lit(788918400000000) + (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) * 80)
    times = _t(spark, sf, "events").select("event_id", F.col("user_id").alias("o_custkey"), at.alias("at"))
    orders = _t(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"), "o_totalprice")
    out = temporal.as_of_join(times, orders, "o_custkey", "at", "o_orderdate", "o_orderkey")
    return out.select("event_id", "o_custkey", F.col("fact.o_orderkey").alias("o_orderkey"), F.col("fact.o_totalprice").alias("o_totalprice"))


def classifiers(spark, sf):
    text = F.col("text")
    return _t(spark, sf, "documents").withColumn("text", _phrased(F.col("doc_id"), F.col("text"))).select("doc_id", is_constraint(text).alias("is_constraint"), is_historical(text).alias("is_historical"), has_cue(text).alias("has_cue"))


def supersede_cue(spark, sf):
    return _t(spark, sf, "conversations").where(has_cue(F.col("text"))).select("conv_id", "turn", "role")


def supersede_argmax(spark, sf):
    mem = memories(spark, sf)
    return _rounded(temporal.supersession_targets(mem, recall.in_scope(mem, False), GATE))


def exact_restatement(spark, sf):
    mem = memories(spark, sf)
    return temporal.restatements(mem, recall.in_scope(mem, False))


def access_fold(spark, sf):
    log = _t(spark, sf, "events").select(F.col("user_id").cast("string").alias("id"), F.col("ts").alias("at"))
    mem = memories(spark, sf).select("id", F.lit(0.0).alias("importance"), F.lit(0).cast("long").alias("access_count"), F.lit(None).cast("timestamp").alias("last_access"))
    out = temporal.fold_access(mem, temporal.access_counts(log))
    return out.select("id", "importance", "access_count", F.col("last_access").cast("timestamp_ntz").alias("last_access"))


def content_hashes(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", content_hash(F.col("text")).alias("hash"))


def text_functions(spark, sf):
    text = F.col("text")
    return _t(spark, sf, "conversations").select("conv_id", "turn", F.size(tokens(text)).cast("long").alias("n_tokens"), snippet(text).alias("snippet"))


def expectations(spark, sf):
    docs = _t(spark, sf, "documents")
    want, avoid = F.array(F.lit("THE"), F.lit("and")), F.array(F.lit("@"), F.lit("|"))
    return docs.select("doc_id", contains_all(want, F.col("text")).alias("has_all"), contains_none(avoid, F.col("text")).alias("has_none"))


def _edges(spark, sf, k, mutual):
    return graph.edges(memories(spark, sf), k, GATE, mutual)


def knn_directional(spark, sf):
    return _rounded(_edges(spark, sf, 3, False))


def knn_mutual(spark, sf):
    return _rounded(_edges(spark, sf, 2, True).select("src", "dst", "sim"))


def _seeds(spark, sf, mem):
    return search(_asking(mem), mem, recall.RETURNED)


def neighborhood_1hop(spark, sf):
    mem = memories(spark, sf)
    return _rounded(graph.neighbourhood(graph.edges(mem, 2, GATE), _seeds(spark, sf, mem), 1, 4).select("q_id", "rnk", "id", "sim"))


def neighborhood_2hop(spark, sf):
    _set_checkpoints(spark)
    mem = memories(spark, sf)
    near, seeds = graph.edges(mem, 2, GATE).checkpoint(), _seeds(spark, sf, mem).checkpoint()  # both hops read them
    return _rounded(graph.neighbourhood(near, seeds, 2, 1 << 30).select("q_id", "id", "hop", "sim"))


def constraint_rescue(spark, sf):
    mem = memories(spark, sf)
    pool = search(_asking(mem), mem, recall.SEEDS)
    out = graph.constraint_rescue(mem, pool, GATE, 2, 4, exclude=pool.where(F.col("rnk") <= recall.RETURNED))
    return _rounded(out.select("q_id", "rnk", "id", "sim", "via"))


def merged_related(spark, sf):
    _set_checkpoints(spark)
    mem = memories(spark, sf)
    pool = search(_asking(mem), mem, recall.SEEDS).checkpoint()
    got = pool.where(F.col("rnk") <= recall.RETURNED)
    return graph.merge_related(graph.constraint_rescue(mem, pool, GATE, 2, 4, exclude=got), graph.neighbourhood(graph.edges(mem, 2, GATE), got, 1, 4), got)


def graph_nodes(spark, sf):
    return graph.graph_view(memories(spark, sf), 3, GATE)[0].select("id", "is_constraint", "current")


def graph_edges(spark, sf):
    return graph.graph_view(memories(spark, sf), 3, GATE)[1]


def weighted_degree(spark, sf):
    out = graph.weighted_degree(graph.graph_view(memories(spark, sf), 3, GATE)[1])
    return _rounded(out, "degree")


def components(spark, sf):
    _set_checkpoints(spark)
    nodes, links = graph.graph_view(memories(spark, sf), 2, 0.4)
    return graph.components(nodes, links)


def reach_strategies(spark, sf):
    _set_checkpoints(spark)
    mem = memories(spark, sf)
    return graph.reach(graph.edges(mem, 2, GATE), _seeds(spark, sf, mem), mem.where("is_constraint").select("id"))


def _recalls(spark, sf):
    """Orders in time are recalls; their parts are what each brought up, the first line's as the primary ones of its kind."""
    orders = _t(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    clock = _clock(orders)
    items = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").cast("string").alias("id"), F.when(F.col("l_linenumber") <= 3, "primary").otherwise("related").alias("role"))
    return items.join(clock, "o_orderkey").groupBy("t", "id").agg(F.min("role").alias("role")), orders


def _clock(orders: DataFrame) -> DataFrame:
    """t from 1 in time order, numbered within days and then lifted by the days before, so that no task sorts it all."""
    days = orders.groupBy("o_orderdate").agg(F.count("*").alias("n"))
    before = days.withColumn("year", F.year("o_orderdate")).groupBy("year").agg(F.sum("n").alias("y"))
    starts = before.withColumn("base", F.sum("y").over(Window.orderBy("year")) - F.col("y")).select("year", "base")  # one row per year
    day_start = days.withColumn("year", F.year("o_orderdate")).withColumn("inside", F.sum("n").over(Window.partitionBy("year").orderBy("o_orderdate")) - F.col("n"))
    lifted = day_start.join(starts, "year").select("o_orderdate", (F.col("base") + F.col("inside")).alias("lift"))
    numbered = orders.withColumn("i", F.row_number().over(Window.partitionBy("o_orderdate").orderBy("o_orderkey")))
    return numbered.join(lifted, "o_orderdate").select("o_orderkey", (F.col("lift") + F.col("i")).alias("t"))


def ledger_coactivation(spark, sf):
    return _rounded(ledger.coactivation(ledger.bumps(_recalls(spark, sf)[0])), "w")


def _folded(spark, sf):
    recalls, orders = _recalls(spark, sf)
    return ledger.decay_fold(ledger.bumps(recalls), F.lit(orders.count()))


def ledger_decay_fold(spark, sf):
    return _rounded(_folded(spark, sf), "w")


def ledger_incremental(spark, sf):
    """ledger_decay_fold in three steps, each from the state of the one before and the recalls since."""
    recalls, orders = _recalls(spark, sf)
    n, all_, state = orders.count(), ledger.bumps(recalls), None
    for lo, hi in ((0, n // 3), (n // 3, n // 2), (n // 2, n)):
        state = ledger.fold_state(all_.where((F.col("t") > lo) & (F.col("t") <= hi)), state)
        state = ledger.as_of(state, F.lit(hi)).withColumn("e", F.floor(F.lit(hi) / ledger.EPOCH))
    return _rounded(state.select("a", "b", "w"), "w")


def ledger_telemetry(spark, sf):
    return _rounded(ledger.telemetry(ledger.coactivation(ledger.bumps(_recalls(spark, sf)[0])).withColumn("w", F.round("w", 6))), "avg_w")


def learned_bonus(spark, sf):
    out = ledger.coactivation(ledger.bumps(_recalls(spark, sf)[0]))
    return out.select("a", "b", F.round(bonus(F.col("w")), 6).alias("bonus"))


def hebbian_edges(spark, sf):
    """Part pairs of orders lend weight to memories of the same ids."""
    weights = ledger.coactivation(ledger.bumps(_recalls(spark, sf)[0]))
    return _rounded(graph.edges(memories(spark, sf), 2, GATE, False, weights))


def timescale_probe(spark, sf):
    """How many joint recalls lift each edge over the usual gate, and how many without it take it under again."""
    near = graph.edges(memories(spark, sf), 2, GATE)
    return ledger.timescale(near.select(F.concat_ws("-", "src", "dst").alias("pair"), F.round("sim", 6).alias("cos")))


def _results(spark, sf):
    """Each label as a case that ran off and on."""
    lab = _t(spark, sf, "labels").join(_t(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    both = lab.withColumn("field", F.explode(F.array(F.lit(False), F.lit(True))))
    return both.select(
        F.col("doc_id").alias("id"), F.col("lang").alias("kind"), "field", F.when(F.col("toxic") == 1, "tbr").otherwise("roc").alias("metric"),
        F.when(F.col("field"), ((F.col("quality") == 1) | (F.col("n_chars") > 1000)) & (F.col("n_chars") % 10 != 3) & ((F.col("lang") != "es") | (F.col("n_chars") % 3 != 0))).otherwise(F.col("quality") == 1).alias("pass"),
        ((F.col("n_chars") > 500) & (F.col("field") | (F.col("quality") == 1))).alias("rescued"),
        F.when(F.col("field"), F.col("toxic")).otherwise(0).alias("bled"),
    )


def scorecard(spark, sf):
    return evaluation.scorecard(_results(spark, sf))


def roc_tbr(spark, sf):
    return evaluation.field_effect(_results(spark, sf))


def golden_diff(spark, sf):
    res = _results(spark, sf).withColumn("key", evaluation.case_key(F.col("id").cast("string"), F.lit("constraint"), F.col("field")))
    golden = res.where(~F.col("field")).select(F.concat(F.col("id").cast("string"), F.lit(" [field:on]")).alias("key"), F.col("pass"))
    return evaluation.golden_diff(golden, res.select("key", "pass"))


def first_hit_turn(spark, sf):
    turns = _t(spark, sf, "conversations").select(F.col("conv_id").alias("case_id"), (F.col("turn") + 1).alias("turn"), F.contains(F.lower("text"), F.lit("the")).alias("hit"), F.lit(None).cast("boolean").alias("want"))
    return evaluation.score_repeat(turns)


def bm25_topk(spark, sf):
    asks = _turns_asking(spark, sf)
    return _rounded(extras.bm25(asks, _texts(spark, sf), 10), "score")


def bm25_pruned(spark, sf):
    """bm25_topk from block-max postings."""
    _set_checkpoints(spark)
    mem = _texts(spark, sf)
    held, stats = postings.build(mem, 128)
    return _rounded(postings.search(_turns_asking(spark, sf), mem, held.checkpoint(), stats, 10), "score")


def rrf_fuse(spark, sf):
    mem = memories(spark, sf)
    arms = [search(_asking(mem), mem, 15), search(_asking(mem), recall.in_scope(mem, False), 15)]
    return _rounded(extras.fuse(arms, 10), "score")


def dedup_bands(spark, sf):
    """Each memory beside three that are planted near it: a copy, one turned by some 25 degrees, and one turned further."""
    mem = memories(spark, sf).where("embedding IS NOT NULL").select("id", "embedding")
    turned = lambda part: F.transform("embedding", lambda x, i: x + F.when(i % 2 == 0, F.lit(part)).otherwise(F.lit(-part)) * F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v) / F.size("embedding")))
    planted = mem.select("id", "embedding", F.explode(F.array(*[F.struct(F.lit(n).alias("plant"), turned(p).alias("near")) for n, p in (("copy", 0.0), ("turned", 0.45), ("far", 1.5))])).alias("p"))
    sim = cosine(F.col("embedding"), F.col("p.near"))
    return _rounded(planted.select("id", "p.plant", sim.alias("sim"), extras.band(F.round(sim, 9)).alias("band")))


def importance_decay(spark, sf):
    docs = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id")
    value = extras.importance(F.col("quality"), F.col("n_chars") / 10, F.lit("user_stated"), F.col("toxic") == 1)
    return _rounded(docs.select("doc_id", value.alias("score")), "score")


def prune_proposals(spark, sf):
    docs = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id")
    value = extras.importance(F.col("quality"), F.col("n_chars") / 10, F.lit("session"), F.col("toxic") == 1)
    mem = docs.select(F.col("doc_id").alias("id"), value.alias("score"), (1 - F.col("quality")).alias("access_count"), (F.col("toxic") == 1).alias("is_constraint"))
    return _rounded(extras.prune_proposals(mem), "score")


def compact_superseded(spark, sf):
    out = extras.compact(memories(spark, sf), F.lit("2024-08-01").cast("timestamp"))
    return out.select("id", F.col("embedding").isNotNull().alias("has_vector"))


def secret_guard(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.array_join(extras.secrets(F.col("text")), ",").alias("secrets"))


def _turn_pairs(spark, sf):
    last = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return _said(spark, sf).withColumn("text", F.when((F.col("conv_id") + F.col("turn")) % 20 < 10, F.substring_index("text", ".", 1)).otherwise(F.col("text"))).select("conv_id", "turn", "text", last.alias("before")).where("before IS NOT NULL")


def subject_overlap(spark, sf):
    """Each turn against the one before it."""
    new, old = F.col("text"), F.col("before")
    return _turn_pairs(spark, sf).select("conv_id", "turn", F.round(extras.subject_overlap(new, old), 6).alias("overlap"), extras.value_changed(new, old).alias("changed"), extras.contradiction(new, old).alias("score"))


def reconcile(spark, sf):
    """Memories that ask against the current ones; bands that fit the test vectors. Those that ask speak of a code, against which half of the others speak."""
    mem = memories(spark, sf)
    said = F.when(F.col("_pos") % 150 == 0, PHRASES[2]).when(F.col("_pos") % 150 == 50, PHRASES[3]).when(F.col("_pos") % 3 == 1, PHRASES[4]).when(F.col("_pos") % 3 == 2, PHRASES[3])
    mem = mem.withColumn("text", F.coalesce(said, "text"))
    return extras.reconcile(mem.where("_pos % 50 = 0"), recall.in_scope(mem, False), 0.15, 0.45)


def reserved_constraint(spark, sf):
    mem = memories(spark, sf)
    return extras.reserved_constraint(search(_asking(mem), mem, 5), _asking(mem), mem, 5, GATE)


def applicable_constraints(spark, sf):
    _set_checkpoints(spark)
    mem = memories(spark, sf)
    return _rounded(extras.applicable_constraints(_asking(mem), mem, graph.edges(mem, 2, GATE).checkpoint(), GATE), "score")


def typed_edges(spark, sf):
    """Near memories, parts of the same orders, orders that follow each other, and rules with what they were reached by."""
    mem = memories(spark, sf)
    pool = search(_asking(mem), mem, recall.SEEDS)
    closed = _chains(spark, sf).select(F.col("o_orderkey").cast("string").alias("id"), F.col("supersedes").cast("string").alias("supersedes"))
    out = extras.typed_edges(graph.edges(mem, 3, GATE), ledger.coactivation(ledger.bumps(_recalls(spark, sf)[0])), closed, graph.constraint_rescue(mem, pool, GATE, 2, 4))
    return _rounded(out, "w")


def initial_tiers(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", scoping.initial_tier(_phrased(F.col("doc_id"), F.col("text"))).alias("tier"))


def _scoped(spark, sf):
    """Memories with their language as scope, their source as session, and documents of even id as passing."""
    return memories(spark, sf).withColumns({"scope": F.col("lang"), "session_id": F.col("source"), "tier": F.when(F.col("_pos") % 2 == 0, "session").otherwise("long_term")})


def visible_memories(spark, sf):
    return scoping.visible(_scoped(spark, sf), "en", "src0").select("id", "tier")


def session_expiry(spark, sf):
    """Passing memories, last confirmed when their user was first seen, all within some days of the earliest."""
    seen = _t(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("id")).agg((F.min("ts") + F.expr("INTERVAL 1 DAY") * (F.col("id").cast("int") % 15)).alias("last_confirmed"))
    mem = _scoped(spark, sf).join(seen, "id").withColumn("created", F.col("last_confirmed"))
    latest = mem.agg(F.max("last_confirmed")).first()[0]
    return scoping.expired_sessions(mem, F.lit(latest), "src0")


def promotions(spark, sf):
    _set_checkpoints(spark)
    return scoping.promotions(_scoped(spark, sf), 0.4)


def store_state(spark, sf):
    return views.state(memories(spark, sf))


def graph_state(spark, sf):
    return views.graph_state(memories(spark, sf), 3, GATE)


def _weights(spark, sf):
    return ledger.coactivation(ledger.bumps(_recalls(spark, sf)[0]))


def strongest_edges(spark, sf):
    """A report of five."""
    return _rounded(ledger.strongest(_weights(spark, sf), memories(spark, sf)), "w", "cos")


def leap_edges(spark, sf):
    """A report of five."""
    return _rounded(ledger.leaps(_weights(spark, sf), memories(spark, sf)), "w", "cos")


def learned_graph(spark, sf):
    """The graph view with the weights that orders lend to memories of the same ids."""
    return graph.graph_view(memories(spark, sf), 3, GATE, _weights(spark, sf))[1]


def _targets(spark, sf):
    """What each asking memory looks for: the first word of its own text."""
    return memories(spark, sf).where("_pos % 50 = 0 AND embedding IS NOT NULL").select(F.col("id").alias("q_id"), F.get(F.split("text", r"\s+"), 0).alias("term"))


def target_ranks(spark, sf):
    mem = memories(spark, sf)
    _set_checkpoints(spark)
    return evaluation.target_rank(_asking(mem), mem, _targets(spark, sf))


def geometry(spark, sf):
    _set_checkpoints(spark)
    mem = memories(spark, sf)
    return _rounded(views.geometry(_asking(mem), mem, graph.edges(mem, 2, GATE), _targets(spark, sf), _seeds(spark, sf, mem)))


def quality_figures(spark, sf):
    """Whether the nearest memory that still holds ranks among all."""
    mem = memories(spark, sf)
    want = search(_asking(mem), recall.in_scope(mem, False), 1).select("q_id", "id")
    return _rounded(evaluation.quality_figures(search(_asking(mem), mem, 15), want, mem), "recall_at_k", "mrr", "staleness_rate")


def duplicate_rate(spark, sf):
    mem = memories(spark, sf).where("embedding IS NOT NULL")
    near = neighbours(mem, 1)
    return _rounded(evaluation.duplicate_rate(near, mem, 0.5), "rate")


def false_supersessions(spark, sf):
    good = _t(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("id"))
    return evaluation.false_supersessions(memories(spark, sf), good)


def store_growth(spark, sf):
    return evaluation.store_growth(_t(spark, sf, "documents").select(F.col("doc_id").alias("_pos"), "text"))


def latency_p95(spark, sf):
    return _rounded(evaluation.latency_p95(_t(spark, sf, "events"), "value"), "p95")


def ab_table(spark, sf):
    res = _results(spark, sf).withColumn("variant", F.when(F.col("field"), "field-on").otherwise("field-off"))
    return _rounded(evaluation.compare(res, "field-off", "field-on"), "a", "b", "delta")


def ab_evaluated(spark, sf):
    """Each conversation as a case of its own, run twice: recalls that return one memory against recalls that return three. A case asks for the first word of its second turn."""
    from engrama.plans import recall_plan, replay

    _set_checkpoints(spark)
    conv, emb = _t(spark, sf, "conversations"), _t(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    vec = lambda n: emb.where("vec_id < 500").withColumnRenamed("vec_id", n)
    writes = conv.withColumn("_v", (F.col("conv_id") * 3 + F.col("turn")) % 500).join(vec("_v"), "_v").select(F.col("conv_id").cast("string").alias("store_id"), F.col("turn").alias("_pos"), "text", "embedding", F.timestamp_seconds(F.col("turn").cast("long")).alias("at"))
    cases = conv.where("turn = 1").withColumn("_v", (F.col("conv_id") * 7 + 1) % 500).join(vec("_v"), "_v")
    none = lambda t: F.lit(None).cast(t)
    cases = cases.select(F.col("conv_id").cast("string").alias("id"), F.concat(F.lit("k"), F.col("conv_id") % 3).alias("kind"), none("string").alias("metric"), none("boolean").alias("field"), F.lit("what was said").alias("query"), "embedding", F.array(F.get(F.split("text", " "), 0)).alias("contains"), none("array<string>").alias("excludes"), none("boolean").alias("current_only"))
    return _rounded(replay.compare_options(cases, writes, recall_plan.Options(returned=1), recall_plan.Options(returned=3)), "a", "b", "delta")


def soak(spark, sf):
    return evaluation.soak(memories(spark, sf))


def write_tiers(spark, sf):
    """What a save does to a text before it is stored."""
    text = F.col("text")
    return _said(spark, sf).select("conv_id", "turn", extras.strip_filler(text).alias("plain"), F.size(extras.split_facts(text)).cast("long").alias("facts"), extras.refusal(text).alias("refusal"))


def scored_outputs(spark, sf):
    """Texts as outputs of single cases."""
    cases = _said(spark, sf).select("conv_id", "turn", F.col("text").alias("output"), F.array(F.lit("the")).alias("contains"), F.array(F.lit("and")).alias("excludes"), F.lit(True).alias("current_only"))
    return evaluation.score(cases).select("conv_id", "turn", "pass", F.array_join("reasons", "; ").alias("reasons"), "first_hit_turn")


def repeat_scores(spark, sf):
    """Conversations as repeated cases: every third turn must hold the term, every third must not, the others don't matter."""
    want = F.when(F.col("turn") % 3 == 0, True).when(F.col("turn") % 3 == 1, False)
    turns = _t(spark, sf, "conversations").select(F.col("conv_id").alias("case_id"), (F.col("turn") + 1).alias("turn"), F.contains(F.lower("text"), F.lit("the")).alias("hit"), want.alias("want"))
    return evaluation.score_repeat(turns)


def access_consolidate(spark, sf):
    """A store's counts after accesses were folded in and written, and as many came again."""
    log = _t(spark, sf, "events").select(F.col("user_id").cast("string").alias("id"), F.col("ts").alias("at"))
    mem = memories(spark, sf).select("id", F.lit(0.0).alias("importance"), F.lit(0).cast("long").alias("access_count"), F.lit(None).cast("timestamp").alias("last_access"))
    once = temporal.fold_access(mem, temporal.access_counts(log))
    again = temporal.fold_access(once, temporal.prune_access(temporal.access_counts(log), once))
    return again.select("id", "importance", "access_count", F.col("last_access").cast("timestamp_ntz").alias("last_access"))


def backfilled(spark, sf):
    """Memories without a vector take that of the document 500 before."""
    mem = memories(spark, sf)
    bare = mem.where("embedding IS NULL").select("id", (F.col("_pos") - 500).cast("string").alias("from"))
    fresh = bare.join(mem.where("embedding IS NOT NULL").select(F.col("id").alias("from"), "embedding"), "from").select("id", "embedding")
    return temporal.backfill(mem.select("id", "embedding"), fresh).select("id", F.round(F.get("embedding", 0), 6).alias("x"))


def lsh_recall(spark, sf):
    """Whether the registered index finds nine in ten of the true three nearest."""
    mem = memories(spark, sf)
    true = neighbours(mem, 3).select("q_id", "id")
    found = lsh_search(mem, 3).select("q_id", "id", F.lit(1).alias("f"))
    return true.join(found, ["q_id", "id"], "left").agg(F.count("*").alias("pairs"), (F.count("f") >= 0.9 * F.count("*")).alias("enough"))


def replayed_saves(spark, sf):
    """Conversations as stores, turns as saves with the vectors of documents of the same number. Some turns announce a change, state a rule, or say what the first turn said."""
    from engrama.plans.replay import replay

    _set_checkpoints(spark)
    conv, n = _t(spark, sf, "conversations"), F.col("conv_id") + F.col("turn")
    vec = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("conv_id"), "embedding")
    first = conv.where("turn = 0").select("conv_id", F.col("text").alias("first"))
    text = F.when(n % 5 == 1, F.concat(F.lit("Now that I moved, "), "text")).when(n % 7 == 2, F.concat(F.lit("I am allergic to "), "text")).when(n % 6 == 3, F.coalesce("first", "text")).otherwise(F.col("text"))
    writes = conv.join(vec, "conv_id", "left").join(first, "conv_id", "left").select(F.col("conv_id").cast("string").alias("store_id"), F.col("turn").alias("_pos"), text.alias("text"), "embedding", F.timestamp_seconds(F.col("turn").cast("long")).alias("at"))
    return replay(writes).select("store_id", "id", F.length("text").cast("long").alias("n_chars"), "supersedes", "superseded_by", "revision", "is_constraint")


def json_normalize(spark, sf):
    raw = _t(spark, sf, "events").select(F.to_json(F.struct(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.col("event_type").alias("text"), F.col("value").cast("string").alias("importance"), F.col("user_id").alias("access_count"))).alias("value"), F.col("event_id").alias("_pos"))
    out = normalise(raw, F.lit("2000-01-01").cast("timestamp"))
    return out.select("id", F.date_format("created", "yyyy-MM-dd HH:mm:ss").alias("created"), "text", "importance", "access_count", "revision", "source", "is_constraint", "deleted")


def next_id(spark, sf):
    return temporal.next_id(memories(spark, sf), F.lit(1000))


def patched(spark, sf):
    patches = _t(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("label "), F.col("quality").cast("string")).alias("source"))
    return temporal.patch(memories(spark, sf).select("id", "source", "lang"), patches)


def vacuumed(spark, sf):
    return temporal.vacuum(memories(spark, sf)).groupBy("lang").agg(F.count("*").alias("n"))


def recall_listing(spark, sf):
    mem = memories(spark, sf)
    return recall.listing(search(_asking(mem), mem, recall.RETURNED), mem)


def cache_misses(spark, sf):
    from engrama.sources.files import cached_embeddings

    docs, mem = _t(spark, sf, "documents"), memories(spark, sf)
    cache = mem.where("embedding IS NOT NULL").select(content_hash(F.col("text")).alias("hash"), "embedding").groupBy("hash").agg(F.first("embedding").alias("embedding"))
    return cached_embeddings(docs.select("text"), cache)[1].select("hash")


def session_counts(spark, sf):
    from engrama.streaming.streams import sessions

    log = _t(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("ts").alias("at"))
    out = sessions(log, "6 hours")
    return out.select("id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


def _with_vectors(spark, sf):
    return memories(spark, sf).where("embedding IS NOT NULL")


def cell_edges(spark, sf):
    """knn_directional by cells."""
    mem = _with_vectors(spark, sf)
    return _rounded(graph.edges(mem, 3, GATE, index=cells.fit(mem)))


def cell_rescue(spark, sf):
    """constraint_rescue by cells."""
    mem = memories(spark, sf)
    pool = search(_asking(mem), mem, recall.SEEDS)
    out = graph.constraint_rescue(mem, pool, GATE, 2, 4, exclude=pool.where(F.col("rnk") <= recall.RETURNED), index=cells.fit(mem))
    return _rounded(out.select("q_id", "rnk", "id", "sim", "via"))


def cell_recall(spark, sf):
    """Whether the fitted number of nearest cells holds nine in ten of the true three nearest."""
    mem = _with_vectors(spark, sf)
    asks, index = mem.select(F.col("id").alias("q_id"), "embedding"), cells.fit(mem)
    found = cells.search(asks, mem, 3, cells=index, probes=cells.fit_probes(mem, index, 3)).select("q_id", "id", F.lit(1).alias("f"))
    return neighbours(mem, 3).select("q_id", "id").join(found, ["q_id", "id"], "left").agg(F.count("*").alias("pairs"), (F.count("f") >= 0.9 * F.count("*")).alias("enough"))


def clustered(spark, sf, centres: int = 25, own: float = 0.25):
    """The vectors drawn towards some of them, so that there is something for cells to leave out."""
    emb = _t(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    hub = emb.where(F.col("vec_id") < centres).select(F.col("vec_id").alias("h"), F.col("embedding").alias("c"))  # `centres` rows
    out = emb.join(F.broadcast(hub), F.col("vec_id") % centres == F.col("h"))
    return out.select(F.col("vec_id").cast("string").alias("id"), F.col("vec_id").alias("_pos"), F.zip_with("embedding", "c", lambda x, y: own * x + y).alias("embedding"))


def cell_pruning(spark, sf):
    """Of all pairs of clustered vectors, whether less than a quarter is compared for a gate of 0.8, and how many edges there are."""
    mem = clustered(spark, sf)
    index, asks = cells.fit(mem), mem.select(F.col("id").alias("q_id"), "embedding")
    n = graph.edges(mem, 3, 0.8, index=index).count()
    return cells.compared(asks, mem, 0.8, index).select("pairs", (4 * F.col("compared") < F.col("pairs")).alias("few"), F.lit(n).cast("long").alias("edges"))


def lsh_neighbours(spark, sf):
    return _rounded(lsh_search(memories(spark, sf), 3))


def _set_checkpoints(spark: SparkSession) -> None:
    """A folder only where none is named and all run on this machine."""
    import tempfile

    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="engrama-"))


_QUERIES = (
    recall_topk, seed_pool, scoped_recall, keyword_fallback, current_scope, active_scope, validity_chain, as_of, classifiers, supersede_cue, supersede_argmax,
    exact_restatement, access_fold, content_hashes, text_functions, expectations, knn_directional, knn_mutual, neighborhood_1hop, neighborhood_2hop,
    constraint_rescue, merged_related, graph_nodes, graph_edges, weighted_degree, components, reach_strategies, ledger_coactivation, ledger_decay_fold,
    ledger_telemetry, learned_bonus, hebbian_edges, timescale_probe, scorecard, roc_tbr, golden_diff, first_hit_turn, bm25_topk, rrf_fuse, dedup_bands,
    importance_decay, prune_proposals, compact_superseded, secret_guard, subject_overlap, json_normalize, next_id, patched, vacuumed, recall_listing,
    cache_misses, session_counts, lsh_neighbours, reconcile, reserved_constraint, applicable_constraints, typed_edges, initial_tiers, visible_memories, session_expiry,
    promotions, store_state, graph_state, strongest_edges, leap_edges, learned_graph, target_ranks, geometry, quality_figures, duplicate_rate, false_supersessions,
    store_growth, latency_p95, ab_table, soak, write_tiers, scored_outputs, repeat_scores, access_consolidate, backfilled, lsh_recall, replayed_saves,
    as_of_join, keyword_indexed, bm25_pruned, ab_evaluated, ledger_incremental, cell_edges, cell_rescue, cell_recall, cell_pruning,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}
