"""Many stores at once: saves replayed in order, and evaluation cases, each in a store of its own."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engrama.functions.text import is_historical
from engrama.operators import evaluation, temporal
from engrama.operators.recall import in_scope, listing
from engrama.plans import recall_plan, saves

REPLAYED = "store_id string, id string, _pos long, text string, embedding array<double>, valid_from timestamp, valid_to timestamp, last_confirmed timestamp, supersedes string, superseded_by string, revision int, is_constraint boolean, deleted boolean"


def replay(writes: DataFrame, floor: float = temporal.FLOOR) -> DataFrame:
    """Memories (REPLAYED) after the writes (store_id, _pos, text, embedding, at) of many stores, each in the order of _pos.

    As for a single save: empty texts are nothing, a current memory with the very text is confirmed, a
    text that announces a change closes the most similar current memory at or above floor. Only writes that can
    affect one another are folded in order (saves.resolve()), so one store takes as many tasks as many do. Ids are
    store:number, unique over all stores.
    """
    nodes = saves.prepared(writes).checkpoint()
    kept = saves.resolve(nodes, floor).checkpoint()
    ids = saves.numbered(kept.select("store_id", "seq")).withColumn("id", F.concat_ws(":", "store_id", "number")).checkpoint()
    other = lambda seq, name: ids.select("store_id", F.col("seq").alias(seq), F.col("id").alias(name))
    out = kept.join(nodes.select("store_id", "seq", "text", "embedding", "at", "rule"), ["store_id", "seq"]).join(ids, ["store_id", "seq"])
    out = out.join(other("closes", "supersedes"), ["store_id", "closes"], "left").join(other("closed_by", "superseded_by"), ["store_id", "closed_by"], "left")
    return out.select(
        F.col("store_id").cast("string").alias("store_id"), "id", F.col("number").alias("_pos"), "text", "embedding", F.col("at").alias("valid_from"), F.col("closed").alias("valid_to"), F.col("confirmed").alias("last_confirmed"),
        "supersedes", "superseded_by", "revision", F.col("rule").alias("is_constraint"), F.lit(False).alias("deleted"),
    )


def saved(memories: DataFrame, writes: DataFrame, top: int, place: int, floor: float = temporal.FLOOR) -> tuple[DataFrame, DataFrame]:
    """What saving writes (_pos, text, embedding, at) into a store of memories makes: new rows (MEMORY and _pos), and patches (id and the columns that change) of memories that were there.

    top and place: the greatest number among ids and the greatest _pos so far. A new id is its time in milliseconds, or one more than the greatest before it.
    """
    old = in_scope(memories, False).select(F.lit(0).alias("store_id"), (F.col("_pos") - (place + 1)).alias("seq"), "text", "embedding", F.lit(None).cast("timestamp").alias("at"), F.lit(False).alias("cue"), F.lit(False).alias("rule"), F.lit(True).alias("there"), "revision", "id")
    coming = saves.prepared(writes.select(F.lit(0).alias("store_id"), "_pos", "text", "embedding", "at"))
    start = coming.agg(F.min("seq")).first()[0] or 0
    coming = coming.withColumn("seq", F.col("seq") - start).checkpoint()
    kept = saves.resolve(old.drop("id").unionByName(coming), floor).checkpoint()
    made = saves.numbered(kept.where("made"))
    # id i is i + the greatest of (time - place) up to it, found bucket by bucket
    lead = F.unix_millis("at") - F.col("number")
    made = made.join(coming.select("store_id", "seq", "text", "embedding", "at", "rule"), ["store_id", "seq"]).withColumns({"_lead": F.greatest(lead, F.lit(top)), "_b": F.floor(F.col("number") / saves.BUCKET)})
    ahead = made.groupBy("_b").agg(F.max("_lead").alias("_m")).withColumn("_before", F.max("_m").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select("_b", "_before")
    upto = F.max("_lead").over(Window.partitionBy("_b").orderBy("number"))
    made = made.join(ahead, "_b").withColumn("id", (F.greatest(upto, "_before") + F.col("number")).cast("string")).checkpoint()
    ids = made.select("seq", "id").unionByName(old.select("seq", "id")).checkpoint()
    other = lambda seq, name: ids.select(F.col("seq").alias(seq), F.col("id").alias(name))
    none = lambda t: F.lit(None).cast(t)
    new = made.join(other("closes", "supersedes"), "closes", "left").join(other("closed_by", "superseded_by"), "closed_by", "left")
    new = new.select(
        "id", F.col("at").alias("created"), F.coalesce("closed", "at").alias("modified"), "text", "embedding", F.lit(0.0).alias("importance"), F.lit(0).cast("long").alias("access_count"), none("timestamp").alias("last_access"),
        F.col("at").alias("valid_from"), F.col("closed").alias("valid_to"), F.col("confirmed").alias("last_confirmed"), "superseded_by", "supersedes", F.col("revision").cast("int").alias("revision"),
        F.lit(False).alias("needs_review"), F.lit("user_stated").alias("source"), F.col("rule").alias("is_constraint"), F.lit(False).alias("deleted"), (F.lit(place) + F.col("number")).cast("long").alias("_pos"),
    )
    changed = kept.where("NOT made AND (confirmed IS NOT NULL OR closed IS NOT NULL)").join(old.select("seq", "id"), "seq").join(other("closed_by", "superseded_by"), "closed_by", "left")
    return new, changed.select("id", F.col("confirmed").alias("last_confirmed"), F.col("closed").alias("valid_to"), F.col("closed").alias("modified"), "superseded_by")


def compare_options(cases: DataFrame, writes: DataFrame, a: recall_plan.Options, b: recall_plan.Options, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """(kind, a, b, delta, mark): the shares of cases that pass when recalls run with options a and with options b, per kind and over all (evaluation.compare()). Both run on the same replayed stores."""
    mem = _stores(cases, writes)
    runs = [_evaluated(cases, mem, o).select("kind", "pass", F.lit(n).alias("variant")) for n, o in zip(names, (a, b), strict=True)]
    return evaluation.compare(runs[0].unionByName(runs[1]), *names)


def evaluate(cases: DataFrame, writes: DataFrame, options: recall_plan.Options = recall_plan.Options(), prefix: str | None = None) -> DataFrame:
    """(id, kind, metric, field, key, pass, reasons, first_hit_turn, rescued, bled, appended) of recall cases, constraint ones with the field off and on.

    cases: id, kind, metric, field, query, embedding (of the query), contains, excludes, current_only. writes: store_id (the
    case's id), _pos, text, embedding, at. Every case has a store of its own; all run in one job.
    """
    cases = evaluation.with_prefix(cases, prefix)
    return _evaluated(cases, _stores(cases, writes), options)


def _stores(cases: DataFrame, writes: DataFrame) -> DataFrame:
    """The memories of the cases' stores."""
    return replay(writes.join(cases.select(F.col("id").alias("store_id")), "store_id", "left_semi")).checkpoint()


def _evaluated(cases: DataFrame, mem: DataFrame, options: recall_plan.Options) -> DataFrame:
    """evaluate() on replayed stores."""
    asked = cases.select(F.col("id").alias("q_id"), F.col("id").alias("store_id"), "embedding", is_historical(F.col("query")).alias("historical"))
    on = not cases.where((F.col("kind") == "constraint") | F.coalesce("field", F.lit(False))).isEmpty()  # else no case looks at the field
    got = recall_plan.run(asked, mem, replace(options, field=on), within="store_id")
    primary, related = got.primary.checkpoint(), got.related.checkpoint()
    # the field has something to add only where not all of a scope is returned
    sizes = [in_scope(mem, h).groupBy("store_id").agg(F.count("*").alias("n")).withColumn("historical", F.lit(h)) for h in (False, True)]
    more = asked.join(sizes[0].unionByName(sizes[1]), ["store_id", "historical"]).where(F.col("n") > options.returned).select("q_id")
    related = related.join(more, "q_id", "left_semi")
    shown = {False: listing(primary, mem, None, options.returned), True: listing(primary, mem, related, options.returned)}
    block = related.join(mem.select("id", "text"), "id").select(F.col("q_id").alias("case_id"), "text")
    signals = evaluation.signals(block, cases.select(F.col("id").alias("case_id"), "contains", "excludes"))
    out = None
    for on in (False, True):
        mine = cases.where((F.col("kind") == "constraint") | (F.coalesce("field", F.lit(False)) == on)).drop("field")
        part = mine.join(shown[on].select(F.col("q_id").alias("id"), F.col("listing").alias("output")), "id", "left").withColumn("field", F.lit(on))
        part = evaluation.score(part).join(signals.withColumnRenamed("case_id", "id"), "id", "left")
        quiet = lambda c, v: F.when(F.lit(on), F.col(c)).otherwise(F.lit(v)).alias(c)
        part = part.select("id", "kind", "metric", "field", evaluation.case_key(F.col("id"), F.col("kind"), F.col("field")).alias("key"), "pass", "reasons", "first_hit_turn", quiet("rescued", False), quiet("bled", 0), quiet("appended", 0))
        out = part if out is None else out.unionByName(part)
    return out
