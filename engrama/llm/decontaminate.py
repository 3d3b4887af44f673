"""Benchmark decontamination with DataFrame functions only.

The hash set of the benchmark's normalised word windows is broadcast (behind a
check of its size); each document's windows probe it inside one scan, hits are
verified word by word, and only hits and one row per document are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engrama.llm.shared import ALNUM_GAP, fold_ascii, if_small, let, materialise, split_words

WINDOW = 10
#: Windows that may be broadcast: about 100 bytes each in memory.
BROADCAST_WINDOWS = 1_000_000


def words_of(text: Column) -> Column:
    return split_words(fold_ascii(text), ALNUM_GAP)


def _windows(ids: Column, n: Column | int) -> Column:
    """Hashes of all runs of n word hashes."""
    return F.when(F.size(ids) >= n, F.transform(F.sequence(F.lit(1), F.size(ids) - n + 1), lambda i: F.xxhash64(F.slice(ids, i, n)))).otherwise(F.array().cast("array<long>"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """key, gram, len and the items (strings, sorted) of each distinct window; an item of fewer words is one window, one of none has none."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("len", F.least(F.size("w"), F.lit(window)))
    grams = items.select("item", "len", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1), lambda i: F.slice("w", i, F.col("len")))).alias("g"))
    keyed = grams.select("item", "len", F.array_join("g", " ").alias("gram"), F.xxhash64(F.transform("g", lambda w: F.xxhash64(w))).alias("key"))
    return keyed.groupBy("key", "gram", "len").agg(F.array_sort(F.collect_set("item")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of docs: the keep columns, n_words, n_hit, n_items, items_sha256, contaminated, items, hits.

    hits are (pos, len) of windows in words from 0. A null or empty text has
    no words. Rows with equal keep columns and texts are counted and given
    back as often as they came. Null item ids mark words but name no item.
    Empty tables give no rows, or no hits. keep must not clash with the names above.
    """
    grams = materialise(benchmark_windows(benchmark, window), "windows")
    sizes = grams.groupBy("len").agg(F.count("*").alias("n"), F.sum(F.size("items")).alias("held")).collect()  # at most `window` rows
    lengths, few = sorted(int(r["len"]) for r in sizes), sum(r["n"] for r in sizes) <= broadcast_windows and sum(r["held"] for r in sizes) <= 4 * broadcast_windows
    keep_cols = [F.col(c) for c in keep]
    base = docs.select(*keep_cols, F.md5(F.col("text").cast("binary")).alias("_t"), words_of(F.col("text")).alias("_w"))
    base = base.withColumn("_n", F.size("_w"))

    def probes(ids: Column) -> Column:
        return F.concat(*[_windows(ids, n) for n in lengths])

    def at() -> Column:
        """The place of a probe, counted within its own length."""
        before, out = F.lit(0), None
        for n in lengths:
            place = F.col("_i") - before
            out = F.when(F.col("len") == n, place) if out is None else out.when(F.col("len") == n, place)
            before = before + F.greatest(F.col("_n") - (n - 1), F.lit(0))
        return out

    if not lengths:
        return base.select(*keep_cols, *_digest(F.col("_n"), F.array().cast("array<struct<pos:int,len:int>>"), F.array().cast("array<string>")))
    base = base.withColumn("_p", let(F.transform("_w", lambda w: F.xxhash64(w)), probes))
    if few:
        # the row that starts each array stands for the document, and matches nothing
        rows = base.select(*keep_cols, "_t", "_n", "_w", F.posexplode(F.concat(F.array(F.lit(None).cast("long")), "_p")).alias("_j", "_k")).withColumn("_i", F.col("_j") - 1)
        found = rows.join(F.broadcast(grams), F.col("_k") == F.col("key"), "left").where((F.col("_j") == 0) | F.col("key").isNotNull())
        found = found.withColumn("_pos", at()).withColumn("_ok", F.array_join(F.slice("_w", F.col("_pos") + 1, F.col("len")), " ") == F.col("gram"))
        found = found.where((F.col("_j") == 0) | F.col("_ok")).select(*keep_cols, "_t", "_n", (F.col("_j") == 0).cast("int").alias("_one"), F.when(F.col("_j") > 0, F.struct(F.col("_pos").cast("int").alias("pos"), F.col("len").alias("len"))).alias("_hit"), "items")
    else:
        # both sides are dealt by window; the words come in again only for documents with a candidate
        rows = base.select(F.struct(*keep_cols).alias("_r"), "_t", "_n", F.posexplode("_p").alias("_i", "_k"))
        match = rows.join(grams.hint("merge"), F.col("_k") == F.col("key")).select("_r", "_t", at().cast("int").alias("pos"), "len", "gram", "items")
        match = match.groupBy("_r", "_t").agg(F.collect_list(F.struct("pos", "len", "gram", "items")).alias("_m"))
        whole = base.select(F.struct(*keep_cols).alias("_r"), "_t", "_n", "_w").groupBy("_r", "_t").agg(F.first("_n").alias("_n"), F.first("_w").alias("_w"), F.count("*").cast("int").alias("_one"))
        whole = whole.join(match.withColumnsRenamed({"_r": "_r2", "_t": "_t2"}), F.col("_r").eqNullSafe(F.col("_r2")) & F.col("_t").eqNullSafe(F.col("_t2")), "left")
        whole = whole.withColumn("_m", F.filter(F.coalesce("_m", F.array().cast(match.schema["_m"].dataType)), lambda m: F.array_join(F.slice(F.col("_w"), m["pos"] + 1, m["len"]), " ") == m["gram"]))
        found = whole.select(*[F.col("_r")[c].alias(c) for c in keep], "_t", "_n", "_one", F.explode(F.concat(F.array(F.lit(None).cast(match.schema["_m"].dataType.elementType)), "_m")).alias("_m"))
        found = found.select(*keep_cols, "_t", "_n", F.when(F.col("_m").isNull(), F.col("_one")).otherwise(0).alias("_one"), F.when(F.col("_m").isNotNull(), F.struct(F.col("_m.pos").alias("pos"), F.col("_m.len").alias("len"))).alias("_hit"), F.col("_m.items").alias("items"))
    grouped = found.groupBy(*keep, "_t", "_n").agg(F.sum("_one").alias("_copies"), F.array_sort(F.collect_set("_hit")).alias("_hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("_items"))
    out = grouped.select(*keep_cols, "_n", "_hits", "_items", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy"))
    return out.select(*keep_cols, *_digest(F.col("_n"), F.col("_hits"), F.col("_items")))


def _digest(n: Column, hits: Column, items: Column) -> list[Column]:
    step = lambda acc, x: F.struct(
        F.greatest(acc["end"], x["pos"] + x["len"]).alias("end"),
        (acc["n"] + F.greatest(F.lit(0), x["pos"] + x["len"] - F.greatest(acc["end"], x["pos"]))).alias("n"),
    )
    covered = F.aggregate(hits, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda acc: acc["n"]).cast("long")
    return [n.cast("long").alias("n_words"), covered.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size(hits) > 0).alias("contaminated"), items.alias("items"), hits.alias("hits")]


def remove_spans(text: Column, hits: Column) -> Column:
    """The text without the words that hits cover; what stands between words stays."""
    raw = F.regexp_extract_all(text, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), 1)
    gaps = F.split(text, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    gone = F.array_distinct(F.flatten(F.transform(hits, lambda x: F.sequence(x["pos"], x["pos"] + x["len"] - 1))))
    kept = lambda parts: F.array_join(F.transform(parts["g"], lambda g, i: F.when((i == 0) | F.array_contains(parts["x"], i - 1), g).otherwise(F.concat(F.get(parts["w"], i - 1), g))), "")
    return F.when(F.size(hits) == 0, text).otherwise(let(F.struct(raw.alias("w"), gaps.alias("g"), gone.alias("x")), kept))


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "documents", window: int = WINDOW, broadcast_rows: int = 1_000_000) -> DataFrame:
    """docs without contaminated documents, or (action "spans") with the hit words cut out of their texts and n_chars (if there) counted anew. Same columns as docs, whatever their names.

    Null and empty texts are clean. Rows of equal id and text share their
    verdict, null ids included. An empty benchmark leaves docs as they are, and empty docs give no rows.

    The contaminated rows' ids and text digests are written first; they (and the places to cut) are
    broadcast if small and joined by shuffle beyond. Texts of clean
    documents are not moved in the first case.
    """
    digest = F.md5(F.col("text").cast("binary"))
    bad = contamination(docs.select("doc_id", "text", digest.alias("digest")), benchmark, window, keep=("doc_id", "digest")).where("contaminated")
    same = lambda left, right: left["doc_id"].eqNullSafe(right["_d"]) & left["digest"].eqNullSafe(right["_t"])
    packed = docs.select("doc_id", digest.alias("digest"), F.struct("*").alias("_row"))
    if action == "documents":
        bad = if_small(materialise(bad.select(F.col("doc_id").alias("_d"), F.col("digest").alias("_t")).distinct(), "contaminated"), broadcast_rows)
        return packed.join(bad, same(packed, bad), "left_anti").select("_row.*")
    bad = bad.groupBy(F.col("doc_id").alias("_d"), F.col("digest").alias("_t")).agg(F.first("hits").alias("hits"))
    bad = if_small(materialise(bad, "contaminated"), broadcast_rows, "hits")
    text = F.when(F.col("hits").isNull(), F.col("_row")["text"]).otherwise(remove_spans(F.col("_row")["text"], F.col("hits")))
    new = {"text": text} | ({"n_chars": F.when(F.col("hits").isNull(), F.col("_row")["n_chars"]).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))} if "n_chars" in docs.columns else {})
    return packed.join(bad, same(packed, bad), "left").select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
