"""Driver queries of this subpackage: one opN_<name> per operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrama.llm import conversations, pieces, warc
from engrama.llm.decontaminate import contamination
from engrama.llm.licenses import licenses
from engrama.llm.line_dedup import line_duplicates
from engrama.llm.pages import main_text
from engrama.llm.periodic import periodic_runs, strongest, with_planted_runs
from engrama.llm.pii import personal_data
from engrama.llm.quality import quality
from engrama.llm.reshard import resharded
from engrama.llm.shared import scratch_path, table
from engrama.llm.simhash import near_duplicates
from engrama.llm.tokens import token_counts


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op2_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 12 shards by source, one of which holds the hot source, to 16 of equal bytes: written, rewritten and read back."""
    out = resharded(table(spark, sf_dir, "documents"), F.pmod(F.xxhash64("source"), F.lit(12)), 16, scratch_path(spark, "shards"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "old_shard")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses are decoded and measured; of the others only headers are read. Both predicates are pushed into the archives' reader."""
    path = scratch_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    whole = warc.read(spark, path).where("record_type = 'response'")
    whole = whole.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to")
    again = warc.read(spark, path, payload=False).where("record_type = 'revisit'").select(*whole.columns)
    return whole.unionByName(again)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_duplicates(table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    top, lines = strongest(F.col("runs")), F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = out.withColumn("top", top)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", F.expr("1000 * top.length DIV top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return conversations.repaired_digests(turns, conversations.damaged(turns))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
