"""From raw documents to token ids: quality rules, line dedup, near-duplicates, benchmark decontamination, SentencePiece.

Each stage works on all that the one before kept; every stage but the last
returns the columns of documents. Columns beyond those of documents pass through all stages but the last,
whatever their names. An empty table gives an empty one at every stage, and an
empty benchmark takes nothing away.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from engrama.llm import pieces
from engrama.llm.decontaminate import decontaminate
from engrama.llm.line_dedup import dedup_lines
from engrama.llm.quality import keep_good
from engrama.llm.shared import materialise, table
from engrama.llm.simhash import keep_one
from engrama.session import ship

#: The tokenizer file; every machine needs it at the same path.
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior rejects, and those that fail the base rules, go.

    Null and empty texts go, as they have no words; rows of equal id and text stay or go together.
    """
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line of the corpus go from their texts; every document stays.

    Documents are ordered by doc_id, null first, equal ones by their text's digest; rows that
    repeat an id and a text are one document. A null text stays null, one that loses all lines becomes empty.
    """
    return dedup_lines(docs, least=1)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: that with the smallest doc_id, with all rows of that id.

    Null and empty texts have fingerprint zero and are near-duplicates of each other. Rows without doc_id stay.
    """
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go. Null and empty texts hold none; rows of equal id and text stay or go together."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and their digests of each row that is left, repeated ones too. Null and empty texts have no ids."""
    return pieces.encode(docs.select("doc_id", "lang", "source", "text"), MODEL)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: SQL expresses neither the EM model nor fingerprints, components and merges; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
