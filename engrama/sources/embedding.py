"""Vectors for texts: from a model inside tasks, or from a cache of what was embedded before."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engrama.functions.text import content_hash

Embed = Callable[[list[str]], list[list[float] | None]]


def embedding(embed: Embed, text: Column) -> Column:
    """embed(texts) batch by batch in the tasks; null texts have no vector. embed must reach the executors by pickling."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            there = texts.notna()
            vectors = iter(embed(texts[there].tolist()) if there.any() else [])
            yield pd.Series([next(vectors) if ok else None for ok in there], index=texts.index, dtype=object)

    return run(text)


def from_cache(texts: DataFrame, cache: DataFrame, refresh: Embed | None = None) -> tuple[DataFrame, DataFrame]:
    """texts (text and others) with embedding, and the cache (hash, embedding) that they come from, filled up where it lacked one.

    Without refresh a text that the cache lacks is an error, so that runs stay offline and repeatable.
    """
    keyed = texts.withColumn("hash", content_hash(F.col("text")))
    missing = keyed.where("text IS NOT NULL").select("hash", "text").dropDuplicates(["hash"]).join(cache.select("hash"), "hash", "left_anti")
    if refresh is None:
        n = missing.count()
        if n:
            raise LookupError(f"{n} texts are not in the cache")
    else:
        cache = cache.select("hash", "embedding").unionByName(missing.select("hash", embedding(refresh, F.col("text")).alias("embedding")))
    return keyed.join(cache.select("hash", "embedding"), "hash", "left").drop("hash"), cache
