"""Periodic runs of words, by bit-parallel lags.

A text's words become numbers, and bit b of all of them one big integer (plane b). Plane XOR
plane shifted by a lag has ones where words that far apart differ in that bit; the OR over planes
marks every mismatch. A run is a long stretch of zeros, which shift-doubling AND isolates: each step doubles the
length of stretch that a one stands for, so a lag takes logarithmically many operations on whole integers.

Lags from DENSE on are shifted only where a run can have them: with s the power of two that
a lag starts with, its matches cover s places in a row that begin at a multiple of s, so equal blocks of s words stand
there and a lag further. Blocks are numbered by doubling, and nothing that holds a run is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engrama.llm.shared import SPACE_GAP, SPACE_WORD, split_words, without

#: A run has at least so many words, and so many periods.
LEAST, REPEATS = 24, 3
#: Lags under this one are all shifted.
DENSE = 64
WORDS = re.compile(SPACE_WORD)

Run = tuple[int, int, int]  # start, length, period


def planes(ids: np.ndarray) -> list[int]:
    """Bit b of all ids as one integer, place 0 lowest."""
    bits = int(ids.max()).bit_length() if len(ids) else 0
    return [int.from_bytes(np.packbits((ids >> b) & 1, bitorder="little").tobytes(), "little") for b in range(max(bits, 1))]


def long_stretches(ones: int, least: int) -> int:
    """The places from which on at least `least` ones stand in a row."""
    held = 1
    while ones and held < least:
        step = min(held, least - held)
        ones &= ones >> step
        held += step
    return ones


def stretches(ones: int) -> Iterator[tuple[int, int]]:
    """(first place, length) of each row of ones."""
    at = 0
    while ones:
        skip = (ones & -ones).bit_length() - 1
        ones >>= skip
        n = (~ones & (ones + 1)).bit_length() - 1
        yield at + skip, n
        ones >>= n
        at += skip + n


def matches(bits: list[int], n: int, lag: int, least: int) -> int:
    """Places from which on `least` words in a row equal those a lag further. The first plane rules most lags out."""
    full = (1 << n - lag) - 1
    differ = (bits[0] ^ bits[0] >> lag) & full
    if not long_stretches(differ ^ full, least):
        return 0
    for p in bits[1:]:
        differ |= p ^ p >> lag
    return long_stretches(differ & full ^ full, least)


def _pairs(ids: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that are multiples of s, and lags from s to 2s-1, at which the block numbers are equal."""
    at, lag = [], np.arange(s, 2 * s)
    anchors = np.arange(0, len(ids) - s, s)
    for lo in range(0, len(anchors), max(1, (1 << 18) // s)):
        a = anchors[lo : lo + max(1, (1 << 18) // s)]
        there = a[:, None] + lag[None, :]
        same = ids[np.minimum(there, len(ids) - 1)] == ids[a][:, None]
        i, j = np.nonzero(same & (there < len(ids)))
        at.append(np.stack([a[i], lag[j]]))
    both = np.concatenate(at, axis=1) if at else np.zeros((2, 0), np.int64)
    return both[0], both[1]


def _double(ids: np.ndarray, s: int) -> np.ndarray:
    """Numbers of blocks of 2s words from those of s."""
    if len(ids) <= s:
        return ids[:0]
    return np.unique(ids[:-s] * (int(ids.max()) + 1) + ids[s:], return_inverse=True)[1].astype(np.int64)


def runs(words: list[str]) -> list[Run]:
    """All runs of a text's words, by start, then period.

    A stretch of a lag that lies inside a run of a smaller period dividing it is that run seen at a multiple of its period.
    """
    n = len(words)
    if n < LEAST:
        return []
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    bits, found, by_period = planes(ids), [], {}

    def shift(lag: int) -> None:
        least = max(LEAST, REPEATS * lag) - lag
        for start, more in stretches(matches(bits, n, lag, least)):
            end = start + more - 1 + least + lag
            if not any(lag % p == 0 and any(a <= start and end <= b for a, b in of) for p, of in by_period.items()):
                found.append((start, end - start, lag))
                new.append((start, end))

    block, size = ids, 1
    for lag in range(1, min(DENSE - 1, n // REPEATS) + 1):
        new: list[tuple[int, int]] = []
        shift(lag)
        if new:
            by_period[lag] = new
    while size < DENSE and len(block):
        block, size = _double(block, size), 2 * size
    while size <= n // REPEATS and len(block):
        at, lags = _pairs(block, size)
        left = lags <= n // REPEATS
        for start, length, p in found if left.any() else ():  # pairs inside a run of a period that divides their lag say nothing new
            lo, hi = np.searchsorted(at, (start, start + length))
            left[lo:hi] &= (lags[lo:hi] % p != 0) | (at[lo:hi] + lags[lo:hi] + size > start + length)
        for lag in np.unique(lags[left]).tolist():
            new = []
            shift(lag)
            if new:
                by_period[lag] = new
        block, size = _double(block, size), 2 * size
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept(n: int, found: list[Run]) -> np.ndarray:
    """Whether each of n words stays: those that a run holds after its first period go."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Adds runs (array of start, length, period as longs, by start, then period) and collapsed (the kept words, a space between) to each row; the text is not returned.

    A run is a stretch of words with smallest period q, at least max(24, 3q) long, that no neighbouring word extends.
    Null, empty and blank texts have no words: no runs and an empty collapsed text. Repeated rows are
    all returned, an empty table gives none, and columns of these names are replaced.
    """
    rest = without(docs, "runs", "collapsed", "text")
    packed = docs.select(F.struct(*[rest[c] for c in rest.columns]).alias("row"), F.col("text"))
    found = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_runs, texts = [], []
            for i in range(b.num_rows):
                words = WORDS.findall(b.column(1)[i].as_py() or "")
                mine = runs(words)
                all_runs.append([{"start": s, "length": n, "period": p} for s, n, p in mine])
                texts.append(" ".join(w for w, k in zip(words, kept(len(words), mine), strict=True) if k) if mine else " ".join(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(all_runs, found), pa.array(texts, pa.string())], ["row", "runs", "collapsed"])

    schema = f"row {packed.schema['row'].dataType.simpleString()}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return packed.mapInArrow(run, schema).select("row.*", "runs", "collapsed")


def strongest(found: Column) -> Column:
    """The run with the greatest length / period, compared exactly; ties go to the smallest start, then period. Null without runs."""
    def order(a: Column, b: Column) -> Column:
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        keys = [(right, left), (a["start"], b["start"]), (a["period"], b["period"])]
        out = F.lit(0)
        for x, y in reversed(keys):
            out = F.when(x < y, -1).when(x > y, 1).otherwise(out)
        return out

    return F.get(F.array_sort(found, order), 0)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """docs in which a tenth of the texts, chosen by the CRC-32 of doc_id, repeat a few of their words up to the end; a null doc_id is never chosen."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, words = F.floor(h / 10), split_words(F.col("text"), SPACE_GAP)
    chosen = docs.withColumns({"_w": F.when(h % 10 == 0, words), "_g": g}).withColumn("_n", F.size(F.coalesce("_w", F.array().cast("array<string>"))))
    a = F.col("_g") % F.greatest("_n", F.lit(1))
    chosen = chosen.withColumn("_a", a.cast("int")).withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    cycle = F.slice("_w", F.col("_a") + 1, F.col("_p"))
    again = F.slice(F.flatten(F.array_repeat(cycle, (F.ceil((F.col("_n") - F.col("_a")) / F.col("_p"))).cast("int"))), F.lit(1), F.col("_n") - F.col("_a"))
    planted = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), again), " ")
    return chosen.withColumn("text", F.when(F.col("_n") > 0, planted).otherwise(F.col("text"))).select(*docs.columns)
