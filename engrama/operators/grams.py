"""Substring search by an index of grams.

A posting is a gram of one to three word characters and the memories whose text holds it: a bitmap per bucket of places.
A word of at most three characters is a gram itself; a longer one can only occur where all its grams do,
so the bitmaps of its grams are intersected, and only the texts left are looked through. Bitmaps and texts of a bucket meet in one
task, which adds up scores from them and hands on k rows per query, so words and memories never meet as rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrama.functions.text import tokens
from engrama.operators import lexical

#: Places of one bitmap, and characters of the longest gram.
BUCKET, LONGEST = 2_048, 3
#: Bytes of a matrix of queries and memories.
MATRIX = 64 << 20
#: Buckets of one task: about so many tasks, but no more buckets in one.
TASKS, BUCKETS = 96, 16
POSTING = "gram string, bucket long, bits binary"


#: Characters of runs as digits from 1, all other bytes as 0; texts whose grams are marked at once.
CHARACTERS = "0123456789_abcdefghijklmnopqrstuvwxyz"
DIGIT, BASE, TEXTS = np.array([CHARACTERS.find(chr(c)) + 1 for c in range(256)], np.int64), len(CHARACTERS) + 1, 256


def _marked(texts: list[str | None], at: np.ndarray) -> Iterator[tuple[str, bytes]]:
    """The grams of texts in lower case, with the bitmap of the texts' places in a bucket."""
    bits = np.zeros((BASE**LONGEST, BUCKET // 8), np.uint8)
    for lo in range(0, BUCKET, TEXTS):
        mine = np.flatnonzero((at >= lo) & (at < lo + TEXTS))
        if not len(mine):
            continue
        raw = [(texts[i] or "").encode() + b" " for i in mine]
        digit = DIGIT[np.frombuffer(b"".join(raw), np.uint8)]
        place = np.repeat(at[mine] - lo, [len(r) for r in raw])
        flags, code, inside = np.zeros((BASE**LONGEST, TEXTS), bool), np.zeros(len(digit), np.int64), np.ones(len(digit), bool)
        for n in range(LONGEST):  # the gram of n + 1 characters that ends at a place
            back = np.pad(digit, (n, 0))[: len(digit)]
            inside &= back > 0
            code += back * BASE**n
            flags[code[inside], place[inside]] = True
        bits[:, lo // 8 : (lo + TEXTS) // 8] = np.packbits(flags, axis=1, bitorder="little")
    for code in np.flatnonzero(bits.any(axis=1)).tolist():
        digits = [code // BASE**n % BASE for n in reversed(range(LONGEST))]
        yield "".join(CHARACTERS[d - 1] for d in digits if d), bits[code].tobytes()


def _bucket(places: DataFrame) -> DataFrame:
    return places.withColumn("bucket", F.floor(F.col("_pos") / BUCKET))


def build(memories: DataFrame) -> DataFrame:
    """POSTING of memories (_pos, text; places are not negative and unique). The empty gram stands for every memory, null texts too. Each text goes to its bucket, where the bitmaps are made."""

    def index(group: pa.Table) -> pa.Table:
        at = group["_pos"].to_numpy() % BUCKET
        out = [("", sum(1 << x for x in at.tolist()).to_bytes(BUCKET // 8, "little")), *_marked(group["text"].to_pylist(), at)]
        columns = [pa.array([g for g, _ in out], pa.string()), pa.array([group["bucket"][0].as_py()] * len(out), pa.int64()), pa.array([x for _, x in out], pa.binary())]
        return pa.table(columns, names=["gram", "bucket", "bits"])

    return _bucket(memories.select(F.col("_pos").cast("long").alias("_pos"), F.lower("text").alias("text"))).groupBy("bucket").applyInArrow(index, POSTING)


def write(postings: DataFrame, path: str) -> None:
    """Postings in the order of their grams, so that a search reads the row groups of its own grams only."""
    postings.repartitionByRange("gram", "bucket").sortWithinPartitions("gram", "bucket").write.parquet(path)


def grams_of(word: str) -> list[str]:
    return sorted({word[i : i + LONGEST] for i in range(max(1, len(word) - LONGEST + 1))})


def _needed(words: list[str], postings: DataFrame) -> DataFrame:
    """The postings of the words' grams."""
    names = pd.DataFrame({"gram": sorted({g for w in words for g in grams_of(w)})}, dtype=object)
    return postings.join(F.broadcast(postings.sparkSession.createDataFrame(names, "gram string")), "gram", "left_semi")  # the grams of one pass


def _bits(table: pa.Table) -> dict[int, dict[str, int]]:
    """bucket: gram: its bitmap as a number."""
    out: dict[int, dict[str, int]] = {}
    for gram, bucket, bits in zip(*(table[c].to_pylist() for c in ("gram", "bucket", "bits")), strict=True):
        out.setdefault(bucket, {})[gram] = int.from_bytes(bits, "little")
    return out


def _all(grams: list[str], bits: dict[str, int]) -> int:
    """Which memories hold all grams."""
    held = bits.get(grams[0], 0)
    for g in grams[1:]:
        if not held:
            break
        held &= bits.get(g, 0)
    return held


def _at(held: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(held.to_bytes(BUCKET // 8, "little"), np.uint8), bitorder="little"))


class _Words:
    """Words with their grams, and a reader of the longer ones, which a task makes for itself."""

    def __init__(self, words: list[str]):
        self.grams = [grams_of(w) for w in words]
        self.short = [i for i, w in enumerate(words) if len(w) <= LONGEST]
        self.long = [i for i, w in enumerate(words) if len(w) > LONGEST]
        self.words, self.read = words, None

    def holding(self, bits: dict[str, int], texts: dict[int, str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words and the places in a bucket whose texts hold them, by place. Only texts that hold all grams of a longer word are looked through."""
        if self.read is None:
            self.read = lexical.inside({self.words[i]: i for i in self.long}, len(self.words))
        open_ = 0
        for i in self.long:
            open_ |= _all(self.grams[i], bits)
        places = _at(open_)
        word, which, _ = self.read([texts.get(at) for at in places.tolist()])
        held = [_at(_all(self.grams[i], bits)) for i in self.short]
        word = np.concatenate([word, np.repeat(np.array(self.short, np.int64), [len(x) for x in held])])
        at = np.concatenate([places[which], *held])
        order = np.argsort(at, kind="stable")
        return word[order], at[order]


def _meet(words: list[str], memories: DataFrame, postings: DataFrame, buckets: int, use: Callable, schema: str) -> DataFrame:
    """use() of the postings of the words' grams and the memories (id, _pos, text in lower case) of so many buckets at a time."""
    rows = _bucket(memories.select(F.col("id").cast("string").alias("id"), F.col("_pos").cast("long").alias("_pos"), F.lower("text").alias("text")))
    side = lambda df: df.groupBy(F.floor(F.col("bucket") / buckets).alias("_group"))
    return side(_needed(words, postings)).cogroup(side(rows)).applyInArrow(use, schema)


def holding(words: list[str], memories: DataFrame, postings: DataFrame) -> DataFrame:
    """(word, bucket, bits): the memories whose text holds each word (in lower case, of word characters)."""
    def use(held: pa.Table, mem: pa.Table) -> pa.Table:
        texts, known, out = {p % BUCKET: t for p, t in zip(mem["_pos"].to_pylist(), mem["text"].to_pylist(), strict=True)}, _Words(words), []
        for bucket, bits in _bits(held).items():
            word, at = known.holding(bits, texts)
            for i in np.unique(word).tolist():
                flags = np.zeros(BUCKET, np.uint8)
                flags[at[word == i]] = 1
                out.append((words[i], bucket, np.packbits(flags, bitorder="little").tobytes()))
        return pa.table([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.string(), pa.int64(), pa.binary()))], names=["word", "bucket", "bits"])

    return _meet(words, memories, postings, 1, use, "word string, bucket long, bits binary")


def _counter(block: list[tuple[str, list[str]]]) -> Callable[[pa.Table], pa.Table]:
    def count(held: pa.Table) -> pa.Table:
        n = [0] * len(block)
        for bits in _bits(held).values():
            known = {w: _all(grams_of(w), bits) for w in {w for _, tok in block for w in tok}}
            for q, (_, tok) in enumerate(block):
                any_ = 0
                for w in tok:
                    any_ |= known[w]
                n[q] += any_.bit_count()
        return pa.table([pa.array([q for q, _ in block], pa.string()), pa.array(n, pa.int64())], names=["q_id", "n"])

    return count


def reads(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """(q_id, memories): how many memories each query (q_id, text) has to read: those that hold all grams of one of its longer words."""
    asked = queries.select(F.col("q_id").cast("string").alias("q_id"), F.filter(tokens(F.col("text")), lambda w: F.length(w) > LONGEST).alias("tok"))
    parts = None
    for block in lexical.query_blocks(asked):
        part = _needed(sorted({w for _, tok in block for w in tok}), postings).groupBy("bucket").applyInArrow(_counter(block), "q_id string, n long")
        part = part.groupBy("q_id").agg(F.sum("n").alias("memories"))
        parts = part if parts is None else parts.unionByName(part)
    return queries.select(F.col("q_id").cast("string").alias("q_id")).join(parts, "q_id", "left").select("q_id", F.coalesce("memories", F.lit(0)).alias("memories"))


def _scorer(of: lexical.Block, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """From the bitmaps and texts of some buckets to the k best memories of each query."""
    known, size = _Words(of.words), np.maximum(of.size, 1)
    step = max(1, MATRIX // (8 * max(1, min(lexical.QUERIES, len(of.names)))))

    def score(held: pa.Table, mem: pa.Table) -> pa.Table:
        asks = lexical.Asks(len(of.names), len(of.words), of.rows, of.cols, None)
        bests = [lexical.Best(n, k) for _, n, *_ in asks.parts]  # of hits, as a query's words are the same for all memories
        bits, pos, ids, text = _bits(held), mem["_pos"].to_numpy(), mem["id"].to_numpy(), mem["text"].to_pylist()
        for bucket in np.unique(pos // BUCKET).tolist():
            mine = np.flatnonzero(pos // BUCKET == bucket)
            mine = mine[np.argsort(pos[mine])]
            at = pos[mine] - bucket * BUCKET
            word, place = known.holding(bits.get(bucket, {}), dict(zip(at.tolist(), (text[i] for i in mine), strict=True)))
            col = np.searchsorted(at, place)
            for lo in range(0, len(mine), step):
                here, part = slice(*np.searchsorted(col, (lo, lo + step))), mine[lo : lo + step]
                for some, *words in lexical.alike(of, word[here], col[here] - lo, None, len(part)):
                    for i, best in enumerate(bests):
                        best.add(asks.meet(i, *words, len(some)), pos[part[some]], ids[part[some]])
        for (lo, *_), best in zip(asks.parts, bests, strict=True):
            best.score = best.score / size[best.row + lo]
        out = pd.concat([best.rows(of.names[lo : lo + n]) for (lo, n, *_), best in zip(asks.parts, bests, strict=True)])
        types = (pa.string(), pa.string(), pa.int64(), pa.float64())
        return pa.table([pa.array(out[c].to_numpy(), t) for c, t in zip(("q_id", "id", "_pos", "score"), types, strict=True)], names=["q_id", "id", "_pos", "score"])

    return score


def keyword_recall(queries: DataFrame, memories: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """recall.keyword_recall() by postings of these memories: (q_id, rnk, id, score) by share of query words found, ties by place; a query without any hit gets the first memory."""
    asked = queries.select(F.col("q_id").cast("string").alias("q_id"), tokens(F.col("text")).alias("tok"))
    buckets = min(BUCKETS, max(1, -(-postings.where("gram = ''").count() // TASKS)))
    parts = []
    for block in lexical.query_blocks(asked):
        if block:
            of = lexical.gathered(block)
            parts.append(_meet(of.words, memories, postings, buckets, _scorer(of, k), "q_id string, id string, _pos long, score double"))
    if not parts:
        return memories.sparkSession.createDataFrame([], "q_id string, rnk int, id string, score double")
    best = lexical.top(parts, k, 12)
    return best.where((F.col("score") > 0) | (F.col("rnk") == 1)).select("q_id", "rnk", "id", "score")
