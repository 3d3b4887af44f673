"""Ranking by words for a stated set of queries.

Queries are taken in blocks of a fixed size. A block's words are few, so they
travel with the code; memories are read in place and once for a block, each batch meets the block
part by part, and a task hands on at most k rows per query.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Queries of a pass over the memories, queries and memories of a matrix product, and bytes of its words and memories.
PASS, QUERIES, MEMORIES, HELD = 32_768, 2_048, 1_024, 64 << 20
#: The share of its pairs of queries and memories that a word must meet in to be part of a matrix product.
DENSE = 1 / 64
#: A word that meets in fewer pairs is added together with others, so many pairs at once.
LONE, AT_ONCE = 1 << 12, 1 << 21
#: The share for words that meet as lists: adding a pair takes as long as so many of a product. Pairs that are added up at once, so that they stay near the processor.
LISTED, CELLS = 1 / 400, 1 << 17
#: Groups of queries that ask for like words, the words by which they are told apart, and rounds of finding them. Memories of a group that are fewer join the next.
GROUPS, TELLING, ROUNDS, FEW = 8, 256, 6, 128
#: So many times what can rank are looked at without asking what does among themselves.
MANY = 4
#: Runs whose words a worker remembers.
REMEMBERED = 1 << 19
#: Maximal runs of ASCII word characters, which hold every place where a query's word can stand.
RUN = re.compile("[a-z0-9_]+")
#: All bytes but those of runs made blank.
APART = bytes(c if RUN.fullmatch(chr(c)) else 32 for c in range(256))
K1, B = 1.5, 0.75

#: From texts: the places of words in the block's list, which text holds each (in order), and their weights (1 for all if None).
Reader = Callable[[list[str | None]], tuple[np.ndarray, np.ndarray, np.ndarray | None]]


def runs_of(text: str | None) -> list[bytes]:
    """The runs of a text in lower case, in order."""
    return (text or "").lower().encode().translate(APART).split()


class Best:
    """The k best of each query so far: by score (to so many digits), then place. What cannot rank is neither sorted nor kept. floor: what a query's scores must reach from the start."""

    def __init__(self, queries: int, k: int, digits: int | None = None, floor: np.ndarray | None = None):
        self.k, self.digits = k, digits
        floor = np.full(queries, -np.inf) if floor is None else floor.copy()
        self.least, self.last = floor if digits is None else np.round(floor, digits), np.full(queries, np.iinfo(np.int64).max)
        self.row, self.key, self.score = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        self.pos, self.id = np.zeros(0, np.int64), np.zeros(0, object)

    def add(self, score: np.ndarray, pos: np.ndarray, ids: np.ndarray) -> None:
        by_place = np.ascontiguousarray(score.T)
        if not by_place.size:
            return
        bound = self._bound(by_place, int(pos.min()))
        found = np.flatnonzero(by_place >= bound)
        if len(found) > MANY * self.k * len(bound) and len(by_place) > self.k:  # floors are low yet: no more than what ranks among these
            bound = np.maximum(bound, np.partition(by_place, len(by_place) - self.k, axis=0)[len(by_place) - self.k] - self._slack(by_place.dtype))
            found = np.flatnonzero(by_place >= bound)
        j, i = np.divmod(found, by_place.shape[1])
        s = by_place[j, i].astype(float)
        key = s if self.digits is None else np.round(s, self.digits)
        ahead = (key > self.least[i]) | (key == self.least[i]) & (key > -np.inf) & (pos[j] < self.last[i])
        i, j, s, key = i[ahead], j[ahead], s[ahead], key[ahead]
        if not len(i):
            return
        met = np.zeros(len(self.least), bool)
        met[i] = True
        old = met[self.row]
        mine = (self.row, self.key, self.score, self.pos, self.id)
        row, key, s, place, id_ = (np.concatenate([x[old], y]) for x, y in zip(mine, (i, key, s, pos[j], ids[j]), strict=True))
        order = np.lexsort((place, -key, row))
        nth = np.arange(len(row)) - np.searchsorted(row[order], row[order])
        full = order[nth == self.k - 1]
        self.least[row[full]], self.last[row[full]] = key[full], place[full]
        kept = order[nth < self.k]
        self.row, self.key, self.score, self.pos, self.id = (np.concatenate([x[~old], y[kept]]) for x, y in zip(mine, (row, key, s, place, id_), strict=True))

    def _bound(self, by_place: np.ndarray, first: int) -> np.ndarray:
        """What scores (memories by queries, the first of them at a place) must reach to be looked at: a query's floor, or a little more if they all come after its k-th best."""
        slack, kind = 0.0 if self.digits is None else 10.0**-self.digits, by_place.dtype
        after = self.last <= first
        out = (self.least + np.where(after, slack / 4, -slack)).astype(kind)
        if self.digits is None:
            out[after] = np.nextafter(out[after], np.array(np.inf, kind))
        return out

    def _slack(self, kind: np.dtype) -> np.generic:
        return kind.type(0.0 if self.digits is None else 2 * 10.0**-self.digits)

    def rows(self, names: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"q_id": names[self.row], "id": self.id, "_pos": self.pos, "score": self.score})


def query_blocks(queries: DataFrame, size: int = PASS) -> Iterator[list[tuple[str, list[str]]]]:
    """(q_id, distinct words) of about `size` queries at a time; queries: q_id, tok."""
    blocks = max(1, -(-queries.count() // size))
    for b in range(blocks):
        yield [(r["q_id"], list(r["tok"])) for r in queries.where(F.pmod(F.xxhash64("q_id"), F.lit(blocks)) == b).collect()]  # one block


class Block(NamedTuple):
    """Queries, those that ask for like words (say, of one language) side by side: names and how many words each has; the words; in turn the query and the word of each; what tells groups apart: some words, and the middle of each group in them."""

    names: np.ndarray
    size: np.ndarray
    words: list[str]
    rows: np.ndarray
    cols: np.ndarray
    telling: np.ndarray
    middles: np.ndarray


def gathered(block: list[tuple[str, list[str]]]) -> Block:
    none = np.zeros(0, np.int64)
    if not block:
        return Block(np.zeros(0, object), none, [], none, none, none, np.zeros((0, 0), np.float32))
    words = sorted({w for _, tok in block for w in tok})
    place = {w: i for i, w in enumerate(words)}
    size = np.array([len(tok) for _, tok in block], np.int64)
    rows, cols = np.repeat(np.arange(len(block)), size), np.array([place[w] for _, tok in block for w in tok], np.int64)
    n = np.bincount(cols, minlength=len(words))
    telling = np.sort(np.argsort(-n, kind="stable")[:TELLING])
    flags = _flags(telling, len(words), cols, rows, len(block)) * np.log((len(block) + 1) / n[telling]).astype(np.float32)
    unit = np.divide(flags, length := np.sqrt((flags * flags).sum(axis=1, keepdims=True)), out=np.zeros_like(flags), where=length > 0)
    rng, middles = np.random.default_rng(0), unit[:1]
    while len(middles) < min(GROUPS, len(block)) and (far := np.maximum(0, 1 - (unit @ middles.T).max(axis=1)) ** 2 * (length[:, 0] > 0)).sum() > 0:
        middles = np.concatenate([middles, unit[rng.choice(len(unit), p=(far / far.sum(dtype=float)).astype(float) / (far / far.sum(dtype=float)).astype(float).sum())][None]])
    for _ in range(ROUNDS):
        group = (unit @ middles.T).argmax(axis=1)
        sums = np.stack([unit[group == g].sum(axis=0) for g in range(len(middles))])
        middles = np.divide(sums, length := np.sqrt((sums * sums).sum(axis=1, keepdims=True)), out=middles.copy(), where=length > 0)
    order = np.argsort((unit @ middles.T).argmax(axis=1), kind="stable")
    rank = np.empty(len(block), np.int64)
    rank[order] = np.arange(len(block))
    names = np.array([q for q, _ in block], object)
    return Block(names[order], size[order], words, rank[rows].astype(np.int32), cols.astype(np.int32), telling, middles * np.log((len(block) + 1) / n[telling]).astype(np.float32))


def _flags(telling: np.ndarray, words: int, word: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    code = np.full(words, -1)
    code[telling] = np.arange(len(telling))
    at = code[word]
    out = np.zeros((rows, len(telling)), np.float32)
    out[row[at >= 0], at[at >= 0]] = 1
    return out


def alike(block: Block, word: np.ndarray, column: np.ndarray, weight: np.ndarray | None, columns: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """So many memories with their words (by column) in parts of one group, up to MEMORIES each: which they are, and their words, columns in the part and weights."""
    group = (_flags(block.telling, len(block.words), word, column, columns) @ block.middles.T).argmax(axis=1) if len(block.middles) else np.zeros(columns, int)
    order, n = np.argsort(group, kind="stable"), np.bincount(column, minlength=columns)
    start, ends = np.cumsum(n) - n, np.cumsum(np.bincount(group)).tolist()
    lo = 0
    for end in ends:
        while end - lo >= FEW or end == columns > lo:
            some = order[lo : min(end, lo + MEMORIES)]
            which, at = _each(n[some], start[some])
            yield some, word[at], which, None if weight is None else weight[at]
            lo += len(some)


class Asks:
    """The words of queries as lists: for each of so many words the queries that ask for it, and its values for them (1 for all if None). In parts of QUERIES."""

    def __init__(self, queries: int, words: int, rows: np.ndarray, cols: np.ndarray, value: np.ndarray | None):
        by = np.argsort(cols, kind="stable")
        self.parts = []
        for lo in range(0, queries, QUERIES):
            mine = by[(rows[by] >= lo) & (rows[by] < lo + QUERIES)]
            n = np.bincount(cols[mine], minlength=words)
            self.parts.append((lo, min(QUERIES, queries - lo), n, np.cumsum(n) - n, rows[mine] - lo, None if value is None else value[mine]))

    def meet(self, part: int, word: np.ndarray, column: np.ndarray, weight: np.ndarray | None, columns: int, needed: np.ndarray | None = None) -> np.ndarray:
        """Scores of a part's queries and so many memories, whose words come by column (in order), with their weights. needed: flags of the queries that matter; others may score 0. Counts are exact in single precision."""
        _, queries, n, start, who, value = self.parts[part]
        if needed is not None and not needed.all():
            n, start, who, value = self._only(part, needed)
        some = n[word] > 0
        if not some.all():
            word, column, weight = word[some], column[some], None if weight is None else weight[some]
        kind = np.float32 if value is None and weight is None else np.float64
        there = np.bincount(word, minlength=len(n))
        dense = np.flatnonzero(n * there > LISTED * queries * columns)
        dense = dense[np.argsort(-(n * there)[dense], kind="stable")][: max(1, HELD // (8 * (queries + columns)))]
        code = np.full(len(n), -1)
        code[dense] = np.arange(len(dense))
        asked, held = np.zeros((len(dense), queries), kind), np.zeros((columns, len(dense)), kind)
        which, at = _each(n[dense], start[dense])
        asked[which, who[at]] = 1 if value is None else value[at]
        at = code[word]
        held[column[at >= 0], at[at >= 0]] = 1 if weight is None else weight[at >= 0]
        out = held @ asked
        word, column, weight = word[at < 0], column[at < 0], None if weight is None else weight[at < 0]
        step = max(1, CELLS // queries)
        for c in range(0, columns, step):
            lo, end = np.searchsorted(column, (c, c + step))
            ends = np.cumsum(n[word[lo:end]])
            first, cells = lo, out[c : c + step]
            while lo < end:
                hi = max(lo + 1, first + int(np.searchsorted(ends, (ends[lo - first - 1] if lo > first else 0) + AT_ONCE, "right")))
                w = word[lo:hi]
                which, at = _each(n[w], start[w])
                flat = ((column[lo:hi] - c) * queries)[which] + who[at]
                if kind is np.float32:
                    parts = np.bincount(flat, minlength=cells.size)
                else:
                    parts = np.bincount(flat, (1.0 if value is None else value[at]) * (np.ones(len(w)) if weight is None else weight[lo:hi])[which], cells.size)
                cells += parts.reshape(cells.shape)
                lo = hi
        return out.T

    def _only(self, part: int, needed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
        _, _, n, _, who, value = self.parts[part]
        kept = needed[who]
        n = np.bincount(np.repeat(np.arange(len(n)), n)[kept], minlength=len(n))
        return n, np.cumsum(n) - n, who[kept], None if value is None else value[kept]


def _each(size: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of so many places from a start each: the run and the place of every one of them."""
    ends = np.cumsum(size)
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) + (start - ends + size)[which]


def _product(asks: tuple[np.ndarray, np.ndarray, np.ndarray], held: np.ndarray, there: np.ndarray, queries: int) -> np.ndarray:
    """Scores of queries and memories: asks are words (sorted), queries and values, held is words by memories, there how many memories hold each word. Words that many queries and memories share are one matrix product, the others are added where they meet."""
    words, who, value = asks
    used, start, n = np.unique(words, return_index=True, return_counts=True)
    many = n * there[used] > DENSE * queries * held.shape[1]
    dense = used[many]
    column = np.full(len(held), -1)
    column[dense] = np.arange(len(dense))
    at = column[words]
    asked = np.zeros((queries, len(dense)))
    asked[who[at >= 0], at[at >= 0]] = value[at >= 0]
    out = asked @ held[dense]
    lone = ~many & (n * there[used] < LONE)
    few = ~many & ~lone & (there[used] > 0)
    _add(out, *(x[np.repeat(lone, n)] for x in (words, who, value)), held)
    for w, lo, size in zip(used[few].tolist(), start[few].tolist(), n[few].tolist(), strict=True):
        j = np.flatnonzero(held[w])
        out[who[lo : lo + size, None], j] += value[lo : lo + size, None] * held[w, j]
    return out


def _add(out: np.ndarray, words: np.ndarray, who: np.ndarray, value: np.ndarray, held: np.ndarray) -> None:
    """Adds words (sorted) that meet in few pairs each, many at a time."""
    used, code = np.unique(words, return_inverse=True)
    row, column = np.nonzero(held[used])
    weight, n = held[used[row], column], np.bincount(row, minlength=len(used))
    size, start = n[code], (np.cumsum(n) - n)[code]
    ends = np.cumsum(size)
    lo = 0
    while lo < len(words):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + AT_ONCE, "right")))
        part = size[lo:hi]
        at = np.arange(part.sum()) + np.repeat(start[lo:hi] - (np.cumsum(part) - part), part)
        out += np.bincount(np.repeat(who[lo:hi], part) * out.shape[1] + column[at], np.repeat(value[lo:hi], part) * weight[at], out.size).reshape(out.shape)
        lo = hi


def ranked(block: list[tuple[str, list[str]]], weights: dict[str, float], share: bool, memories: DataFrame, reader: Callable[[dict[str, int]], Reader], k: int, digits: int | None = None) -> DataFrame:
    """(q_id, id, _pos, score): the k best memories (id, _pos, text) of every task for each query of a block.

    A score is the sum over a query's words of the word's weight and the memory's, divided by the
    number of words if `share`; scores equal to so many digits are ties.
    """
    of = gathered(block)
    size = np.maximum(of.size, 1)
    value = np.array([weights.get(w, 1.0) for w in of.words])[of.cols] / (size[of.rows] if share else 1) if weights else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read, asks = reader({w: i for i, w in enumerate(of.words)}), Asks(len(of.names), len(of.words), of.rows, of.cols, value)
        bests = [Best(n, k, None if value is None else digits) for _, n, *_ in asks.parts]
        for m in batches:
            held = read(m["text"].tolist())
            pos, ids = m["_pos"].to_numpy(np.int64), m["id"].to_numpy(object)
            for some, *words in alike(of, *held, len(m)):
                for i, best in enumerate(bests):
                    best.add(asks.meet(i, *words, len(some)), pos[some], ids[some])
        for (lo, n, *_), best in zip(asks.parts, bests, strict=True):
            if value is None and share:
                best.score = best.score / size[best.row + lo]
            yield best.rows(of.names[lo : lo + n])

    plain = memories.select(F.col("id").cast("string").alias("id"), F.col("_pos").cast("long").alias("_pos"), F.col("text").cast("string").alias("text"))
    return plain.mapInPandas(run, "q_id string, id string, _pos long, score double")


def first_holding(targets: DataFrame, memories: DataFrame, size: int = QUERIES) -> DataFrame:
    """(q_id, id): for each of a stated set of targets (q_id, term) the first memory by place, other than q_id itself, whose text holds the term, whatever the case; null where none does. One pass per block of targets; an empty term is held by every text."""
    asked = targets.select(F.col("q_id").cast("string").alias("q_id"), F.lower("term").alias("term"))
    blocks, out = max(1, -(-asked.count() // size)), None
    plain = memories.select(F.col("id").cast("string").alias("id"), F.col("_pos").cast("long").alias("_pos"), F.lower("text").alias("text")).where("text IS NOT NULL")
    for b in range(blocks):
        block = [(r["q_id"], r["term"]) for r in asked.where(F.pmod(F.xxhash64("q_id"), F.lit(blocks)) == b).collect() if r["term"] is not None]  # one block

        def run(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            best: dict[str, tuple[int, str]] = {}
            for m in batches:
                for id_, pos, text in zip(m["id"], m["_pos"], m["text"], strict=True):
                    for q, term in block:
                        if (q not in best or pos < best[q][0]) and q != id_ and term in text:
                            best[q] = (pos, id_)
            yield pd.DataFrame({"q_id": pd.Series(list(best), dtype=object), "id": pd.Series([i for _, i in best.values()], dtype=object), "_pos": pd.Series([p for p, _ in best.values()], dtype="int64")})

        found = plain.mapInPandas(run, "q_id string, id string, _pos long")
        out = found if out is None else out.unionByName(found)
    first = out.groupBy("q_id").agg(F.min_by("id", "_pos").alias("id"))
    return asked.select("q_id").join(first, "q_id", "left")


def _once(column: np.ndarray, word: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different words of each column (in order), their columns, and how often each occurs."""
    key = np.sort(column * words + word)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first] % max(1, words), key[first] // max(1, words), np.diff(first, append=len(key))


def counted(texts: list[str | None], words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Those of the words that each text holds as a whole: the words, the texts, how often; and the length of each text in words."""
    found = [np.zeros(0, np.int64)]
    for text in texts:
        runs = runs_of(text)
        found.append(np.fromiter(map(words.get, runs, repeat(-1)), np.int64, len(runs)))
    length = np.array([len(f) for f in found[1:]], np.int64)
    word, column = np.concatenate(found), np.repeat(np.arange(len(texts)), length)
    return *_once(column[word >= 0], word[word >= 0], len(words)), length


class Substrings:
    """Which of the words stand in a run. Up to eight bytes of a place are one number, so the places of many runs are compared at once; longer words are looked for where their first eight bytes stand."""

    def __init__(self, words: dict[bytes, int], most: int | None = None):
        self.words = most or len(words)
        self.long: dict[int, list[tuple[bytes, int]]] = {}
        short: dict[int, dict[int, int]] = {}
        for w, i in words.items():
            if len(w) > 8:
                self.long.setdefault(int.from_bytes(w[:8], "big"), []).append((w, i))
            else:
                short.setdefault(len(w), {})[int.from_bytes(w, "big")] = i
        self.short = {n: self._sorted(x) for n, x in short.items()}
        self.begin = self._sorted(dict.fromkeys(self.long, 0))

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)

    def _sorted(self, numbers: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, maybe = np.array(sorted(numbers), np.uint64), np.zeros(1 << 20, bool)
        maybe[self._slot(keys)] = True
        return keys, np.array([numbers[k] for k in keys.tolist()], np.int64), maybe

    def _among(self, key: np.ndarray, known: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Where a known key stands, and its number."""
        keys, number, maybe = known
        here = np.flatnonzero(maybe[self._slot(key)])
        j = np.searchsorted(keys, key[here])
        here, j = here[j < len(keys)], j[j < len(keys)]
        same = keys[j] == key[here]
        return here[same], number[j[same]]

    def of(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words, and how many of them stand in each run."""
        text = np.frombuffer(b" ".join(runs) + b" " * 9, np.uint8).astype(np.uint64)
        size = np.array([len(r) for r in runs], np.int64)
        start = np.cumsum(size + 1) - size - 1
        run, places = _each(size, start)
        left = (start + size)[run] - places
        key, found = np.zeros(len(places), np.uint64), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for n in range(1, 9):
            some = left >= n
            run, places, left = run[some], places[some], left[some]
            key = key[some] << np.uint64(8) | text[places + (n - 1)]
            if n in self.short:
                here, number = self._among(key, self.short[n])
                found.append((run[here], number))
        here, _ = self._among(key, self.begin)
        more = [(r, i) for r, p, k in zip(run[here].tolist(), (places - start[run])[here].tolist(), key[here].tolist(), strict=True) for w, i in self.long[k] if runs[r].startswith(w, p)]
        found.append((np.array([r for r, _ in more], np.int64), np.array([i for _, i in more], np.int64)))
        word, run, _ = _once(*(np.concatenate(x) for x in zip(*found, strict=True)), self.words)
        return word, np.bincount(run, minlength=len(runs))


def inside(place: dict[str, int], words: int | None = None) -> Reader:
    """Words that occur anywhere in the lower-case text, be it inside others; weight 1. What stands in a run is remembered. words: how many there are where place holds but some."""
    look = Substrings({w.encode(): i for w, i in place.items()}, words)
    number: dict[bytes, int] = {}
    none = np.zeros(0, np.int64)
    word, size = none, none

    def read(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, None]:
        nonlocal word, size
        runs = [set(runs_of(text)) for text in texts]
        if len(number) >= REMEMBERED:
            number.clear()
            word, size = none, none
        new = list(set().union(*runs) - number.keys())
        number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
        word, size = (np.concatenate(x) for x in zip((word, size), look.of(new), strict=True))
        start = np.cumsum(size) - size
        out = [(none, none)]
        for lo in range(0, len(runs), MEMORIES):
            part = runs[lo : lo + MEMORIES]
            of = np.fromiter(map(number.__getitem__, chain.from_iterable(part)), np.int64, sum(map(len, part)))
            which, at = _each(size[of], start[of])
            out.append(_once(np.repeat(np.arange(lo, lo + len(part)), [len(r) for r in part])[which], word[at], look.words)[:2])
        return *(np.concatenate(x) for x in zip(*out, strict=True)), None

    return read


def saturated(avg_len: float) -> Callable[[dict[str, int]], Reader]:
    """Whole words with the term part of BM25."""

    def reader(place: dict[str, int]) -> Reader:
        words = {w.encode(): i for w, i in place.items()}

        def read(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            word, column, tf, length = counted(texts, words)
            return word, column, tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[column] / avg_len))

        return read

    return reader


def document_counts(words: list[str], docs: DataFrame) -> tuple[dict[str, int], int, int]:
    """How many docs hold each word, the docs and the length of all of them in words; one pass."""
    known = {w.encode(): i for i, w in enumerate(words)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n, total = np.zeros(len(words), np.int64), 0, 0
        for b in batches:
            word, _, _, length = counted(b["text"].tolist(), known)
            df, n, total = df + np.bincount(word, minlength=len(words)), n + len(length), total + int(length.sum())
        used = np.flatnonzero(df)
        yield pd.DataFrame({"word": [*used.tolist(), -1, -2], "n": [*df[used].tolist(), n, total]})

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInPandas(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # one row per word of the block
    got = {r["word"]: r["n"] for r in rows}
    return {w: got.get(i, 0) for i, w in enumerate(words)}, got.get(-1, 0), got.get(-2, 0)


def top(parts: list[DataFrame], k: int, digits: int | None = None) -> DataFrame:
    """(q_id, rnk, id, score) over the tasks' best."""
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    by = F.desc("score") if digits is None else F.desc(F.round("score", digits))
    out = found.withColumn("rnk", F.row_number().over(Window.partitionBy("q_id").orderBy(by, "_pos")))
    return out.where(F.col("rnk") <= k).select("q_id", "rnk", "id", "score")
