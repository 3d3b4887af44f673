"""Line deduplication by an exact set-similarity join.

A line is the set of its words. Two lines match when the Jaccard similarity of their
sets is at least a threshold; of two that match, the later one (by doc_id, then
place) goes. Words are ordered by rarity, and two matching lines share a word
among their rarest few (prefix filter); lengths and the places of the shared word rule out
most other pairs before words are compared.

Lines with equal sets are settled first by one aggregation, so a line that a third
of all documents hold is one row. Then each line is tried against the first
earlier line that the filters let through in each of its words' lists, which settles
groups of near copies; only lines whose tries all failed meet every earlier one.
A word whose list is longer than LIST_ROWS is dealt out: its list is cut into parts,
and every two parts meet in a task of their own, so no task holds more than two of them.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrama.llm.shared import if_small, materialise

THRESHOLD = 0.8
#: Lines with fewer different words are left alone; those without words always are.
LEAST = 1
#: Counters for word frequency; words share them by hash.
SLOTS = 1 << 18
#: Counters that travel together: an Arrow batch of chunks stays small.
CHUNK = 1 << 10
#: Entries whose lists a task compares at once.
AT_ONCE = 1 << 16
#: Entries of a word's list that one task may hold; longer lists are cut into parts of half as many.
LIST_ROWS = 1 << 17
#: Longs of the widest sketch.
WIDE = 8
#: Bytes up to which words are hashed all at once, eight a step; longer ones one by one.
LONG = 64
#: What keeps words apart that differ in closing zero bytes only.
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: The lowest 0 to 8 bytes of 64 bits.
LOWEST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word in a buffer of UTF-8 bytes, all at once."""
    gap = np.ones(len(buffer) + 2, bool)
    gap[1:-1] = (buffer == 32) | (buffer - np.uint8(9) < 5)
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    length = end - start
    whole = np.zeros(len(buffer) // 8 + 2, np.uint64)
    whole.view(np.uint8)[: len(buffer)] = buffer

    def eight(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The eight bytes from each place on, of which `left` are the word's."""
        i, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        return ((whole[i] >> shift) | (whole[i + 1] << np.uint64(1) << (np.uint64(63) - shift))) & LOWEST[np.minimum(left, 8)]

    hashes = _mix(eight(start, length) ^ (length.astype(np.uint64) * FACTOR))
    more = np.flatnonzero((length > 8) & (length <= LONG))
    for at in range(8, LONG, 8):
        more = more[length[more] > at]
        hashes[more] = _mix(hashes[more] ^ eight(start[more] + at, length[more] - at))
    for i in np.flatnonzero(length > LONG):
        hashes[i] = int.from_bytes(hashlib.blake2b(buffer[start[i] : end[i]], digest_size=8).digest(), "little")
    return start, end, hashes


def _pieces(batches: Iterator[pa.RecordBatch], most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, lengths, bytes) of texts in the last column: the texts of some rows, each closed by a line end."""
    for b in batches:
        texts = b.column(b.num_columns - 1)
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < len(sizes):
            n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most, "right")))
            joined = b"\n".join([x or b"" for x in texts.slice(at, n).to_pylist()]) + b"\n"
            yield b.slice(at, n), sizes[at : at + n] + 1, np.frombuffer(joined, np.uint8)
            at += n


def frequencies(docs: DataFrame, slots: int = SLOTS, chunk: int = CHUNK) -> np.ndarray:
    """How often words whose hash falls into each slot occur in all texts. Every task counts into one array, which goes on in chunks; chunks of one place are added up as they stream by, so no task holds more than `slots` sums, however many tasks there are, and `slots` numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for _, _, buffer in _pieces(batches):
            total += np.bincount((words(buffer)[2] % np.uint64(slots)).astype(np.int64), minlength=slots)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(0, slots, chunk)), pa.array([total[at : at + chunk].tobytes() for at in range(0, slots, chunk)])], ["at", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for at, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                new = np.frombuffer(counts, np.int64)
                sums[at] = sums[at] + new if at in sums else new
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tobytes() for x in sums.values()])], ["at", "counts"])

    counted = docs.select(F.col("text").cast("binary")).mapInArrow(count, "at long, counts binary")
    out = np.zeros(slots, np.int64)
    for r in counted.repartition("at").mapInArrow(add, "at long, counts binary").toLocalIterator():
        out[r["at"] : r["at"] + chunk] = np.frombuffer(r["counts"], np.int64)
    return out


def _prefix(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Words of a set that must hold one of those shared with any match."""
    return sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1


def _order(line: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Sorts by line, then key. One sort of 64 bits unless two words of a line agree in all the bits of their keys that fit."""
    short = (line.astype(np.uint64) << np.uint64(40)) | (key >> np.uint64(24))
    order = np.argsort(short)
    tie = short[order[1:]] == short[order[:-1]]
    return np.lexsort((key, line)) if (tie & (key[order[1:]] != key[order[:-1]])).any() else order


def lines(docs: DataFrame, ranks: bytes, threshold: float, least: int) -> DataFrame:
    """One row per line with at least `least` different words: doc, line, a and b (together the set's identity), again (whether its document has an earlier line of the same set), size, sketch and the prefix of (rarity, word hash) keys.

    sketch: bytes in which each word flips one of 64, 128, 256 or 512 bits (more for longer lines; a wider one folds to a narrower by exclusive or), so two sketches differ in no more bits than their sets in words.

    ranks: broadcast-sized, fixed length: the rarity rank of each slot in 32 bits.
    """
    rank = np.frombuffer(ranks, np.uint32)
    slots, bits = len(rank), int(len(rank) - 1).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, lengths, buffer in _pieces(batches):
            starts, _, hashes = words(buffer)
            if not len(starts):
                continue
            ends = np.flatnonzero(buffer == 10)
            line = np.repeat(np.arange(len(ends)), np.diff(np.searchsorted(starts, ends), prepend=0))  # of the whole piece
            key = (rank[hashes % np.uint64(slots)].astype(np.uint64) << np.uint64(64 - bits)) | (hashes >> np.uint64(bits))
            order = _order(line, key)
            line, key, hashes = line[order], key[order], hashes[order]
            new = np.ones(len(line), bool)
            new[1:] = (line[1:] != line[:-1]) | (key[1:] != key[:-1])
            line, key, hashes = line[new], key[new], hashes[new]
            first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
            sizes = np.diff(np.append(first, len(line)))
            a, b = np.add.reduceat(hashes, first), np.bitwise_xor.reduceat(_mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), first)
            width = np.minimum(WIDE, 1 << np.ceil(np.log2(np.maximum(sizes / 64, 1))).astype(np.int64))  # longs
            at = np.cumsum(width) - width
            bit = (hashes >> np.uint64(40)).astype(np.int64) & np.repeat(64 * width - 1, sizes)
            flips = np.bincount(np.repeat(64 * at, sizes) + bit, minlength=64 * width.sum()) & 1
            sketch = np.packbits(flips.astype(np.uint8), bitorder="little")
            keep = np.flatnonzero(sizes >= least)
            if not len(keep):
                continue
            which = line[first[keep]]
            doc_end = np.cumsum(lengths) - 1  # the line end that closes each text
            doc = np.searchsorted(doc_end, ends[which])
            number = which - np.searchsorted(ends, np.concatenate([[0], doc_end[:-1] + 1]))[doc]
            n = _prefix(sizes[keep], threshold)
            take = np.repeat(first[keep] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(key[take].view(np.int64)))
            own, to = 8 * width[keep], np.cumsum(8 * width[keep])
            spread = sketch if len(keep) == len(sizes) else sketch[np.repeat(8 * at[keep] - (to - own), own) + np.arange(own.sum())]
            sketches = pa.Array.from_buffers(pa.binary(), len(keep), [None, pa.py_buffer(np.concatenate([[0], to]).astype(np.int32)), pa.py_buffer(spread)])
            a, b = a[keep], b[keep]
            order = np.lexsort((b, a, doc))  # stable: lines of a document stay in order
            again = np.zeros(len(keep), bool)
            again[order[1:]] = (doc[order[1:]] == doc[order[:-1]]) & (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(doc)), pa.array(number.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(again), pa.array(sizes[keep].astype(np.int32)), sketches, prefix],
                ["doc", "line", "a", "b", "again", "size", "sketch", "prefix"],
            )

    return docs.select("doc", F.col("text").cast("binary")).mapInArrow(run, "doc long, line int, a long, b long, again boolean, size int, sketch binary, prefix array<long>")


class Sketches:
    """Sketches of 1 to WIDE longs, compared at the width of the narrower of two: a wider one folds by exclusive or."""

    def __init__(self, sketch: pa.BinaryArray):
        sizes, held = (np.frombuffer(b or b"", t) for b, t in zip(sketch.buffers()[1:], (np.int32, np.uint8), strict=True))
        offsets = sizes[sketch.offset : sketch.offset + len(sketch) + 1] if len(sketch) else np.zeros(1, np.int32)
        width = np.diff(offsets) // 8
        flat, start = held[offsets[0] : offsets[-1]].view(np.uint64), (offsets[:-1] - offsets[0]) // 8
        self.width = width
        self.one = flat[start] if len(start) else flat[:0]  # folded to one long
        self.wide: dict[int, np.ndarray] = {}  # folds of the wider ones, by place among these
        more = np.flatnonzero(width > 1)
        self.place = None
        if not len(more):
            return
        self.place = np.zeros(len(width), np.int64)
        self.place[more] = np.arange(len(more))
        self.wide = {w: np.zeros((len(more), w), np.uint64) for w in (2, 4, WIDE)}
        for w in (2, 4, WIDE):
            rows = np.flatnonzero(width[more] == w)
            part = flat[start[more[rows]][:, None] + np.arange(w)]
            while part.shape[1] > 1:
                self.wide[part.shape[1]][rows] = part
                half = part.shape[1] // 2
                part = part[:, :half] ^ part[:, half:]
            self.one[more[rows]] = part[:, 0]

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bits in which the sketches of x and y differ: no more than their sets differ in words."""
        out = np.bitwise_count(self.one[x] ^ self.one[y]).astype(np.int64)
        if self.place is not None:
            narrow = np.minimum(self.width[x], self.width[y])
            for w, fold in self.wide.items():
                mine = np.flatnonzero(narrow == w)
                if len(mine):
                    out[mine] = np.bitwise_count(fold[self.place[x[mine]]] ^ fold[self.place[y[mine]]]).sum(axis=1, dtype=np.int64)
        return out


def candidates(table: pa.Table, t: float, every: bool) -> pa.RecordBatch:
    """(xd, xl, yd, yl, key): for the asking entries (all, if nothing says which) of whole word lists or pairs of their parts (meta is size and place) the earlier entries of their lists that the filters on length, place and sketch let through: the first, or every one.

    All lists advance together: round c tries every entry that is still open
    against the entry at place c of its list, so in search of the first a group of
    near copies is done after one round.
    """
    order = np.lexsort([table.column(c).to_numpy() for c in ("line", "doc", "part", "key") if c in table.column_names])
    key, doc, line, meta = (table.column(c).to_numpy()[order] for c in ("key", "doc", "line", "meta"))
    sketches = Sketches(pa.concat_arrays(table.column("sketch").chunks).take(pa.array(order)) if table.num_rows else pa.array([], pa.binary()))
    size, i = meta >> 31, meta & ((1 << 31) - 1)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    own = None
    if "part" in table.column_names:
        part, own = table.column("part").to_numpy()[order], table.column("own").to_numpy()[order]
        new[1:] |= part[1:] != part[:-1]
        alone = part < 0
    start = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    open_ = np.flatnonzero(~new & table.column("asking").to_numpy()[order] if "asking" in table.column_names else ~new)
    xs, ys = [], []
    c = 0
    while len(open_):
        x, y = open_, start[open_] + c
        both = size[x] + size[y]
        need = np.ceil(t / (1 + t) * both - 1e-9).astype(np.int64)
        ok = np.minimum(size[x], size[y]) >= np.ceil(t * np.maximum(size[x], size[y]) - 1e-9)
        ok &= np.minimum(size[x] - i[x], size[y] - i[y]) >= need
        if own is not None:
            ok &= alone[x] | (own[x] != own[y])  # what lies in one part meets in that part's own task
        still = np.flatnonzero(ok)
        ok[still] = sketches.apart(x[still], y[still]) <= both[still] - 2 * need[still]
        xs.append(x[ok])
        ys.append(y[ok])
        c += 1
        open_ = open_ if every else open_[~ok]
        open_ = open_[open_ - start[open_] > c]
    x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (xs, ys))
    return pa.RecordBatch.from_arrays([pa.array(doc[x]), pa.array(line[x]), pa.array(doc[y]), pa.array(line[y]), pa.array(key[x])], ["xd", "xl", "yd", "yl", "key"])


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a partition that is sorted by key (and part, if lists are cut), cut between lists only, about AT_ONCE at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        if rows >= AT_ONCE:
            names = [c for c in ("key", "part") if c in b.schema.names]
            last = tuple(held[-1].column(held[-1].schema.get_field_index(c))[-1].as_py() for c in names)
            other = np.zeros(b.num_rows, bool)
            for c, value in zip(names, last, strict=True):
                other |= b.column(b.schema.get_field_index(c)).to_numpy() != value
            if other.any():
                cut = int(np.argmax(other))
                yield pa.Table.from_batches([*held, b.slice(0, cut)])
                b, held, rows = b.slice(cut), [], 0
        held.append(b)
        rows += b.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _dealt(entries: DataFrame, hot: DataFrame | None) -> DataFrame:
    """entries as they are; if some lists are long (hot: key, m), with part (-1 for a whole list, less for a part with itself, else the pair of parts) and own, the entry's own part. Long lists' entries appear once for each pair of parts."""
    if hot is None:
        return entries
    out = entries.join(hot, "key", "left").withColumn("m", F.coalesce("m", F.lit(1)))
    out = out.withColumn("own", F.pmod(F.xxhash64("doc", "line"), F.col("m")).cast("int"))
    pair = lambda j: F.when(j == F.col("own"), -1 - j).otherwise(F.least("own", j) * F.col("m") + F.greatest("own", j)).cast("long")
    return out.withColumn("part", F.explode(F.transform(F.sequence(F.lit(0), F.col("m") - 1), pair))).drop("m")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, line, n, sketch, w): the different words of the wanted lines, from the texts themselves, and a sketch of WIDE * 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {"doc": [], "line": [], "n": [], "sketch": [], "w": []}
            for doc, text, numbers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                every = (text or b"").split(b"\n")
                for k in numbers:
                    found = sorted(set(every[k].split())) if k < len(every) else []
                    bits = np.bincount([zlib.crc32(x) % (WIDE * 64) for x in found], minlength=WIDE * 64) & 1
                    for name, value in (("doc", doc), ("line", k), ("n", len(found)), ("sketch", np.packbits(bits.astype(np.uint8)).view(np.int64)), ("w", found)):
                        rows[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[c], t) for c, t in (("doc", pa.int64()), ("line", pa.int32()), ("n", pa.int32()), ("sketch", pa.list_(pa.int64())), ("w", pa.list_(pa.binary())))], list(rows))

    return docs.select("doc", F.col("text").cast("binary").alias("text")).join(wanted, "doc").select("doc", "text", "wanted").mapInArrow(run, "doc long, line int, n int, sketch array<long>, w array<binary>")


def _verified(docs: DataFrame, pairs: DataFrame, t: float, broadcast_rows: int) -> DataFrame:
    """(doc, line) of pairs' x whose words and those of y are similar enough. Words are only moved for pairs that wide sketches let through."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("xd").alias("doc"), F.col("xl").alias("line")), F.struct(F.col("yd").alias("doc"), F.col("yl").alias("line")))).alias("e")).select("e.*")
    wanted = materialise(ends.groupBy("doc").agg(F.array_sort(F.collect_set("line")).alias("wanted")), "wanted-lines")
    sets = _sets(docs, if_small(wanted, broadcast_rows, "wanted"))
    sets = materialise(sets.withColumn("w", F.col("w").cast("array<string>")), "line-words")  # arrays of binary intersect by trying every two elements

    def beside(pairs_: DataFrame, *names: str) -> DataFrame:
        for side in "xy":
            pairs_ = pairs_.join(sets.select(F.col("doc").alias(f"{side}d"), F.col("line").alias(f"{side}l"), *[F.col(c).alias(f"{side}_{c}") for c in names]), [f"{side}d", f"{side}l"])
        return pairs_

    apart = sum((F.bit_count(F.col("x_sketch")[i].bitwiseXOR(F.col("y_sketch")[i])) for i in range(WIDE)), F.lit(0))
    both = F.col("x_n") + F.col("y_n")
    near = beside(pairs, "n", "sketch").where(apart <= both - 2 * F.ceil(F.lit(t / (1 + t)) * both - 1e-9)).select("xd", "xl", "yd", "yl")
    shared = F.size(F.array_intersect("x_w", "y_w"))
    similar = shared >= F.lit(t) * (F.size("x_w") + F.size("y_w") - shared) - 1e-9
    return beside(materialise(near, "near-pairs"), "w").where(similar).select(F.col("xd").alias("doc"), F.col("xl").alias("line")).distinct()


def _numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with a unique long `doc` in the order of doc_id; and whether that is doc_id itself."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col("doc_id").isNull())
    if docs.schema["doc_id"].dataType.typeName() in ("long", "integer", "short", "byte") and ids.isEmpty():
        return docs.withColumn("doc", F.col("doc_id").cast("long")), True
    digest = F.md5(F.col("text").cast("binary"))
    order = materialise(docs.select("doc_id", digest.alias("_t")).distinct().orderBy("doc_id", "_t").withColumn("doc", F.monotonically_increasing_id()), "document-order")
    order = order.withColumnRenamed("doc_id", "_id")
    return docs.join(order, docs["doc_id"].eqNullSafe(order["_id"]) & digest.eqNullSafe(order["_t"])).drop("_id", "_t"), False


def removed_lines(docs: DataFrame, threshold: float = THRESHOLD, least: int = LEAST, broadcast_rows: int = 1_000_000, list_rows: int = LIST_ROWS) -> DataFrame:
    """(doc, removed) for documents that lose lines: their numbers from 0, ascending. docs: doc (unique long), text."""
    counts = frequencies(docs)
    rank = np.empty(SLOTS, np.uint32)
    rank[np.argsort(counts, kind="stable")] = np.arange(SLOTS, dtype=np.uint32)
    every = materialise(lines(docs, rank.tobytes(), threshold, least), "lines")
    # lines with equal sets
    same = every.where("NOT again").groupBy("a", "b").agg(F.min("doc").alias("fd"), F.count("*").alias("n")).where("n > 1").select("a", "b", "fd")
    same = materialise(same, "equal-lines")
    told = every.join(if_small(same, broadcast_rows), ["a", "b"], "left")
    is_first = ~F.col("again") & (F.col("fd").isNull() | (F.col("fd") == F.col("doc")))
    gone = told.where(~is_first).select("doc", "line")
    # each word's list, in order; every line's first candidate in each. Unequal sets share at most n / (n + 1) of n words, so shorter ones have met all their matches above
    shortest = math.ceil(threshold / (1 - threshold) - 1e-6) if threshold < 1 else 1
    asking = told.where(is_first & (F.col("size") >= shortest)).select("doc", "line", "size", "sketch", "prefix")
    entries = asking.select("doc", "line", F.shiftleft(F.col("size").cast("long"), 31).alias("meta"), "sketch", F.posexplode("prefix").alias("i", "key")).withColumn("meta", F.col("meta") + F.col("i")).drop("i")
    # a list is no longer than its word is frequent, so only words of frequent slots are counted; a prefix rises in frequency
    often = int(np.searchsorted(np.sort(counts), list_rows, "right"))
    hot = None
    if often < SLOTS:
        slot = lambda k: F.shiftrightunsigned(k, 64 - int(SLOTS - 1).bit_length())
        long = every.select("prefix").where(slot(F.element_at("prefix", -1)) >= often).select(F.explode(F.filter("prefix", lambda k: slot(k) >= often)).alias("key"))
        hot = materialise(long.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > list_rows).select("key", F.ceil(2 * F.col("n") / list_rows).cast("int").alias("m")), "long-lists")
        hot = None if hot.isEmpty() else if_small(hot, broadcast_rows)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pairs(entries_: DataFrame, every: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in _whole_lists(batches):
                yield candidates(whole, threshold, every)

        lists = ["key"] if hot is None else ["key", "part"]
        return _dealt(entries_, hot).repartition(parts, *lists).sortWithinPartitions(*lists).mapInArrow(run, "xd long, xl int, yd long, yl int, key long")

    first = materialise(pairs(entries, False), "first-pairs")
    ends = ["xd", "xl", "yd", "yl"]
    settled = materialise(_verified(docs, first.select(ends).distinct(), threshold, broadcast_rows), "settled")
    # a line whose first candidates all failed meets every earlier line of the lists that they came from; its other lists let none through
    rest = first.select(F.col("xd").alias("doc"), F.col("xl").alias("line"), "key").distinct().join(settled, ["doc", "line"], "left_anti").withColumn("asks", F.lit(True))
    rest = materialise(rest, "unsettled")
    small = rest.count() <= broadcast_rows
    keys = rest.select("key").distinct()
    again = entries.join(F.broadcast(keys) if small else keys, "key", "left_semi").join(F.broadcast(rest) if small else rest, ["doc", "line", "key"], "left")
    again = again.withColumn("asking", F.coalesce("asks", F.lit(False))).drop("asks")
    second = materialise(pairs(again, True).select(ends).distinct().join(first.select(ends), ends, "left_anti"), "pairs")
    more = _verified(docs, second, threshold, broadcast_rows)
    return gone.union(settled).union(more).groupBy("doc").agg(F.array_sort(F.collect_set("line")).alias("removed"))


def _with_removed(docs: DataFrame, threshold: float, least: int, broadcast_rows: int, list_rows: int) -> DataFrame:
    """docs (doc_id, text and others) with doc and removed (an array, empty where nothing goes)."""
    numbered, _ = _numbered(docs)
    removed = materialise(removed_lines(numbered.select("doc", "text"), threshold, least, broadcast_rows, list_rows), "removed-lines")
    return numbered.join(if_small(removed, broadcast_rows, "removed"), "doc", "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))


def line_duplicates(docs: DataFrame, threshold: float = THRESHOLD, least: int = LEAST, broadcast_rows: int = 1_000_000, list_rows: int = LIST_ROWS) -> DataFrame:
    """doc_id, n_lines, n_removed (long) and removed (line numbers from 0, comma-joined) of each row of docs.

    A null or empty text is one empty line. Ids order documents, null first;
    rows that repeat an id and a text are one document, each returned; equal
    ids with other texts follow in the order of the texts' digests. An empty
    table gives no rows; other columns are not read.
    """
    out = _with_removed(docs.select("doc_id", "text"), threshold, least, broadcast_rows, list_rows)
    text = F.coalesce("text", F.lit(""))
    n_lines = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    return out.select("doc_id", n_lines.alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), F.array_join(F.transform("removed", lambda i: i.cast("string")), ",").alias("removed"))


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD, least: int = LEAST, broadcast_rows: int = 1_000_000, list_rows: int = LIST_ROWS) -> DataFrame:
    """docs without the removed lines in their texts; same rows and columns, n_chars (if there) counted anew.

    Null, repeated and empty rows as in line_duplicates(): a null text stays
    null, a text that loses all its lines becomes empty, and its row stays.
    Other columns may have any names.
    """
    out = _with_removed(docs.select("doc_id", "text", F.struct("*").alias("_row")), threshold, least, broadcast_rows, list_rows)
    whole, same = F.col("_row")["text"], F.size("removed") == 0
    left = lambda r: F.array_join(F.filter(F.split(whole, "\n"), lambda x, i: ~F.array_contains(r, i)), "\n")
    text = F.when(same, whole).otherwise(left(F.col("removed")))
    new = {"text": text} | ({"n_chars": F.when(same, F.col("_row")["n_chars"]).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))} if "n_chars" in docs.columns else {})
    return out.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
