"""SimHash near-duplicates: 64-bit fingerprints joined by a binary trie self-join.

Distinct fingerprints that differ in at most BUDGET = 4 bits agree on at least
m of 4 + m blocks of bits. Each choice of m blocks makes a forest of tries, one
per value of these blocks (m grows with the number of fingerprints, so that
tries stay small); below its root, pairs of nodes are walked
together, differing bits add up, and a pair of nodes is left when its sum
exceeds the budget. Only a spanning forest of each trie's links is kept, so a
group of copies costs rows in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrama.llm.shared import if_small, materialise, without

SHINGLE, SEED, BUDGET = 4, 42, 4
#: Fingerprints up to which two, and three, blocks are to agree (forests of some 2^21 and 2^27 tries); beyond, four.
TWO, THREE = 1 << 32, 1 << 38
#: Fingerprints of a trie that one task joins; larger tries are dealt out as pairs of parts.
TRIE_ROWS = 8192
#: Rows of a component that are joined by shuffle; larger components are few and looked up by broadcast.
HOT = 1 << 16
#: Pairs of nodes that are walked at once, and leaf pairs below which a pair of nodes is compared outright.
SLICE, LEAF = 1 << 17, 32
#: Shingles that are counted at once.
STEP = 1 << 15


def fingerprint(text: bytes | None) -> int:
    """Unsigned fingerprint of a text in UTF-8: bit set where over half of the shingles' XXH64 have it; no words give 0."""
    words = (text or b"").lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens).tolist()
    size = min(SHINGLE, len(words))
    last, ends = len(words) - size + 1, ends[size - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, last, STEP):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + STEP], ends[at : at + STEP])], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > last).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x) for x in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {id_type}, fp long")


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives the smaller label to both ends of each link, until nothing changes."""
    while len(a):
        x, y = label[a], label[b]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (jump := label[label]).tobytes() != label.tobytes():
            label[:] = jump
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]


def trie_join(fps: np.ndarray, groups: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """Labels: the smallest index that each fingerprint is linked with inside its group, directly or through others.

    fps: unsigned, ascending and distinct inside each group. groups: ascending starts of the groups and the end.
    """
    label = np.arange(len(fps))
    lo, hi = groups[:-1], groups[1:]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    stack = [(63, np.stack([lo, hi, lo, hi, np.zeros_like(lo)]))]
    zeros: dict[int, np.ndarray] = {}
    while stack:
        bit, pairs = stack.pop()
        if pairs.shape[1] > SLICE:
            half = pairs.shape[1] // 2
            stack += [(bit, pairs[:, :half]), (bit, pairs[:, half:])]
            continue
        # what one label holds needs no further links
        steps = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        same = (label[pairs[0]] == label[pairs[2]]) & (steps[pairs[1] - 1] == steps[pairs[0]]) & (steps[pairs[3] - 1] == steps[pairs[2]])
        pairs = pairs[:, ~same]
        area = (pairs[1] - pairs[0]) * (pairs[3] - pairs[2])
        small = (area <= LEAF) | (bit < 0)
        if small.any():
            alo, _, blo, bhi, _ = pairs[:, small]
            each, wide = area[small], (bhi - blo)
            n = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            wide = np.repeat(wide, each)
            a, b = np.repeat(alo, each) + n // wide, np.repeat(blo, each) + n % wide
            near = (a != b) & (np.bitwise_count(fps[a] ^ fps[b]) <= budget)
            _merge(label, a[near], b[near])
            pairs = pairs[:, ~small]
        if not pairs.shape[1]:
            continue
        if bit not in zeros:
            zeros[bit] = np.concatenate([[0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1) == 0)])
        alo, ahi, blo, bhi, diff = pairs
        z = zeros[bit]
        amid, bmid = alo + z[ahi] - z[alo], blo + z[bhi] - z[blo]
        other = alo != blo  # of a node with itself, one crossing is enough
        down = np.concatenate([
            np.stack([alo, amid, blo, bmid, diff]), np.stack([amid, ahi, bmid, bhi, diff]),
            np.stack([alo, amid, bmid, bhi, diff + 1]), np.stack([amid, ahi, blo, bmid, diff + 1])[:, other],
        ], axis=1)
        down = down[:, (down[0] < down[1]) & (down[2] < down[3]) & (down[4] <= budget)]
        down = down[:, (down[0] != down[2]) | (down[1] - down[0] > 1)]
        if down.shape[1]:
            stack.append((bit - 1, down))
    return label


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links (u, v) of the tries in one partition, which comes sorted by key and part, then fingerprint."""

    def of(table: pa.Table) -> pa.RecordBatch:
        trie = np.stack([table.column(c).to_numpy() for c in ("key", "part")])
        fps = table.column("fp").to_numpy().view(np.uint64)
        first = np.ones(len(fps), bool)
        first[1:] = (trie[:, 1:] != trie[:, :-1]).any(axis=0)
        order = np.lexsort((fps, np.cumsum(first)))  # Spark sorts longs as signed
        fps = fps[order]
        label = trie_join(fps, np.append(np.flatnonzero(first), len(fps)))
        linked = label != np.arange(len(fps))
        signed = fps.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed[linked]), pa.array(signed[label[linked]])], ["u", "v"])

    held: list[pa.Table] = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        key, part = (t.column(c).to_numpy() for c in ("key", "part"))
        # all but the last trie of a batch is complete
        cut = int(np.flatnonzero((key != key[-1]) | (part != part[-1]))[-1]) + 1 if (key[0], part[0]) != (key[-1], part[-1]) else 0
        if cut:
            yield of(pa.concat_tables([*held, t.slice(0, cut)]))
            held = [t.slice(cut)]
        elif held and (held[-1].column("key")[-1].as_py(), held[-1].column("part")[-1].as_py()) != (key[0], part[0]):
            yield of(pa.concat_tables(held))
            held = [t]
        else:
            held.append(t)
    if held:
        yield of(pa.concat_tables(held))


def blocks(agree: int) -> list[tuple[int, int]]:
    """(first bit, bits) of 4 + agree blocks from the lowest bit, as even as they can be."""
    n = BUDGET + agree
    sizes = [64 // n + (i < 64 % n) for i in range(n)]
    return [(sum(sizes[:i]), size) for i, size in enumerate(sizes)]


def links(distinct: DataFrame, trie_rows: int = TRIE_ROWS, agree: int = 2) -> DataFrame:
    """(u, v) fingerprints at most BUDGET bits apart: enough of them to connect all that are, at most one per fingerprint and trie part."""
    parts = blocks(agree)
    keys = []
    for forest, chosen in enumerate(combinations(parts, agree)):
        key = F.lit(forest).cast("long")
        for first, bits in chosen:
            key = F.shiftleft(key, bits).bitwiseOR(F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1).cast("long")))
        keys.append(key)
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    hot = materialise(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > trie_rows).select("key", F.ceil(2 * F.col("n") / trie_rows).cast("int").alias("m")), "hot-tries")
    if hot.isEmpty():
        rows = rows.withColumn("part", F.lit(0))
    else:  # every two parts of a large trie meet in one task
        mine = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("m")).cast("int")
        part = lambda j: F.least(mine, j) * F.col("m") + F.greatest(mine, j)
        rows = rows.join(if_small(hot, 1_000_000), "key", "left").withColumn("m", F.coalesce("m", F.lit(1))).select("fp", "key", F.explode(F.transform(F.sequence(F.lit(0), F.col("m") - 1), part)).alias("part"))
    dealt = rows.repartition("key", "part").sortWithinPartitions("key", "part", "fp")
    return dealt.select("key", "part", "fp").mapInArrow(_links, "u long, v long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, root) for every end of an edge (u, v): root is the smallest value reachable.

    Alternating large-star and small-star steps; each round is written to the
    shared folder, so lineage stays short and nothing is gathered on the driver
    but a count and a checksum. Minima are combined before they are shuffled, and a
    join at a node with very many edges is divided at run time (spark.sql.adaptive.skewJoin).
    """

    def state(e: DataFrame) -> tuple:
        row = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        return tuple(row)

    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialise(edges, "links")
    before = state(edges)
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = materialise(small.where("u <> v").distinct(), "links")
        now = state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("fp"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, trie_rows: int = TRIE_ROWS, hot: int = HOT) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable over links, its own included) of each row of docs.

    Null and empty texts have fingerprint zero and link like any other.
    Repeated rows are all returned. Null ids never become a component_id,
    unless a component has no other; an empty table gives no rows. Other
    columns of docs are not read.
    """
    fps = materialise(fingerprints(without(docs, "fp")), "fingerprints")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("lead"), F.count("*").alias("copies")), "distinct")
    n = distinct.count()
    agree = 2 if n <= TWO else 3 if n <= THREE else 4
    roots = components(links(distinct.select("fp"), trie_rows, agree))  # only fingerprints with links
    roots = roots.unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
    named = materialise(distinct.join(roots, "fp", "left"), "roots")
    linked = named.where("root IS NOT NULL")
    lead = materialise(linked.groupBy("root").agg(F.min("lead").alias("component_id"), F.count("*").alias("n")), "leads")
    single = named.where("root IS NULL").select("fp", "copies", F.col("lead").alias("component_id"))
    per_fp = materialise(single.unionByName(_looked_up(linked, lead, "root", "n", hot).select("fp", "copies", "component_id")), "components")
    return _looked_up(fps, per_fp, "fp", "copies", hot).select("doc_id", "fp", "component_id")


def _looked_up(rows: DataFrame, named: DataFrame, key: str, n: str, hot: int, broadcast_rows: int = 1_000_000) -> DataFrame:
    """rows joined with named (key, its number of rows n, and others): keys of over `hot` rows, of which there are at most one in `hot` rows, by broadcast while they are few, the others by shuffle."""
    named = named.select(*[c for c in named.columns if c == key or c not in rows.columns])
    large = if_small(named.where(F.col(n) > hot), broadcast_rows)
    return rows.join(large, key).unionByName(rows.join(large.select(key), key, "left_anti").join(named.where(F.col(n) <= hot), key))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without those whose component holds a smaller doc_id: one document of each group of near-duplicates stays (repeats of its row with it).

    Null and empty texts are one group. Rows without doc_id stay. An empty
    table gives no rows; other columns may have any names.
    """
    gone = near_duplicates(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_d")).distinct()
    gone = materialise(gone, "near-copies")
    return docs.join(if_small(gone, 1_000_000), docs["doc_id"] == gone["_d"], "left_anti")
