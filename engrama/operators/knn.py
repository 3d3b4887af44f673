"""Cosine search: exact for few queries in place, exact in blocks for many, and by an index.

Vectors meet as matrices inside tasks of bounded size, and each task hands on at most k
rows per query, so no pair of vectors ever becomes a row unless it ranks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a small block, blocks of a side once these would be more, and bytes of vectors beyond which there are more again.
BLOCK, SIDE, BLOCK_BYTES = 2048, 12, 64 << 20
#: Side of the square of blocks into which all memories are dealt where they are searched among themselves: a prime.
OWN = 5
#: Bytes of a query matrix that travels with the code.
FEW_BYTES = 32 << 20
#: Memories of one matrix product in place; rows and columns of one inside a pair of blocks.
STEP, TILE = 1024, 1024
#: Columns of the first product of a pair of blocks; each next one has twice as many, up to TILE.
FIRST = 256
#: Pairs that are multiplied again at once.
PAIRS = 1 << 15
#: What the index is fitted on: queries of the sample, the share of true neighbours it is to find, and its most tables and bits.
SAMPLE, TARGET, TABLES, BITS = 256, 0.95, 64, 20
#: What a pair of blocks hands on.
FOUND = pa.schema([("q_id", pa.string()), ("id", pa.string()), ("_pos", pa.int64()), ("sim", pa.float64())])


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Unit rows; zero vectors stay zero and so have similarity 0."""
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _unit(vectors: pa.ChunkedArray) -> np.ndarray:
    """_matrix() of a column of lists."""
    lists = vectors.combine_chunks()
    if pc.count_distinct(pc.list_value_length(lists)).as_py() != 1:
        return _matrix(lists.to_pandas())
    m = lists.flatten().to_numpy(False).astype(np.float64).reshape(len(lists), -1)
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _nearest(q: np.ndarray, m: np.ndarray, q_ids: np.ndarray, m_ids: np.ndarray, pos: np.ndarray, k: int, gate: float | None, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and similarity of the k best of each row of q among those of m with another id, tile by tile: what falls short of a row's k-th best so far, or of its floor, is not looked at again.

    Tiles are products of single precision, which only say what cannot rank: whatever comes within their error of a floor is multiplied again in
    double precision. The first tiles are narrow, so that floors rise before the wide ones.
    """
    if floor is None:
        floor = np.full(len(q), -np.inf if gate is None else gate)
    codes = pd.factorize(np.concatenate([q_ids, m_ids]))[0]
    column = pd.DataFrame({"id": codes[len(q) :], "j": np.arange(len(m))})
    q32, m32 = q.astype(np.float32), m.astype(np.float32)
    longest = lambda v: float(np.sqrt((v * v).sum(axis=1).max(initial=0.0)))
    slack = (q.shape[1] + 4) * 2.0**-23 * longest(q) * longest(m)
    out, room = [], np.empty(min(STEP, len(q)) * min(max(FIRST, TILE), len(m)), np.float32)
    for a in range(0, len(q), STEP):
        part, part32 = q[a : a + STEP], q32[a : a + STEP]
        own = pd.DataFrame({"id": codes[a : a + len(part)], "i": np.arange(len(part))}).merge(column, on="id")
        own_i, own_j = own["i"].to_numpy(), own["j"].to_numpy()
        least, last = floor[a : a + STEP].copy(), np.full(len(part), np.iinfo(np.int64).max)
        rows, cols, sims = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        b, width = 0, min(FIRST, TILE)
        while b < len(m):
            tile = m32[b : b + width]
            s = np.matmul(part32, tile.T, out=room[: len(part) * len(tile)].reshape(len(part), len(tile)))
            here = (own_j >= b) & (own_j < b + width)
            s[own_i[here], own_j[here] - b] = -np.inf
            under = _under(s, least, k, slack)
            some = np.flatnonzero(s.max(axis=1) >= under)  # few rows once floors are high
            i, j = np.divmod(np.flatnonzero(s[some] >= under[some, None]), len(tile))
            i = some[i]
            there = s[i, j] > -np.inf
            i, j = i[there], j[there] + b
            b, width = b + width, min(2 * width, TILE)
            exact = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", part[i[c : c + PAIRS]], m[j[c : c + PAIRS]]) for c in range(0, len(i), PAIRS))])
            ahead = (exact > least[i]) | (exact == least[i]) & (pos[j] <= last[i])  # of equal ones only those before the k-th best
            if not ahead.any():
                continue
            rows, cols, sims = np.concatenate([rows, i[ahead]]), np.concatenate([cols, j[ahead]]), np.concatenate([sims, exact[ahead]])
            order = np.lexsort((pos[cols], -sims, rows))
            rows, cols, sims = rows[order], cols[order], sims[order]
            nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
            full = nth == k - 1
            least[rows[full]], last[rows[full]] = sims[full], pos[cols[full]]
            rows, cols, sims = rows[nth < k], cols[nth < k], sims[nth < k]
        out.append((rows + a, cols, sims))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _under(s: np.ndarray, least: np.ndarray, k: int, slack: float) -> np.ndarray:
    """What a product of single precision must reach for its pair to be looked at: a row's floor or, where that is open, the k-th best of the row's products."""
    out = least - slack
    rows = np.flatnonzero(np.isneginf(least))
    if len(rows) and s.shape[1] > k:
        out[rows] = np.partition(s[rows], s.shape[1] - k, axis=1)[:, s.shape[1] - k] - 2 * slack
    return out.astype(np.float32) - np.float32(slack)


def _blocks(n: int, width: int) -> int:
    """Into how many blocks a side of n vectors is dealt. Each row of the other side goes to every one of them, so these stay SIDE, whatever n, until a block outgrows BLOCK_BYTES."""
    return max(1, min(-(-n // BLOCK), max(SIDE, -(-n * width * 8 // BLOCK_BYTES))))


def _blocks_of(n: Column, width: int, side: Column | float = SIDE) -> Column:
    """_blocks() of a column; side: the blocks beyond which a bucket takes more only for their bytes."""
    return F.greatest(F.lit(1), F.least(F.ceil(n / BLOCK), F.greatest(F.ceil(side * F.lit(1.0)), F.ceil(n * (width * 8) / BLOCK_BYTES)))).cast("int")


def shared_out(sizes: DataFrame, width: int) -> DataFrame:
    """sizes (key, c: rows of a bucket) with n, its blocks: about SIDE * SIDE pairs of blocks over all buckets, dealt out by the pairs of rows of each, so many small buckets are not cut up as if each were alone."""
    total = sizes.agg(F.coalesce(F.sum(F.col("c").cast("double") * F.col("c")), F.lit(1.0))).first()[0]
    return sizes.select("key", _blocks_of(F.col("c"), width, F.col("c") * (SIDE / max(1.0, total) ** 0.5)).alias("n"))


def _deal(queries: DataFrame, memories: DataFrame, bucket: str, n_q, n_m, k: int, gate: float | None, number: str = "double") -> DataFrame:
    """(q_id, id, _pos, sim): within each bucket, blocks of queries meet blocks of memories, one task per pair of blocks, and each query takes k rows from each."""
    vector = F.col("embedding").cast(f"array<{number}>").alias("embedding")
    none = F.lit(None).cast("string")
    left = queries.select(bucket, F.col("q_id").cast("string").alias("q_id"), none.alias("id"), F.lit(None).cast("long").alias("_pos"), vector, F.pmod(F.xxhash64("q_id"), n_q).cast("int").alias("bq"), F.explode(F.sequence(F.lit(0), (n_m - 1).cast("int"))).alias("bm"))
    right = memories.select(bucket, none.alias("q_id"), F.col("id").cast("string").alias("id"), F.col("_pos").cast("long").alias("_pos"), vector, F.explode(F.sequence(F.lit(0), (n_q - 1).cast("int"))).alias("bq"), F.pmod(F.xxhash64("id"), n_m).cast("int").alias("bm"))

    def join(group: pa.Table) -> pa.Table:
        asks = pc.is_valid(group["q_id"])
        q, m = group.filter(asks), group.filter(pc.invert(asks))
        if not len(q) or not len(m):
            return FOUND.empty_table()
        names, ids, pos = q["q_id"].combine_chunks(), m["id"].combine_chunks(), m["_pos"].to_numpy().astype(np.int64)
        rows, cols, sims = _nearest(_unit(q["embedding"]), _unit(m["embedding"]), names.to_numpy(False), ids.to_numpy(False), pos, k, gate)
        return pa.table([names.take(pa.array(rows)), ids.take(pa.array(cols)), pa.array(pos[cols]), pa.array(sims)], schema=FOUND)

    return left.unionByName(right).groupBy(bucket, "bq", "bm").applyInArrow(join, "q_id string, id string, _pos long, sim double")


def _single(vectors: DataFrame) -> tuple[int, int, str]:
    """How many vectors there are, their width, and the type that they can travel in as they are: single precision where every number is one of it."""
    exact = F.coalesce(F.forall("embedding", lambda x: x.cast("double") == x.cast("float").cast("double")), F.lit(False))
    n, width, single = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0)), F.coalesce(F.bool_and(exact), F.lit(False))).first()
    return n, width, "float" if single else "double"


def _side(size: int) -> int:
    """The least prime from OWN on under which a line of the square holds no more than BLOCK_BYTES of `size` bytes of vectors."""
    side = max(OWN, -(-size // BLOCK_BYTES))
    while any(side % d == 0 for d in range(2, int(side**0.5) + 1)):
        side += 1
    return side


def _lined(memories: DataFrame, side: int) -> DataFrame:
    """memories with _b, a block of the square (_b // side, _b % side), once for each of the side + 1 lines through it (_line). Modulo a prime, every two blocks lie on one line: an upright one (from side * side on), or one of side slopes."""
    x, y = F.floor(F.col("_b") / side), F.col("_b") % side
    line = lambda m: F.when(m == side, side * side + x).otherwise(m * side + F.pmod(y - m * x, F.lit(side))).cast("int")
    return memories.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(side * side)).cast("int")).withColumn("_line", F.explode(F.transform(F.sequence(F.lit(0), F.lit(side)), line)))


def _among(memories: DataFrame, side: int, k: int, gate: float | None, number: str) -> DataFrame:
    """(q_id, id, _pos, sim): the memories are dealt into a square of blocks, and a line of blocks is one task, where each block is asked for the others; in the upright lines it meets itself too. So every two memories meet in one task, and a row goes to side + 1 of side * (side + 1) tasks."""
    rows = memories.select(F.col("id").cast("string").alias("id"), F.col("_pos").cast("long").alias("_pos"), F.col("embedding").cast(f"array<{number}>").alias("embedding"))

    def join(group: pa.Table) -> pa.Table:
        block, upright = group["_b"].to_numpy(), group["_line"][0].as_py() >= side * side
        names, pos, unit = group["id"].combine_chunks(), group["_pos"].to_numpy().astype(np.int64), _unit(group["embedding"])
        codes = pd.factorize(names.to_numpy(False))[0]
        out = []
        for b in np.unique(block):
            asks = np.flatnonzero(block == b)
            held = np.arange(len(block)) if upright else np.flatnonzero(block != b)
            if not len(held):
                continue
            i, j, sims = _nearest(unit[asks], unit[held], codes[asks], codes[held], pos[held], k, gate)
            out.append(pa.table([names.take(pa.array(asks[i])), names.take(pa.array(held[j])), pa.array(pos[held[j]]), pa.array(sims)], schema=FOUND))
        return pa.concat_tables(out) if out else FOUND.empty_table()

    return _lined(rows, side).groupBy("_line").applyInArrow(join, "q_id string, id string, _pos long, sim double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    ranked = found.withColumn("rnk", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("sim"), "_pos")))
    return ranked.where(F.col("rnk") <= k).select("q_id", "rnk", "id", "sim")


def _in_place(queries: DataFrame, memories: DataFrame, k: int, gate: float | None) -> DataFrame:
    """(q_id, id, _pos, sim): the queries' matrix goes to the memories, which are read where they are."""
    rows = queries.select(F.col("q_id").cast("string").alias("q_id"), F.col("embedding").cast("array<double>").alias("embedding")).toPandas()  # at most FEW_BYTES
    names, matrix = rows["q_id"].to_numpy(object), _matrix(rows["embedding"]) if len(rows) else np.zeros((0, 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floor = np.full(len(names), -np.inf if gate is None else gate)
        rows, ids, pos, sims = np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0, np.int64), np.zeros(0)
        for m in batches:
            if not len(m) or not len(names):
                continue
            m_ids, m_pos = m["id"].to_numpy(object), m["_pos"].to_numpy(np.int64)
            i, j, s = _nearest(matrix, _matrix(m["embedding"]), names, m_ids, m_pos, k, gate, floor)
            rows, ids, pos, sims = np.concatenate([rows, i]), np.concatenate([ids, m_ids[j]]), np.concatenate([pos, m_pos[j]]), np.concatenate([sims, s])
            order = np.lexsort((pos, -sims, rows))
            rows, ids, pos, sims = rows[order], ids[order], pos[order], sims[order]
            nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
            floor[rows[nth == k - 1]] = sims[nth == k - 1]
            rows, ids, pos, sims = (x[nth < k] for x in (rows, ids, pos, sims))
        yield pd.DataFrame({"q_id": names[rows], "id": ids, "_pos": pos, "sim": sims})

    plain = memories.select(F.col("id").cast("string").alias("id"), F.col("_pos").cast("long").alias("_pos"), F.col("embedding").cast("array<double>").alias("embedding"))
    return plain.mapInPandas(run, "q_id string, id string, _pos long, sim double")


def search(queries: DataFrame, memories: DataFrame, k: int, gate: float | None = None, within: str | None = None) -> DataFrame:
    """(q_id, rnk, id, sim) of the k memories most similar to each query, ties by place; a query does not find its own id.

    queries: q_id (unique), embedding. memories: id, _pos, embedding; ids are strings;
    rows without a vector are left out. within: a column of both; only rows equal in it meet (stores of their own).
    Queries whose matrix is small go to the memories; otherwise both sides meet in pairs of blocks.
    """
    mem, qs = memories.where(F.col("embedding").isNotNull()), queries.where(F.col("embedding").isNotNull())
    if within is not None:
        sizes = lambda df: df.groupBy(within).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
        blocks = sizes(mem).withColumnRenamed("n", "n_m").join(sizes(qs).withColumnRenamed("n", "n_q"), within)  # one row per store
        return _ranked(_deal(qs.join(blocks, within), mem.join(blocks, within), within, F.col("n_q"), F.col("n_m"), k, gate), k)
    n, width, number = _single(qs)
    if n * width * 8 <= FEW_BYTES:
        return _ranked(_in_place(qs, mem, k, gate), k)
    number = "double" if number == "double" else _single(mem)[2]
    mem, qs = mem.withColumn("_bucket", F.lit(0)), qs.withColumn("_bucket", F.lit(0))
    n_q, n_m = _blocks(n, width), _blocks(mem.count(), width)
    return _ranked(_deal(qs, mem, "_bucket", F.lit(n_q), F.lit(n_m), k, gate, number), k)


def neighbours(memories: DataFrame, k: int, gate: float | None = None) -> DataFrame:
    """search() of all memories among themselves. Those of more than one small block meet in lines of blocks at every size, so a row goes to OWN + 1 tasks, whatever the rows, until a line outgrows BLOCK_BYTES."""
    mem = memories.where(F.col("embedding").isNotNull())
    n, width, number = _single(mem)
    if n <= BLOCK and n * width * 8 <= FEW_BYTES:
        return _ranked(_in_place(mem.select(F.col("id").alias("q_id"), "embedding"), mem, k, gate), k)
    return _ranked(_among(mem, _side(n * width * 8), k, gate, number), k)


def _before(memories: DataFrame, is_bare: Column) -> DataFrame:
    """memories with _bare, and _before: how many bare memories have a smaller _pos, counted within blocks of places and then lifted, so that no task sorts them all."""
    rows = memories.withColumns({"_bare": is_bare, "_block": F.floor(F.col("_pos") / 4096)})
    lifts = rows.groupBy("_block").agg(F.count_if("_bare").alias("_n")).withColumn("_lift", F.sum("_n").over(Window.orderBy("_block")) - F.col("_n"))  # a row per block
    inside = F.count_if("_bare").over(Window.partitionBy("_block").orderBy("_pos")) - F.col("_bare").cast("long")
    return rows.withColumn("_inside", inside).join(lifts.select("_block", "_lift"), "_block").withColumn("_before", F.col("_inside") + F.col("_lift")).drop("_block", "_inside", "_lift")


def _ask(queries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Names and unit rows of a stated set of queries."""
    rows = queries.where(F.col("embedding").isNotNull()).select(F.col("q_id").cast("string").alias("q_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    if n * width * 8 > FEW_BYTES:
        raise ValueError("a whole ranking is for queries whose matrix is small")
    asked = rows.toPandas()  # at most FEW_BYTES
    return asked["q_id"].to_numpy(object), _matrix(asked["embedding"]) if n else np.zeros((0, width))


#: A similarity under this is 0 to twelve places; how many of these may travel with the queries.
ZERO, ZEROS = 5e-13, 1 << 20


def ranking(queries: DataFrame, memories: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(q_id, rnk, id, sim) of every memory for each query of a stated set, by similarity to twelve places, ties by place; no list is cut. A memory without a vector has similarity 0, and a query does not meet its own id.

    Only rows of memories with a vector are shuffled and sorted. The bare ones (no vector, or none but zeros) come by place where the similarity is 0, so
    their ranks are counted: the rows above 0, the bare ones before, and the few vectors of similarity 0 before.
    terms (q_id, term): adds is_target, whether the memory's text holds the query's term, whatever the case. Memories are looked through once for each different term.
    """
    names, matrix = _ask(queries)
    want = {} if terms is None else {r["q_id"]: r["t"] for r in terms.select("q_id", F.lower("term").alias("t")).collect() if r["t"] is not None}  # a row per query
    words = sorted({want[q] for q in names if q in want})
    place = {t: i for i, t in enumerate(words)}
    of = np.array([place[want[q]] if q in want else len(words) for q in names], np.int64)
    size = len(words) // 8 + 1

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [np.packbits([t is not None and w in t for w in words] + [False] * (8 * size - len(words))).view(np.int8) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["id"], b["_pos"], b["embedding"], pa.array(held, pa.list_(pa.int8()))], names=["id", "_pos", "embedding", "_held"])

    text = F.lit(None).cast("string") if terms is None else F.lower("text")
    plain = memories.select(F.col("id").cast("string").alias("id"), F.col("_pos").cast("long").alias("_pos"), F.col("embedding").cast("array<double>").alias("embedding"), text.alias("text"))
    looked = plain.mapInArrow(look, "id string, _pos long, embedding array<double>, _held array<tinyint>")
    bare = F.col("embedding").isNull() | ~F.exists("embedding", lambda x: x != 0)
    placed = _before(looked, bare).checkpoint()  # read for the counts and for both kinds of rows
    n_bare = placed.where("_bare").count()
    vectors = placed.where("NOT _bare").select("id", "_pos", "_before", "_held", "embedding")

    own = np.full(len(names), np.iinfo(np.int64).max)  # places of queries that are bare themselves
    for b in placed.where("_bare").join(F.broadcast(queries.select(F.col("q_id").cast("string").alias("id"))), "id", "left_semi").select("id", "_pos").collect():
        own[names == b["id"]] = b["_pos"]

    def products(m: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return matrix @ _unit(pa.chunked_array([m["embedding"]])).T, names[:, None] != m["id"].to_numpy(False)[None, :]

    step = max(1, STEP * STEP // max(1, len(names)))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids = pa.array(names, pa.string())
        for whole in batches:
            for lo in range(0, len(whole) if len(names) else 0, step):
                m = whole.slice(lo, step)
                sims, other = products(m)
                bits = np.unpackbits(m["_held"].flatten().to_numpy().view(np.uint8).reshape(len(m), size), axis=1).astype(bool)
                q, i = np.nonzero(other)
                at = pa.array(i)
                pos, before = m["_pos"].to_numpy()[i], m["_before"].to_numpy()[i]
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(q)), m["id"].take(at), pa.array(pos), pa.array(before - (own[q] < pos)), pa.array(sims[q, i]), pa.array(bits[i, of[q]])], names=["q_id", "id", "_pos", "_before", "sim", "is_target"])

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above, zeros = np.zeros(len(names), np.int64), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for whole in batches:
            for lo in range(0, len(whole) if len(names) else 0, step):
                m = whole.slice(lo, step)
                sims, other = products(m)
                above += (other & (sims >= ZERO)).sum(axis=1)
                q, i = np.nonzero(other & (np.abs(sims) < ZERO))
                zeros.append((q, m["_pos"].to_numpy()[i]))
        q, pos = (np.concatenate(x) for x in zip(*zeros, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.arange(len(names)), q])), pa.array(np.concatenate([above, np.zeros(len(q), np.int64)])), pa.array([None] * len(names) + pos.tolist(), pa.int64())], names=["q", "above", "zero"])

    counted = vectors.mapInArrow(signs, "q long, above long, zero long").checkpoint()
    key = F.when(F.abs("sim") < ZERO, 0.0).otherwise(F.round("sim", 12))
    rows = vectors.mapInArrow(pairs, "q_id string, id string, _pos long, _before long, sim double, is_target boolean").withColumn("_key", key)
    by_rank = Window.partitionBy("q_id").orderBy(F.desc("_key"), "_pos")
    columns = ["q_id", "rnk", "id", "sim"] + (["is_target"] if terms is not None else [])
    spark = memories.sparkSession
    asked = spark.createDataFrame(pd.DataFrame({"q": np.arange(len(names)), "q_id": names.astype(object), "_byte": of // 8, "_bit": 128 >> (of % 8), "_asks": of < len(words), "_own": own}), "q long, q_id string, _byte int, _bit int, _asks boolean, _own long")
    bared = F.broadcast(asked).crossJoin(placed.where("_bare").select("id", "_pos", "_before", "_held")).where("q_id <> id")
    bared = bared.withColumns({"is_target": F.col("_asks") & (F.get("_held", F.col("_byte")).cast("int").bitwiseAND(F.col("_bit")) != 0), "sim": F.lit(0.0)})
    if counted.where("zero IS NOT NULL").count() > ZEROS:  # too many to travel: all rows are sorted
        every = rows.select("q_id", "id", "_pos", "sim", "is_target", "_key").unionByName(bared.select("q_id", "id", "_pos", "sim", "is_target", F.lit(0.0).alias("_key")))
        return every.withColumn("rnk", F.row_number().over(by_rank).cast("long")).select(*columns)
    lift = F.when(F.col("_key") > 0, 0).when(F.col("_key") < 0, n_bare).otherwise(F.col("_before"))
    ranked = rows.withColumn("rnk", F.row_number().over(by_rank) + lift)
    numbers = counted.groupBy("q").agg(F.sum("above").alias("_above"), F.array_sort(F.collect_list("zero")).alias("_zeros"))  # collect_list leaves nulls out
    known = F.broadcast(asked.join(numbers, "q", "left").select("q_id", F.coalesce("_above", F.lit(0)).alias("_above"), F.coalesce("_zeros", F.array().cast("array<bigint>")).alias("_zeros")))  # a row per query
    bared = bared.join(known, "q_id")
    before = F.size(F.filter("_zeros", lambda z: z < F.col("_pos"))) + F.col("_before") - (F.col("_own") < F.col("_pos")).cast("long")
    bared = bared.withColumn("rnk", F.col("_above") + before + 1)
    return ranked.select(*columns).unionByName(bared.select(*columns))


def ranks_of(queries: DataFrame, memories: DataFrame, targets: DataFrame) -> DataFrame:
    """(q_id, id, rank): the exact rank of each query's target (q_id, id) among all memories, by counting those above it (ties by place): nothing is ranked, sorted or cut. 0 where the query has no vector or the target is no memory, or is the query itself."""
    want = targets.join(memories.select(F.col("id").cast("string").alias("id"), F.col("_pos").cast("long").alias("_pos"), F.col("embedding").cast("array<double>").alias("v")), "id").where("q_id <> id")
    rows = queries.where(F.col("embedding").isNotNull()).select(F.col("q_id").cast("string").alias("q_id"), F.col("embedding").cast("array<double>").alias("embedding")).join(want, "q_id")
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    blocks = max(1, -(-n * width * 16 // FEW_BYTES))
    out = None
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("q_id"), F.lit(blocks)) == b).select("q_id", "id", "_pos", "embedding", "v").toPandas()  # one block
        names, own, place = part["q_id"].to_numpy(object), part["id"].to_numpy(object), part["_pos"].to_numpy(np.int64)
        matrix = _matrix(part["embedding"]) if len(part) else np.zeros((0, width))
        mark = (matrix * _matrix(pd.Series([np.zeros(width) if v is None else v for v in part["v"]]))).sum(axis=1) if len(part) else np.zeros(0)

        def run(batches: Iterator[pd.DataFrame], names=names, own=own, place=place, matrix=matrix, mark=mark) -> Iterator[pd.DataFrame]:
            above = np.zeros(len(names), np.int64)
            for whole in batches:
                for lo in range(0, len(whole) if len(names) else 0, STEP):
                    m = whole.iloc[lo : lo + STEP]
                    ids, pos = m["id"].to_numpy(object), m["_pos"].to_numpy(np.int64)
                    sims = matrix @ _matrix(pd.Series([np.zeros(width) if v is None else v for v in m["embedding"]])).T
                    even = np.abs(sims - mark[:, None]) <= 1e-12
                    ahead = ~even & (sims > mark[:, None]) | even & (pos[None, :] < place[:, None])
                    ahead &= (ids[None, :] != names[:, None]) & (ids[None, :] != own[:, None])
                    above += ahead.sum(axis=1)
            yield pd.DataFrame({"q_id": names, "id": own, "n": above})

        plain = memories.select(F.col("id").cast("string").alias("id"), F.col("_pos").cast("long").alias("_pos"), F.col("embedding").cast("array<double>").alias("embedding"))
        counted = plain.mapInPandas(run, "q_id string, id string, n long")
        out = counted if out is None else out.unionByName(counted)
    ranked = out.groupBy("q_id", "id").agg((F.sum("n") + 1).alias("rank"))
    return targets.select("q_id", "id").join(ranked, ["q_id", "id"], "left").select("q_id", "id", F.coalesce("rank", F.lit(0)).alias("rank"))


def _signs(vectors: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    """The bucket of each vector in each table: on which side of `bits` random hyperplanes it lies. Fewer tables are the first of more."""
    planes = np.random.default_rng(seed).normal(size=(tables, vectors.shape[1], bits))
    return np.stack([(vectors @ p > 0) @ (1 << np.arange(bits)) for p in planes], axis=1)


def fit_index(memories: DataFrame, k: int, seed: int = 7, sample: int = SAMPLE, target: float = TARGET) -> tuple[int, int]:
    """Tables and bits of the cheapest index that finds `target` of the true k nearest of a bounded sample of memories.

    The sample's neighbours are searched exactly among all memories. An index's cost is its
    tables over its buckets; bits stop where a bucket would hold less than a block.
    """
    mem = memories.where(F.col("embedding").isNotNull()).select("id", "_pos", F.col("embedding").cast("array<double>").alias("embedding"))
    asked = mem.orderBy(F.xxhash64("id")).limit(sample)
    pairs = search(asked.select(F.col("id").alias("q_id"), "embedding"), mem, k).select("q_id", "id")
    rows = pairs.join(mem.select("id", F.col("embedding").alias("v")), "id").join(mem.select(F.col("id").alias("q_id"), F.col("embedding").alias("q")), "q_id").select("q", "v").toPandas()  # sample * k rows
    if rows.empty:
        return 1, 1
    q, v = _matrix(rows["q"]), _matrix(rows["v"])
    most = max(1, min(BITS, int(np.log2(max(2, mem.count() / BLOCK))) + 4))
    fits = []
    for bits in range(1, most + 1):
        met = np.maximum.accumulate(_signs(q, TABLES, bits, seed) == _signs(v, TABLES, bits, seed), axis=1).mean(axis=0)
        enough = np.flatnonzero(met >= target)
        if len(enough):
            fits.append(((int(enough[0]) + 1) / 2**bits, int(enough[0]) + 1, bits))
    return min(fits)[1:] if fits else (1, 0)  # no index will do: one bucket of all


def lsh_search(memories: DataFrame, k: int, tables: int | None = None, bits: int | None = None, seed: int = 7) -> DataFrame:
    """(q_id, rnk, id, sim): search() of all memories among themselves, but only rows that share a bucket of random hyperplanes in one of the tables meet.

    Every row is in the index. Without tables and bits these are fitted (fit_index), so that they grow with
    the memories as far as these can be told apart; large buckets are dealt out in blocks.
    """
    mem = memories.where(F.col("embedding").isNotNull()).select("id", "_pos", F.col("embedding").cast("array<double>").alias("embedding"))
    if tables is None or bits is None:
        tables, bits = fit_index(mem, k, seed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for m in batches:
            vectors = np.stack(m["embedding"].to_numpy()) if len(m) else np.zeros((0, 1))
            yield m.assign(keys=list(_signs(vectors, tables, bits, seed) + (np.arange(tables) << bits)))

    keyed = mem.mapInPandas(run, f"{mem.schema.simpleString()[7:-1].replace(':', ' ')}, keys array<long>").withColumn("key", F.explode("keys")).drop("keys")
    width = mem.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()[0]
    sizes = shared_out(keyed.groupBy("key").agg(F.count("*").alias("c")), width)  # at most TABLES * 2 ** BITS rows
    keyed = keyed.join(sizes, "key")
    found = _deal(keyed.withColumn("q_id", F.col("id")), keyed, "key", F.col("n"), F.col("n"), k, None)
    # a pair that meets in several tables is one, though products of other shapes may differ in their last bits
    return _ranked(found.groupBy("q_id", "id", "_pos").agg(F.max("sim").alias("sim")), k)
