"""Exact neighbours by cells: an inverted file whose cells are left out only where they cannot hold one.

Centres are fitted by spherical k-means on a bounded sample; every row then belongs to the cell of its nearest
centre, and a cell's reach is the largest angle of its rows to the centre, over all of them. Angles obey the triangle rule, so a
cell whose centre lies further from a query than its reach and the gate's angle together holds nothing above the
gate. Queries go to the cells that are left and meet their rows there, in blocks; without a gate, or with a number of
probes, only the nearest cells are visited, with a recall that fit_probes() measures.

Rows with equal vectors are one query, and as neighbours only the first k + 1 of them by place can rank; so a vector that
a third of all rows share costs no more than another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engrama.operators import knn

#: Rows that centres are fitted on, rounds of fitting, and the most cells.
SAMPLE, ROUNDS, MOST = 16_384, 12, 2_048
#: Rows whose true neighbours tell how many cells to probe.
ASKED = 256
#: Angles are compared with this to spare.
SLACK = 1e-6
#: Rows of one matrix product with the centres.
STEP = 4_096


@dataclass(frozen=True)
class Cells:
    """Unit centres, one per row, and each cell's reach in radians (-1 where it has no rows)."""

    centres: np.ndarray
    reach: np.ndarray

    def angles(self, unit: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(unit @ self.centres.T, -1.0, 1.0))


def _spherical(unit: np.ndarray, cells: int, seed: int) -> np.ndarray:
    """Centres of unit rows; an empty cell takes the row that lies furthest from its own centre."""
    rng = np.random.default_rng(seed)
    centres = unit[rng.permutation(len(unit))[:cells]]
    for _ in range(ROUNDS):
        near = np.concatenate([(unit[at : at + STEP] @ centres.T).argmax(axis=1) for at in range(0, len(unit), STEP)])
        new = np.zeros_like(centres)
        np.add.at(new, near, unit)
        size = np.sqrt((new * new).sum(axis=1))
        empty = np.flatnonzero(size < 1e-12)
        if len(empty):
            far = np.argsort((unit * centres[near]).sum(axis=1))[: len(empty)]
            new[empty[: len(far)]] = unit[far]
            size = np.sqrt((new * new).sum(axis=1))
        kept = size >= 1e-12
        moved = np.abs(new[kept] / size[kept, None] - centres[kept]).max(initial=0.0)
        centres = np.where(kept[:, None], new / np.maximum(size, 1e-12)[:, None], centres)
        if moved < 1e-4:
            break
    return centres


def _vectors(rows: DataFrame, *names: str) -> DataFrame:
    return rows.where(F.col("embedding").isNotNull()).select(*names, F.col("embedding").cast("array<double>").alias("embedding"))


def fit(memories: DataFrame, cells: int | None = None, sample: int = SAMPLE, seed: int = 7) -> Cells:
    """Cells for memories (id, embedding): about the square root of their number, at most MOST and an eighth of the sample. Every row counts for the reach of its cell. Null and zero vectors are in no cell."""
    mem = _vectors(memories, "id")
    taken = mem.orderBy(F.xxhash64("id")).limit(sample).select("embedding").toPandas()  # at most `sample` rows
    unit = knn._matrix(taken["embedding"]) if len(taken) else np.zeros((0, 1))
    unit = unit[(unit * unit).sum(axis=1) > 0.5]
    if not len(unit):
        return Cells(np.zeros((0, 1)), np.zeros(0))
    n = cells or max(1, min(MOST, round(mem.count() ** 0.5), len(unit) // 8))
    centres = _spherical(np.unique(unit, axis=0), min(n, len(np.unique(unit, axis=0))), seed)
    placed = assigned(mem, Cells(centres, np.zeros(0))).groupBy("cell").agg(F.max("angle").alias("reach")).collect()  # one row per cell
    reach = np.full(len(centres), -1.0)
    for r in placed:
        reach[r["cell"]] = r["reach"]
    return Cells(centres, reach)


def assigned(rows: DataFrame, cells: Cells) -> DataFrame:
    """rows (with embedding) and the cell of each, with the angle to its centre; zero vectors have none and are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            unit = knn._matrix(b["embedding"]) if len(b) else np.zeros((0, cells.centres.shape[1]))
            there = (unit * unit).sum(axis=1) > 0.5
            angles = cells.angles(unit[there])
            cell = angles.argmin(axis=1) if len(angles) else np.zeros(0, int)
            yield b[there].assign(cell=cell.astype(np.int32), angle=angles[np.arange(len(angles)), cell])

    return rows.mapInPandas(run, f"{_ddl(rows)}, cell int, angle double")


def _open(b: pd.DataFrame, cells: Cells, gate: float | None, probes: int | None) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows of b with a direction, and which cells each of them visits."""
    limit = np.inf if gate is None or gate <= 0 else float(np.arccos(min(gate, 1.0))) + SLACK
    unit = knn._matrix(b["embedding"]) if len(b) else np.zeros((0, cells.centres.shape[1]))
    there = (unit * unit).sum(axis=1) > 0.5
    angles = cells.angles(unit[there])
    open_ = (angles <= cells.reach[None, :] + limit) & (cells.reach >= 0)[None, :]
    if probes is not None:
        rank = np.argsort(np.argsort(np.where(open_, angles, np.inf), axis=1, kind="stable"), axis=1, kind="stable")
        open_ &= rank < probes
    return b[there], open_


def visits(queries: DataFrame, cells: Cells, gate: float | None, probes: int | None) -> DataFrame:
    """queries (with embedding) once for each cell that they visit: those that can hold a row at or above the gate, and of these the `probes` nearest if that is given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, open_ = _open(b, cells, gate, probes)
            yield rows.assign(cells=[np.flatnonzero(o).astype(np.int32) for o in open_])

    out = queries.mapInPandas(run, f"{_ddl(queries)}, cells array<int>")
    return out.select(*queries.columns, F.explode("cells").alias("cell"))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def grouped(cells: Cells, groups: int = knn.SIDE, seed: int = 7) -> np.ndarray:
    """The group of each cell: at most so many, of centres that lie near each other."""
    if len(cells.centres) <= groups:
        return np.arange(len(cells.centres))
    return (cells.centres @ _spherical(cells.centres, groups, seed).T).argmax(axis=1)


def _visiting(queries: DataFrame, cells: Cells, gate: float | None, probes: int | None, group: np.ndarray) -> DataFrame:
    """queries (q_id, embedding) once for each group of cells of which they visit any, with a bit for each cell of the group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, open_ = _open(b, cells, gate, probes)
            for g in range(group.max() + 1):
                mine = open_[:, group == g]
                some = np.flatnonzero(mine.any(axis=1))
                yield rows.iloc[some].assign(grp=np.int32(g), bits=[x.tobytes() for x in np.packbits(mine[some], axis=1)])

    return queries.mapInPandas(run, f"{_ddl(queries)}, grp int, bits binary")


def _met(cells_of: list[np.ndarray], k: int, gate: float | None):
    """From a block of queries and a block of members of one group to the k best of each query: a cell is multiplied with the queries that visit it."""

    def meet(table: pa.Table) -> pa.Table:
        asks = pc.is_valid(table["q_id"])
        q, m = table.filter(asks), table.filter(pc.invert(asks)).sort_by("cell")
        if not len(q) or not len(m):
            return knn.FOUND.empty_table()
        mine, cell, pos = cells_of[table["grp"][0].as_py()], m["cell"].to_numpy(), m["_pos"].to_numpy().astype(np.int64)
        bits = np.unpackbits(np.frombuffer(b"".join(q["bits"].to_pylist()), np.uint8).reshape(len(q), -1), axis=1)[:, : len(mine)].astype(bool)
        asked, held, places = knn._unit(q["embedding"]), knn._unit(m["embedding"]), np.arange(-len(q), 0)  # names of queries are no ids
        floor = np.full(len(q), -np.inf if gate is None else gate)
        rows, cols, sims = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for c, lo, hi in zip(mine, np.searchsorted(cell, mine), np.searchsorted(cell, mine, "right"), strict=True):
            which = np.flatnonzero(bits[:, np.searchsorted(mine, c)])
            if lo == hi or not len(which):
                continue
            i, j, s = knn._nearest(asked[which], held[lo:hi], places[which], np.arange(lo, hi), pos[lo:hi], k, None, floor[which])
            rows, cols, sims = np.concatenate([rows, which[i]]), np.concatenate([cols, j + lo]), np.concatenate([sims, s])
            order = np.lexsort((pos[cols], -sims, rows))
            rows, cols, sims = rows[order], cols[order], sims[order]
            nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
            floor[rows[nth == k - 1]] = sims[nth == k - 1]
            rows, cols, sims = rows[nth < k], cols[nth < k], sims[nth < k]
        names, ids = q["q_id"].combine_chunks(), m["id"].combine_chunks()
        return pa.table([names.take(pa.array(rows)), ids.take(pa.array(cols)), pa.array(pos[cols]), pa.array(sims)], schema=knn.FOUND)

    return meet


def _distinct(rows: DataFrame) -> DataFrame:
    """rows with v, which names their vector (by 128 bits of hash)."""
    bits = lambda seed: F.hex(F.xxhash64(F.lit(seed), "embedding"))
    return rows.withColumn("v", F.concat_ws("-", bits(1), bits(2)))


def search(queries: DataFrame, memories: DataFrame, k: int, gate: float | None = None, cells: Cells | None = None, probes: int | None = None) -> DataFrame:
    """(q_id, rnk, id, sim): knn.search() by cells. Exact without probes; with probes each query visits so many cells only.

    Null and zero vectors have no neighbours and are none's, so a gate that is not above 0 leaves out rows of similarity 0
    that knn.search() would rank. Ties go by place; a query does not find its own id; repeated rows count each; empty tables give no rows.
    """
    cells = fit(memories) if cells is None else cells
    asks = _distinct(_vectors(queries, F.col("q_id").cast("string").alias("q_id")))
    mem = _distinct(_vectors(memories, F.col("id").cast("string").alias("id"), F.col("_pos").cast("long").alias("_pos")))
    if not len(cells.centres):
        return mem.select(F.col("id").alias("q_id"), F.lit(1).alias("rnk"), "id", F.lit(0.0).alias("sim")).where("false")
    first = Window.partitionBy("v").orderBy("_pos", "id")
    members = assigned(mem.withColumn("_i", F.row_number().over(first)).where(F.col("_i") <= k + 1).select("id", "_pos", "embedding"), cells).drop("angle")
    each = asks.groupBy("v").agg(F.first("embedding").alias("embedding"))
    # a query goes to groups of cells, so the copies of a row do not grow with the cells
    group, width = grouped(cells), cells.centres.shape[1]
    of = mem.sparkSession.createDataFrame([(c, int(g)) for c, g in enumerate(group)], "cell int, grp int")  # a row per cell
    members, n_q = members.join(F.broadcast(of), "cell"), knn._blocks(each.count(), width)
    sizes = F.broadcast(members.groupBy("grp").agg(F.ceil(F.count("*") * (width * 8) / knn.BLOCK_BYTES).cast("int").alias("n_m")))  # a row per group
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    left = _visiting(each.select(F.concat(F.lit("="), "v").alias("q_id"), "embedding"), cells, gate, probes, group).join(sizes, "grp")
    left = left.select("grp", "q_id", none("string", "id"), none("long", "_pos"), none("int", "cell"), "bits", "embedding", F.pmod(F.xxhash64("q_id"), F.lit(n_q)).cast("int").alias("bq"), F.explode(F.sequence(F.lit(0), F.col("n_m") - 1)).alias("bm"))
    right = members.join(sizes, "grp").select("grp", none("string", "q_id"), "id", "_pos", "cell", none("binary", "bits"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("bq"), F.pmod(F.xxhash64("id"), F.col("n_m")).cast("int").alias("bm"))
    cells_of = [np.flatnonzero(group == g) for g in range(group.max() + 1)]
    found = left.unionByName(right).groupBy("grp", "bq", "bm").applyInArrow(_met(cells_of, k + 1, gate), "q_id string, id string, _pos long, sim double")
    best = found.withColumn("_r", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("sim"), "_pos"))).where(F.col("_r") <= k + 1)
    mine = asks.select("q_id", F.concat(F.lit("="), "v").alias("_v")).join(best.withColumnRenamed("q_id", "_v"), "_v").where("q_id <> id")
    return knn._ranked(mine, k)


def compared(queries: DataFrame, memories: DataFrame, gate: float | None, cells: Cells, probes: int | None = None) -> DataFrame:
    """One row: pairs of a query and a memory that share a visited cell, and all pairs there are."""
    asks, mem = _vectors(queries, "q_id"), _vectors(memories, "id")
    visiting = visits(asks, cells, gate, probes).groupBy("cell").agg(F.count("*").alias("q"))
    held = assigned(mem, cells).groupBy("cell").agg(F.count("*").alias("m"))
    none = F.lit(0).cast("long")
    parts = visiting.join(held, "cell").select((F.col("q") * F.col("m")).alias("c"), none.alias("q"), none.alias("m"))
    parts = parts.unionByName(asks.agg(F.count("*").alias("q")).select(none.alias("c"), "q", none.alias("m"))).unionByName(mem.agg(F.count("*").alias("m")).select(none.alias("c"), none.alias("q"), "m"))
    return parts.agg(F.sum("c").alias("compared"), (F.sum("q") * F.sum("m")).alias("pairs"))


def fit_probes(memories: DataFrame, cells: Cells, k: int, target: float = knn.TARGET, asked: int = ASKED) -> int:
    """The least number of nearest cells in which a bounded sample of memories finds `target` of its true k nearest, which are searched exactly among all."""
    mem = _vectors(memories, "id", "_pos")
    some = mem.orderBy(F.xxhash64("id")).limit(asked)
    pairs = knn.search(some.select(F.col("id").alias("q_id"), "embedding"), mem, k).select("q_id", "id")
    rows = pairs.join(mem.select("id", F.col("embedding").alias("v")), "id").join(mem.select(F.col("id").alias("q_id"), F.col("embedding").alias("q")), "q_id").select("q", "v").toPandas()  # asked * k rows
    if rows.empty or not len(cells.centres):
        return max(1, len(cells.centres))
    to, home = cells.angles(knn._matrix(rows["q"])), cells.angles(knn._matrix(rows["v"])).argmin(axis=1)
    rank = (to < to[np.arange(len(to)), home][:, None]).sum(axis=1) + 1
    return int(np.sort(rank)[min(len(rank) - 1, int(np.ceil(target * len(rank))) - 1)])
