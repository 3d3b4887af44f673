"""Resharding by minimum-cost flow.

From the bytes of the old shards and the capacities of the new ones a flow
network of a few dozen nodes gives the bytes that each old shard passes to each
new one, moving as few as possible. Blocks of rows are dealt to these flows in
order; only blocks in which one flow ends and another starts are divided by row. Only
shards that gain or lose rows are rewritten; each version has a manifest that says
which version holds the files of each shard.
"""

from __future__ import annotations

from collections import deque
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engrama.llm.shared import if_small, materialise, without

#: Rows of a block, about; a block is the unit that moves.
BLOCK_ROWS = 4096
#: Files whose numbers are broadcast; those of more are joined by shuffle.
BROADCAST_FILES = 1_000_000


def min_cost_flow(supply: dict[int, int], capacity: dict[int, int], cost=lambda old, new: int(old != new)) -> dict[tuple[int, int], int]:
    """Units that each old shard passes to each new one, at the least total cost; capacities must hold all supply.

    Successive shortest paths with the queue form of Bellman-Ford.
    """
    if sum(supply.values()) > sum(capacity.values()):
        raise ValueError("capacities hold less than the shards")
    source, sink = "source", "sink"
    edges: list[list] = []  # [to, units left, cost]; the reverse of edge e is e ^ 1
    out: dict[object, list[int]] = {}

    def link(a: object, b: object, units: int, price: int) -> int:
        for x, y, u, c in ((a, b, units, price), (b, a, 0, -price)):
            out.setdefault(x, []).append(len(edges))
            edges.append([y, u, c])
        return len(edges) - 2

    for i, s in supply.items():
        link(source, ("old", i), s, 0)
    for j, c in capacity.items():
        link(("new", j), sink, c, 0)
    between = {(i, j): link(("old", i), ("new", j), sum(supply.values()), cost(i, j)) for i in supply for j in capacity}
    while True:
        far: dict[object, int] = {source: 0}
        came: dict[object, int] = {}
        queue, waiting = deque([source]), {source}
        while queue:
            waiting.discard(a := queue.popleft())
            for e in out.get(a, ()):
                b, units, price = edges[e]
                if units and far[a] + price < far.get(b, 1 << 60):
                    far[b], came[b] = far[a] + price, e
                    if b not in waiting:
                        waiting.add(b)
                        queue.append(b)
        if sink not in came:
            break
        path, at = [], sink
        while at != source:
            path.append(came[at])
            at = edges[came[at] ^ 1][0]
        units = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= units
            edges[e ^ 1][1] += units
    return {k: edges[e ^ 1][1] for k, e in between.items() if edges[e ^ 1][1]}


def equal_capacities(total: int, shards: int) -> dict[int, int]:
    return {j: total // shards + (j < total % shards) for j in range(shards)}


def _divide(pdf: pd.DataFrame) -> pd.DataFrame:
    """Deals the rows of one divided block: largest first into the first flow that still has room, else into the one with most room."""
    pdf = pdf.sort_values(["size", "rid"], ascending=[False, True])
    targets, room = list(pdf["targets"].iloc[0]), list(pdf["room"].iloc[0])
    dealt = []
    for size in pdf["size"]:
        k = next((k for k, r in enumerate(room) if r >= size), None)
        k = max(range(len(room)), key=room.__getitem__) if k is None else k
        room[k] -= size
        dealt.append(targets[k])
    return pd.DataFrame({"rid": pdf["rid"].to_numpy(), "shard": dealt})


class Dealing:
    """Where each row goes: whole blocks by (old, block), and rid by rid the rows of divided blocks, of which there are fewer than old and new shards together."""

    def __init__(self, blocks_of, dealt: DataFrame, which: DataFrame, small: bool):
        self.blocks_of, self.dealt, self.which, self.small = blocks_of, dealt, which, small

    def place(self, rows: DataFrame) -> DataFrame:
        """rows (rid, old and others) with block and shard; where blocks are few no row is shuffled."""
        whole = self.dealt.select("old", "block", F.col("targets")[0].alias("_whole"))
        rows = rows.withColumn("block", F.pmod(F.xxhash64("rid"), self.blocks_of[F.col("old")]).cast("int"))
        rows = rows.join(F.broadcast(whole) if self.small else whole, ["old", "block"]).join(F.broadcast(self.which), "rid", "left")
        return rows.withColumn("shard", F.coalesce("_shard", "_whole").cast("int")).drop("_shard", "_whole")


def deal(rows: DataFrame, shards: int, block_rows: int = BLOCK_ROWS, broadcast_blocks: int = 500_000) -> Dealing | None:
    """Deals rows (rid, old, size) to shards; None for an empty table."""
    spark = rows.sparkSession
    old = {r["old"]: (r["bytes"], r["n"]) for r in rows.groupBy("old").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}  # one row per old shard
    if not old:
        return None
    total = sum(b for b, _ in old.values())
    flows = min_cost_flow({i: b for i, (b, _) in sorted(old.items())}, equal_capacities(total, shards))
    cuts = []  # what each flow takes of its old shard's bytes; what stays comes first
    for i in sorted(old):
        at = 0
        for j, units in sorted(((j, u) for (k, j), u in flows.items() if k == i), key=lambda x: (x[0] != i, x[0])):
            cuts.append((i, j, at, at + units))
            at += units
    cut = spark.createDataFrame(cuts, "old int, target int, lo long, hi long")  # fewer rows than old and new shards together
    blocks_of = F.create_map(*[F.lit(x) for i, (_, n) in old.items() for x in (i, -(-n // block_rows))])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rid"), blocks_of[F.col("old")]).cast("int"))
    blocks = rows.groupBy("old", "block").agg(F.sum("size").alias("bytes"))
    blocks = blocks.withColumn("hi_b", F.sum("bytes").over(Window.partitionBy("old").orderBy("block"))).withColumn("lo_b", F.col("hi_b") - F.col("bytes"))
    shared = blocks.join(F.broadcast(cut), "old").where((F.col("lo") < F.col("hi_b")) & (F.col("lo_b") < F.col("hi")))
    room = F.least("hi", "hi_b") - F.greatest("lo", "lo_b")
    dealt = shared.groupBy("old", "block").agg(F.array_sort(F.collect_list(F.struct("lo", "target", room.alias("room")))).alias("f"))
    dealt = materialise(dealt.select("old", "block", F.col("f.target").alias("targets"), F.col("f.room").alias("room")), "blocks")
    small = dealt.count() <= broadcast_blocks
    divided = dealt.where(F.size("targets") > 1)  # blocks with a cut: fewer than old and new shards together
    which = rows.join(F.broadcast(divided), ["old", "block"]).groupBy("old", "block").applyInPandas(_divide, "rid long, shard int")
    return Dealing(blocks_of, dealt, materialise(which.withColumnRenamed("shard", "_shard"), "divided"), small)


def plan(rows: DataFrame, shards: int, block_rows: int = BLOCK_ROWS, broadcast_blocks: int = 500_000) -> DataFrame:
    """shard (int) and slot (long, gapless from 0 in each shard) for each row of rows: rid (unique long), old (int), size (long, at least 1).

    Sizes of the new shards come out equal up to the rows' grain. rows must be
    written already, so that rids stay as they are. An empty table gives no rows.
    """
    dealing = deal(rows, shards, block_rows, broadcast_blocks)
    if dealing is None:
        return rows.select("rid", "old", "size", F.lit(0).alias("block"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    placed = materialise(dealing.place(rows).select("rid", "old", "size", "block", "shard"), "placed")
    starts = placed.groupBy("shard", "old", "block").agg(F.count("*").alias("n"))
    starts = starts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("old", "block")) - F.col("n")).drop("n")
    placed = placed.withColumn("at", F.row_number().over(Window.partitionBy("shard", "old", "block").orderBy("rid")))
    placed = placed.join(F.broadcast(starts) if dealing.small else starts, ["shard", "old", "block"])
    return placed.select("rid", "old", "size", "block", "shard", (F.col("before") + F.col("at") - 1).alias("slot"))


def size_of(text: str = "text"):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def reshard(docs: DataFrame, old, shards: int, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keep columns, size, text_crc32, law, old_shard, shard, slot and grown_shard of each row of docs (law bytes, so grown_shard is null).

    old: column with the old shard of a row; null means shard 0. Null texts
    are texts of no bytes: size 1, checksum 0. Repeated rows are placed one by one; equal
    texts may part, since a group of them may outgrow a shard and bytes could then not be
    equal. An empty table gives no rows. The texts themselves are not moved here.
    """
    narrow = docs.select(*keep, F.monotonically_increasing_id().alias("rid"), F.coalesce(old, F.lit(0)).cast("int").alias("old"), size_of().alias("size"), _checksum().alias("text_crc32"))
    narrow = materialise(narrow, "sizes")
    placed = plan(narrow.select("rid", "old", "size"), shards)
    out = narrow.drop("old", "size").join(placed, "rid")
    return out.select(*keep, "size", "text_crc32", F.lit("bytes").alias("law"), F.col("old").alias("old_shard"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def _manifest(root: str, version: int) -> str:
    return f"{root}/v{version}/_manifest"


def _exists(path: str, spark: SparkSession) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def _commit(root: str, version: int, held: dict[int, int], spark: SparkSession) -> None:
    """held: for each shard with rows, the version whose folder holds its files."""
    spark.createDataFrame(sorted(held.items()), "shard int, version int").coalesce(1).write.json(_manifest(root, version))


def held_in(root: str, version: int, spark: SparkSession) -> dict[int, int]:
    """For each shard the version that holds its files: as the manifest says, or all in this version where there is none (a first layout by other means)."""
    if _exists(_manifest(root, version), spark):
        return {r["shard"]: r["version"] for r in spark.read.schema("shard int, version int").json(_manifest(root, version)).collect()}  # one row per shard
    return {int(r["shard"]): version for r in spark.read.parquet(f"{root}/v{version}").select("shard").distinct().collect()}


def stored(root: str, version: int, spark: SparkSession) -> DataFrame | None:
    """All rows of a version, from every shard its manifest names: their columns, shard, and _file and _row (where they stand). None where no shard has rows."""
    held = held_in(root, version, spark)
    parts = []
    for v in sorted(set(held.values())):
        part = spark.read.option("basePath", f"{root}/v{v}").parquet(*[f"{root}/v{v}/shard={s}" for s in sorted(held) if held[s] == v])
        columns = [part[c] for c in part.columns if c != "shard"]
        parts.append(part.select(*columns, F.col("shard").cast("int").alias("shard"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")))
    return reduce(DataFrame.unionByName, parts) if parts else None


def _with_rid(rows: DataFrame) -> DataFrame:
    """rows of stored() with a unique long rid in place of _file and _row: the file's number above 40 bits of the row's place in it."""
    files = rows.select("shard", "_file").distinct()
    per_shard = files.groupBy("shard").agg(F.count("*").alias("n"))
    lift = per_shard.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("_lift"))  # one row per shard
    files = files.withColumn("_i", F.row_number().over(Window.partitionBy("shard").orderBy("_file"))).join(lift, "shard").select("_file", (F.col("_lift") + F.col("_i")).alias("_number"))
    numbered = rows.join(if_small(materialise(files, "files"), BROADCAST_FILES), "_file")
    return numbered.withColumn("rid", F.shiftleft(F.col("_number").cast("long"), 40) + F.col("_row")).drop("_file", "_row", "_number")


def _checksum(text: str = "text"):
    """CRC-32 of the text in UTF-8; that of no bytes for a null one."""
    return F.crc32(F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary")))


def lay_out(docs: DataFrame, old, root: str) -> None:
    """Writes docs as version 0 of root, by the shard that old gives (null means 0)."""
    without(docs, "shard", "_file", "_row").withColumn("shard", F.coalesce(old, F.lit(0)).cast("int")).write.partitionBy("shard").parquet(f"{root}/v0")
    spark = docs.sparkSession
    shards = spark.read.parquet(f"{root}/v0").select("shard").distinct().collect() if docs.limit(1).count() else []
    _commit(root, 0, {int(r["shard"]): 0 for r in shards}, spark)


def rewrite(root: str, version: int, shards: int, spark: SparkSession) -> DataFrame:
    """Reshards version `version` of the table of Parquet folders root/v<n>/shard=<n> into version + 1.

    Only shards that gain or lose rows are written anew; the new version's
    manifest, written last, names the older version that holds each of the
    others. Gives one row per new shard: shard, path of its files, rows, bytes,
    rewritten. Rows are told apart by file and place, so repeated ones are
    safe. Texts go from old files to new ones without a shuffle.
    """
    held, before = held_in(root, version, spark), stored(root, version, spark)
    report = "shard int, path string, rows long, bytes long, rewritten boolean"
    if before is None:
        _commit(root, version + 1, {}, spark)
        return spark.createDataFrame([], report)
    columns = [c for c in before.columns if c not in ("shard", "_file", "_row")]
    before = _with_rid(before.select(F.struct(*columns).alias("_of"), "shard", "_file", "_row"))
    rows = materialise(before.select("rid", F.col("shard").alias("old"), size_of("_of.text").alias("size")), "sizes")
    dealing = deal(rows, shards)
    flows = dealing.place(rows).groupBy("old", "shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).collect()  # at most one row per flow
    touched = sorted({x for r in flows if r["old"] != r["shard"] for x in (r["old"], r["shard"])})
    if touched:
        moving = before.where(F.col("shard").isin(touched)).select("_of", "rid", F.col("shard").alias("old"))
        dealing.place(moving).select("_of.*", "shard").write.partitionBy("shard").parquet(f"{root}/v{version + 1}")
    now = {s: version + 1 if s in touched else held[s] for s in {r["shard"] for r in flows}}
    _commit(root, version + 1, now, spark)
    total = lambda s, c: sum(r[c] for r in flows if r["shard"] == s)
    return spark.createDataFrame([(s, f"{root}/v{v}/shard={s}", total(s, "rows"), total(s, "bytes"), s in touched) for s, v in sorted(now.items())], report)


def resharded(docs: DataFrame, old, shards: int, root: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """reshard() carried out: docs are laid out under root by old shard and rewritten, and what is returned is read back from the new version's files; slot is a row's place among those of its shard.

    old: column over docs' own columns, which are all moved with the text. A
    column of docs by the name of one that is added, or of shard, gives way. Nulls, repeated rows and empty tables as in reshard().
    """
    lay_out(docs, old, root)
    rewrite(root, 0, shards, docs.sparkSession)
    after = stored(root, 1, docs.sparkSession)
    facts = [size_of().alias("size"), _checksum().alias("text_crc32"), F.lit("bytes").alias("law"), F.coalesce(old, F.lit(0)).cast("int").alias("old_shard")]
    if after is None:
        return docs.limit(0).select(*keep, *facts, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    read = materialise(after.select(*keep, *facts, "shard", "_file", "_row"), "read-back")
    files = read.groupBy("shard", "_file").agg(F.count("*").alias("n"))
    files = files.select("shard", "_file", (F.sum("n").over(Window.partitionBy("shard").orderBy("_file")) - F.col("n")).alias("_before"))
    out = read.join(if_small(materialise(files, "files"), BROADCAST_FILES), ["shard", "_file"])
    return out.select(*keep, "size", "text_crc32", "law", "old_shard", "shard", (F.col("_before") + F.col("_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
