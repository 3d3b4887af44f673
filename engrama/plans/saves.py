"""Many saves at once, in one store or many, as if made one by one.

Two saves can only affect one another if they say the very same, or if one announces a change and the other is at least
`floor` similar to it. Such saves (and memories that were there before) are linked, and only inside a connected
component does their order matter; so components are folded in parallel, and everything else is a row of its own at once. (A store of
at most BUCKET saves is folded as a whole, which takes one shuffle and gives the same.)
Links come from blocks of vectors that meet in tasks, each of which hands on no more links than connect its rows.
Repeats of a text with nothing of their component in between are folded as one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engrama.functions.text import has_cue, is_constraint, trim
from engrama.operators import knn
from engrama.operators.graph import components
from engrama.operators.temporal import FLOOR

#: Places that are numbered in one group, and saves of a store that is folded as a whole.
BUCKET = 4_096
FOLDED = "store_id string, seq long, made boolean, confirmed timestamp, closed timestamp, closed_by long, closes long, revision int"


def prepared(writes: DataFrame) -> DataFrame:
    """Writes (store_id, _pos, text, embedding, at) that are not empty: trimmed, with cue and rule, and seq, their order."""
    out = writes.select("store_id", F.col("_pos").cast("long").alias("seq"), trim(F.col("text")).alias("text"), F.col("embedding").cast("array<double>").alias("embedding"), "at")
    return out.where("text <> ''").withColumns({"cue": has_cue(F.col("text")), "rule": is_constraint(F.col("text")), "there": F.lit(False), "revision": F.lit(1)})


def links(nodes: DataFrame, floor: float) -> DataFrame:
    """(store_id, a, b): seqs of nodes that are linked, enough of them to connect all that are."""
    node = F.struct("store_id", "seq")
    same = nodes.groupBy("store_id", "text").agg(F.min("seq").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = nodes.join(same, ["store_id", "text"]).where("seq <> a").select("store_id", "a", F.col("seq").alias("b"))
    # a text's vector is met once, as its other saves are linked already
    firsts = nodes.where(F.col("embedding").isNotNull()).groupBy("store_id", "text").agg(F.min_by(F.struct("seq", "embedding", "cue"), "seq").alias("f"), F.max("seq").alias("last")).select("store_id", "f.*", "last")
    asking = firsts.where("cue")
    count = lambda df, n: df.groupBy("store_id").agg(F.ceil(F.count("*") / knn.BLOCK).cast("int").alias(n))
    sizes = count(asking, "n_q").join(count(firsts, "n_m"), "store_id")
    block = lambda n: F.pmod(F.xxhash64(node), F.col(n)).cast("int")
    left = asking.join(sizes, "store_id").select("store_id", "seq", "last", "embedding", F.lit(True).alias("asks"), block("n_q").alias("q"), F.explode(F.sequence(F.lit(0), F.col("n_m") - 1)).alias("m"))
    right = firsts.join(sizes, "store_id").select("store_id", "seq", "last", "embedding", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("n_q") - 1)).alias("q"), block("n_m").alias("m"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy(bool)
        q, m = pdf[asks], pdf[~asks]
        out = []
        if len(q) and len(m):
            near = knn._matrix(q["embedding"]) @ knn._matrix(m["embedding"]).T >= floor
            near &= q["last"].to_numpy()[:, None] > m["seq"].to_numpy()[None, :]
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while root.get(x, x) != x:
                    root[x] = x = root.get(root[x], root[x])
                return x

            qs, ms = q["seq"].to_numpy(), m["seq"].to_numpy()
            for i, j in zip(*np.nonzero(near), strict=True):
                a, b = find(int(ms[j])), find(int(qs[i]))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((int(ms[j]), int(qs[i])))
        return pd.DataFrame({"store_id": pd.Series([pdf["store_id"].iloc[0]] * len(out), dtype=pdf["store_id"].dtype if pdf["store_id"].dtype.kind == "i" else object), "a": np.array([x for x, _ in out], np.int64), "b": np.array([x for _, x in out], np.int64)})

    near = left.unionByName(right).groupBy("store_id", "q", "m").applyInPandas(meet, f"store_id {nodes.schema['store_id'].dataType.simpleString()}, a long, b long")
    return same.unionByName(near.where("a <> b"))


def _fold(pdf: pd.DataFrame, floor: float) -> pd.DataFrame:
    """The saves of one component in order: one row per memory that was made or changed."""
    rows: dict[int, dict] = {}
    current: dict[str, int] = {}  # text -> seq
    units: dict[int, np.ndarray] = {}
    pdf = pdf.sort_values("seq")
    store = pdf["store_id"].iloc[0]
    for w in pdf.itertuples(index=False):
        if not w.there and w.text in current:
            rows[current[w.text]]["confirmed"] = w.until
            continue
        row = rows[w.seq] = {"store_id": store, "seq": w.seq, "made": not w.there, "confirmed": pd.NaT if w.there else w.at, "closed": pd.NaT, "closed_by": None, "closes": None, "revision": w.revision}
        v = None if w.embedding is None else np.asarray(w.embedding, float)
        unit = v / n if v is not None and (n := np.sqrt(v @ v)) > 0 else v
        if not w.there and w.cue and unit is not None:
            near = [(float(units[i] @ unit), -i) for i in current.values() if i in units]
            if near and max(near)[0] >= floor:
                old = rows[-max(near)[1]]
                old["closed"], old["closed_by"] = w.at, w.seq
                row["closes"], row["revision"] = old["seq"], old["revision"] + 1
                current = {t: i for t, i in current.items() if i != old["seq"]}
        if not w.there:
            row["confirmed"] = w.until
        if not (w.there and w.text in current):  # of memories that say the same the first is confirmed
            current[w.text] = w.seq
        elif unit is not None:
            current[f"\0{w.seq}"] = w.seq
        if w.there and not pd.isna(w.until):  # a save said the same next
            rows[current[w.text]]["confirmed"] = w.until
        if unit is not None:
            units[w.seq] = unit
    out = pd.DataFrame(list(rows.values()))
    return out.astype({"closed_by": "Int64", "closes": "Int64"} | ({} if out["store_id"].dtype.kind == "i" else {"store_id": object}))


def resolve(nodes: DataFrame, floor: float) -> DataFrame:
    """FOLDED: for each store what its saves made of nodes (store_id, seq, text, embedding, at, cue, rule, there, revision): one row per memory made, and per memory that was there and is confirmed or closed. nodes with there are current memories, of lower seq than any save."""
    nodes = nodes.checkpoint()
    kind = nodes.schema["store_id"].dataType.simpleString()
    schema = FOLDED.replace("store_id string", f"store_id {kind}")
    counted = nodes.join(nodes.groupBy("store_id").agg(F.count("*").alias("_n")), "store_id").checkpoint()
    few = counted.where(F.col("_n") <= BUCKET).select("store_id", "seq", "text", "embedding", "at", "cue", "there", "revision", F.col("at").alias("until"))
    whole = few.groupBy("store_id").applyInPandas(lambda pdf: _fold(pdf, floor), schema).where("made OR confirmed IS NOT NULL OR closed IS NOT NULL")
    many = counted.where(F.col("_n") > BUCKET).select(*nodes.columns)
    return whole if many.isEmpty() else whole.unionByName(_by_components(many, floor, schema))


def _by_components(nodes: DataFrame, floor: float, schema: str) -> DataFrame:
    """resolve() of stores of any size."""
    tied = links(nodes, floor).checkpoint()
    name = lambda c: F.concat_ws("\t", "store_id", F.lpad(F.col(c).cast("string"), 20, "0"))
    pairs = tied.select(name("a").alias("a"), name("b").alias("b"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    groups = components(ends, pairs)
    named = nodes.withColumn("_n", name("seq"))
    joined = named.join(groups.select(F.col("id").alias("_n"), "component"), "_n")
    # repeats with nothing of their component in between are one, confirmed at the last
    order = Window.partitionBy("component").orderBy("seq")
    again = F.coalesce((F.lag("text").over(order) == F.col("text")) & ~F.col("there"), F.lit(False))
    runs = joined.withColumn("_run", F.sum(F.when(again, 0).otherwise(1)).over(order))
    first = lambda c: F.min_by(c, "seq").alias(c)
    merged = runs.groupBy("component", "_run").agg(*map(first, ("store_id", "text", "embedding", "at", "cue", "there", "revision")), F.min("seq").alias("seq"), F.max_by("at", "seq").alias("until"))
    folded = merged.groupBy("component").applyInPandas(lambda pdf: _fold(pdf.drop(columns=["component", "_run"]), floor), schema)
    alone = named.where("NOT there").join(groups.select(F.col("id").alias("_n")), "_n", "left_anti")
    none = lambda t: F.lit(None).cast(t)
    single = alone.select("store_id", "seq", F.lit(True).alias("made"), F.col("at").alias("confirmed"), none("timestamp").alias("closed"), none("long").alias("closed_by"), none("long").alias("closes"), F.lit(1).alias("revision"))
    return folded.unionByName(single)


def numbered(rows: DataFrame, key: str = "store_id", by: str = "seq") -> DataFrame:
    """rows with number, from 1 by `by` within each key. Buckets of places are numbered by themselves and lifted by the rows before them, so no task sorts a whole key."""
    rows = rows.withColumn("_b", F.floor(F.col(by) / BUCKET))
    before = rows.groupBy(key, "_b").agg(F.count("*").alias("_n")).withColumn("_lift", F.sum("_n").over(Window.partitionBy(key).orderBy("_b")) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy(key, "_b").orderBy(by))
    return rows.withColumn("_i", inside).join(before, [key, "_b"]).withColumn("number", (F.col("_lift") + F.col("_i")).cast("long")).drop("_b", "_i", "_lift")
