"""The association graph: gated nearest-neighbour edges and what is read off them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engrama.functions.vector import bonus, pair
from engrama.operators import cells
from engrama.operators.knn import neighbours, search


def _top(df: DataFrame, by: list[str], order: list, k: int, name: str = "rnk") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def _nearest(queries: DataFrame, memories: DataFrame, k: int, gate: float, within: str | None, index: cells.Cells | None) -> DataFrame:
    if index is None:
        return search(queries, memories, k, gate=gate, within=within)
    if within is not None or gate <= 0:
        raise ValueError("an index holds one store, and prunes by a gate above 0")
    return cells.search(queries, memories, k, gate, index)


def edges(memories: DataFrame, k: int = 3, min_sim: float = 0.55, mutual: bool = False, ledger: DataFrame | None = None, within: str | None = None, index: cells.Cells | None = None) -> DataFrame:
    """(src, dst, sim, rnk): each memory's k best neighbours at or above min_sim; mutual keeps an edge only if its reverse is one too.

    ledger (a, b, w) adds a bounded bonus before the gate, so a learned edge
    may pass it. Only pairs in the ledger can gain, so the k plain best and the
    ledger's pairs are all that need ranking; pairs of other ids are dropped before vectors are joined. within: as for search().
    index: cells of these memories (cells.fit()), by which the same edges are found without all pairs; min_sim must be above 0.
    """
    stores = [within] if within else []
    mem = memories.where(F.col("embedding").isNotNull()).select("id", "_pos", "embedding", *stores)
    near = neighbours(mem, k, min_sim) if within is None and index is None else _nearest(mem.withColumnRenamed("id", "q_id").drop("_pos"), mem, k, min_sim, within, index)
    base = near.select(F.col("q_id").alias("src"), F.col("id").alias("dst"), "sim")
    if ledger is not None:
        from engrama.functions.vector import cosine

        side = lambda name, v: mem.select(F.col("id").alias(name), F.col("embedding").alias(v))
        known = ledger.where("a <> b AND w > 0").join(mem.select(F.col("id").alias("a")), "a", "left_semi").join(mem.select(F.col("id").alias("b")), "b", "left_semi")
        once = known.join(side("a", "va"), "a").join(side("b", "vb"), "b").select("a", "b", (cosine(F.col("va"), F.col("vb")) + bonus(F.col("w"))).alias("sim"))
        learned = once.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e"), "sim").select("e.*", "sim")
        base = base.join(learned.select("src", "dst"), ["src", "dst"], "left_anti").unionByName(learned.where(F.col("sim") >= min_sim))
    place = mem.select(F.col("id").alias("dst"), "_pos")
    out = _top(base.join(place, "dst"), ["src"], [F.desc("sim"), "_pos"], k).select("src", "dst", "sim", "rnk")
    if mutual:
        out = out.join(out.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi")
    return out


def neighbourhood(edges_: DataFrame, seeds: DataFrame, hops: int = 1, cap: int = 5) -> DataFrame:
    """(q_id, rnk, id, sim, via, hop) around each query's seeds (q_id, id, rnk), seeds left out.

    What several seeds reach keeps the discovery that comes first: by seed,
    then by edge. After the last hop the most similar come first, cap of them.
    """
    seen = seeds.select("q_id", "id")
    front = seeds.select("q_id", F.col("id").alias("via"), F.array(F.col("rnk").cast("long")).alias("path"))
    found = None
    for hop in range(1, hops + 1):
        step = front.join(edges_.select(F.col("src").alias("via"), F.col("dst").alias("id"), "sim", F.col("rnk").cast("long").alias("e")), "via")
        step = step.withColumn("path", F.concat("path", F.array("e"))).join(seen, ["q_id", "id"], "left_anti")
        step = _top(step, ["q_id", "id"], ["path"], 1).select("q_id", "id", "sim", "via", "path", F.lit(hop).alias("hop"))
        found = step if found is None else found.unionByName(step)
        seen = seen.unionByName(step.select("q_id", "id"))
        front = step.select("q_id", F.col("id").alias("via"), "path")
    return _top(found, ["q_id"], [F.desc("sim"), "hop", "path"], cap).select("q_id", "rnk", "id", "sim", "via", "hop")


def constraint_rescue(memories: DataFrame, seeds: DataFrame, gate: float = 0.55, k: int = 2, cap: int = 4, exclude: DataFrame | None = None, within: str | None = None, index: cells.Cells | None = None) -> DataFrame:
    """(q_id, rnk, id, sim, via): constraints one of whose k best neighbours (of all memories, at or above gate) is a seed of the query.

    seeds: q_id, id. exclude (q_id, id): rows that the query already returns. index: as for edges().
    """
    rules = memories.where(F.col("is_constraint") & F.col("embedding").isNotNull())
    near = _nearest(rules.select(F.col("id").alias("q_id"), "embedding", *([within] if within else [])), memories, k, gate, within, index)
    near = near.select(F.col("q_id").alias("id"), F.col("id").alias("via"), "sim", F.col("rnk").alias("n"))
    hit = near.join(seeds.select("q_id", F.col("id").alias("via")), "via")
    if exclude is not None:
        hit = hit.join(exclude.select("q_id", "id"), ["q_id", "id"], "left_anti")
    best = _top(hit, ["q_id", "id"], ["n"], 1).drop("rnk").join(memories.select("id", "_pos"), "id")
    return _top(best, ["q_id"], [F.desc("sim"), "_pos"], cap).select("q_id", "rnk", "id", "sim", "via")


def merge_related(constraints: DataFrame, related: DataFrame, returned: DataFrame) -> DataFrame:
    """(q_id, rnk, id, kind): constraints first, then neighbours; an id keeps its first place, and what is returned already is left out."""
    rows = constraints.select("q_id", "id", F.lit(0).alias("prio"), "rnk").unionByName(related.select("q_id", "id", F.lit(1).alias("prio"), "rnk"))
    rows = _top(rows.join(returned.select("q_id", "id"), ["q_id", "id"], "left_anti"), ["q_id", "id"], ["prio", "rnk"], 1, "first")
    kind = F.when(F.col("prio") == 0, "constraint").otherwise("related")
    return rows.withColumn("rnk", F.row_number().over(Window.partitionBy("q_id").orderBy("prio", "rnk"))).select("q_id", "rnk", "id", kind.alias("kind"))


def undirected(edges_: DataFrame) -> DataFrame:
    """(a, b, sim), each pair once, ends in the order of strings."""
    a, b = pair(F.col("src"), F.col("dst"))
    return edges_.select(a.alias("a"), b.alias("b"), "sim").groupBy("a", "b").agg(F.max("sim").alias("sim"))


def graph_view(memories: DataFrame, k: int = 3, min_sim: float = 0.55, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, text, is_constraint, current) and edges (a, b, w, learned): w is the plain similarity to 4 places."""
    live = memories.where(~F.col("deleted") & F.col("embedding").isNotNull())
    nodes = live.select("id", "text", "is_constraint", F.col("valid_to").isNull().alias("current"))
    links = undirected(edges(live, k, min_sim, ledger=ledger))
    if ledger is None:
        return nodes, links.select("a", "b", F.round("sim", 4).alias("w"), F.lit(0.0).alias("learned"))
    from engrama.functions.vector import cosine

    links = links.drop("sim")
    va, vb = live.select(F.col("id").alias("a"), F.col("embedding").alias("va")), live.select(F.col("id").alias("b"), F.col("embedding").alias("vb"))
    links = links.join(va, "a").join(vb, "b").select("a", "b", F.round(cosine(F.col("va"), F.col("vb")), 4).alias("w"))
    return nodes, links.join(ledger.select("a", "b", F.round("w", 4).alias("learned")), ["a", "b"], "left").fillna(0.0, ["learned"])


def weighted_degree(links: DataFrame) -> DataFrame:
    """(id, degree): over both ends of each link (a, b, w), 0.5 and its weight."""
    ends = links.select(F.explode(F.array("a", "b")).alias("id"), (F.lit(0.5) + F.col("w")).alias("part"))
    return ends.groupBy("id").agg(F.sum("part").alias("degree"))


def components(nodes: DataFrame, links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(id, component): the smallest id reachable. Labels jump to their label's label, so rounds grow with the logarithm of a path."""
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")).distinct()
    label = nodes.select(F.col("id").alias("x"), F.col("id").alias("label"))
    both, label = both.checkpoint(), label.checkpoint()
    for _ in range(max_rounds):
        least = both.join(label.select(F.col("x").alias("y"), F.col("label").alias("l")), "y").groupBy("x").agg(F.min("l").alias("l"))
        near = label.join(least, "x", "left").select("x", "label", F.least("label", F.coalesce("l", "label")).alias("new"))
        jump = near.select(F.col("x").alias("new"), F.col("new").alias("far"))
        new = near.join(jump, "new", "left").select("x", F.least("new", F.coalesce("far", "new")).alias("label"), (F.least("new", F.coalesce("far", "new")) != F.col("label")).alias("moved")).checkpoint()
        label = new.select("x", "label")
        if new.where("moved").isEmpty():
            return label.select(F.col("x").alias("id"), F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def reach(edges_: DataFrame, seeds: DataFrame, targets: DataFrame) -> DataFrame:
    """(strategy, q_id, found, noise): targets (ids) reached from seeds over edges forward or both ways, in one hop or two; noise counts the other rows reached. Edges and seeds are written once, as every strategy reads them."""
    edges_, seeds = edges_.checkpoint(), seeds.checkpoint()
    back = edges_.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim", "rnk")
    both = _top(edges_.unionByName(back), ["src", "dst"], [F.desc("sim"), "rnk"], 1, "_one").drop("_one")
    out = None
    for name, links in (("forward", edges_), ("bidirectional", both)):
        for hops in (1, 2):
            got = neighbourhood(links, seeds, hops, cap=1 << 30).select("q_id", "id").join(targets.select("id", F.lit(1).alias("t")), "id", "left")
            row = got.groupBy("q_id").agg(F.count("t").alias("found"), F.count_if(F.col("t").isNull()).alias("noise")).withColumn("strategy", F.lit(f"{name}-{hops}"))
            out = row if out is None else out.unionByName(row)
    return out.select("strategy", "q_id", "found", "noise")
