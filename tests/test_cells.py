"""Neighbours by cells against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from engrama.operators import cells, graph, knn


def clustered(spark, n=1200, centres=12, width=16, seed=1, spread=0.15):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, width))
    v = c[rng.integers(centres, size=n)] + spread * rng.normal(size=(n, width))
    v[5] = v[6] = v[7] = v[n // 3]  # ties
    v[11] = 0
    rows = [(str(i), i, v[i].tolist() if i != 12 else None, i % 9 == 0) for i in range(n)]
    return spark.createDataFrame(rows, "id string, _pos long, embedding array<double>, is_constraint boolean")


def rows(df, *names):
    return sorted((*[r[c] for c in names], round(r["sim"], 9)) for r in df.collect())


@pytest.mark.parametrize("gate", [0.6, 0.95])
def test_edges_by_cells_are_the_same(spark, gate, monkeypatch):
    mem = clustered(spark)
    index = cells.fit(mem)
    assert len(index.centres) > 8
    exact = graph.edges(mem, 3, gate)
    assert rows(graph.edges(mem, 3, gate, index=index), "src", "dst", "rnk") == rows(exact, "src", "dst", "rnk")
    monkeypatch.setattr(knn, "BLOCK", 16)  # cells are dealt out in blocks
    assert rows(graph.edges(mem, 3, gate, True, index=index), "src", "dst", "rnk") == rows(graph.edges(mem, 3, gate, True), "src", "dst", "rnk")


def test_constraint_rescue_by_cells_is_the_same(spark):
    mem = clustered(spark)
    seeds = mem.where("_pos % 50 = 1").select(F.lit("q").alias("q_id"), "id")
    want = graph.constraint_rescue(mem, seeds, 0.5, 2, 10)
    assert want.count() > 0
    assert rows(graph.constraint_rescue(mem, seeds, 0.5, 2, 10, index=cells.fit(mem)), "q_id", "rnk", "id", "via") == rows(want, "q_id", "rnk", "id", "via")


def test_cells_are_pruned(spark):
    """On clustered vectors under a quarter of all pairs is compared; the bound is what makes the rest unnecessary."""
    mem = clustered(spark, 2000, 30)
    asks = mem.select(F.col("id").alias("q_id"), "embedding")
    r = cells.compared(asks, mem, 0.8, cells.fit(mem)).first()
    assert 0 < r["compared"] < r["pairs"] / 4


def test_a_vector_of_a_third_of_all_rows(spark):
    """Copies are asked once and held k + 1 times; each still finds the first others by place."""
    mem = clustered(spark, 600).withColumn("embedding", F.when(F.col("_pos") % 3 == 0, F.array(*[F.lit(float(i == 0)) for i in range(16)])).otherwise(F.col("embedding")))
    index = cells.fit(mem)
    assert rows(graph.edges(mem, 3, 0.6, index=index), "src", "dst", "rnk") == rows(graph.edges(mem, 3, 0.6), "src", "dst", "rnk")
    asks = mem.select(F.col("id").alias("q_id"), "embedding")
    kept = cells.search(asks, mem, 3, 0.6, index)
    assert kept.where("q_id = '300'").orderBy("rnk").select("id").collect() == [("0",), ("3",), ("6",)]


def test_probes_reach_their_target(spark):
    mem = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").cast("string").alias("id"), F.col("vec_id").alias("_pos"), F.col("embedding").cast("array<double>").alias("embedding"))
    index = cells.fit(mem)
    probes = cells.fit_probes(mem, index, 3)
    asks = mem.select(F.col("id").alias("q_id"), "embedding")
    true, found = knn.search(asks, mem, 3).select("q_id", "id"), cells.search(asks, mem, 3, cells=index, probes=probes).select("q_id", "id")
    assert true.intersect(found).count() >= 0.9 * true.count()


def test_nothing_to_find(spark):
    mem = clustered(spark, 30)
    none = mem.where("false")
    assert cells.search(none.select(F.col("id").alias("q_id"), "embedding"), mem, 2, 0.5).count() == 0
    assert cells.search(mem.select(F.col("id").alias("q_id"), "embedding"), none, 2, 0.5).count() == 0
    zero = mem.where("_pos IN (11, 12)")
    assert cells.search(zero.select(F.col("id").alias("q_id"), "embedding"), zero, 2, 0.5).count() == 0
    with pytest.raises(ValueError):
        graph.edges(mem.withColumn("s", F.lit(1)), 2, 0.5, within="s", index=cells.fit(mem))


def test_copies_of_a_query_do_not_grow_with_the_cells(spark):
    """Where nothing can be left out a query went to each of the cells; it goes to 12 groups of them."""
    rng = np.random.default_rng(2)
    mem = spark.createDataFrame([(str(i), i, rng.normal(size=16).tolist()) for i in range(900)], "id string, _pos long, embedding array<double>")
    index = cells.fit(mem, 40)
    asks = mem.select(F.col("id").alias("q_id"), "embedding")
    assert cells.visits(asks, index, 0.1, None).count() > 30 * 900
    assert cells._visiting(asks, index, 0.1, None, cells.grouped(index)).count() <= knn.SIDE * 900
    assert rows(graph.edges(mem, 3, 0.1, index=index), "src", "dst", "rnk") == rows(graph.edges(mem, 3, 0.1), "src", "dst", "rnk")
