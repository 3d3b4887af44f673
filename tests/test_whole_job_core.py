"""Core queries as registered: whether they do the whole job."""

import duckdb
import pytest

from engrama import oracle, queries
from engrama.operators.knn import search

SF = "/root/testdata/sf0.01"


def by_sql(name):
    con, sql = duckdb.connect(), oracle.oracle_sql()[name]
    for t in ("documents", "embeddings", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return sorted(con.execute(sql).fetchall())


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall_of_the_registered_index(spark, size):
    sf = f"/root/testdata/{size}"
    mem = queries.memories(spark, sf).cache()
    rows = queries.lsh_neighbours(spark, sf).collect()
    near = {(r["q_id"], r["id"]) for r in rows}
    true = {(r["q_id"], r["id"]) for r in search(mem.selectExpr("id AS q_id", "embedding"), mem, 3).collect()}
    assert len(near) == len(rows) and len(near & true) >= 0.9 * len(true)


def test_listing_holds_whole_texts(spark):
    got = sorted(map(tuple, queries.recall_listing(spark, SF).collect()))
    assert got == by_sql("recall_listing")
    assert max(len(x) for _, x in got) > 1000


@pytest.mark.parametrize("name", ["keyword_fallback", "bm25_topk"])
def test_every_turn_asks(spark, name):
    got = sorted(map(tuple, getattr(queries, name)(spark, SF).collect()))
    want = by_sql(name)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=2e-6)
    assert len({r[0] for r in got}) == 8
