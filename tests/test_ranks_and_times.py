"""Exact ranks, percentiles, the as-of join, checkpoints, and that every branch of the queries on texts occurs."""

import random
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from engrama import oracle, queries
from engrama.operators import evaluation, knn, lexical, temporal

SF = "/root/testdata/sf0.01"


def by_sql(name, *columns):
    con, sql = duckdb.connect(), oracle.oracle_sql()[name]
    for t in ("documents", "embeddings", "labels", "conversations", "events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()


@pytest.mark.parametrize("few", [32 << 20, 400])
def test_ranks_by_counting(spark, monkeypatch, few):
    monkeypatch.setattr(knn, "FEW_BYTES", few)  # several blocks of queries
    rng = np.random.default_rng(3)
    v = rng.normal(size=(90, 5))
    v[10] = v[11] = v[70]
    rows = [(str(i), i, v[i].tolist() if i % 13 else None) for i in range(90)]
    mem = spark.createDataFrame(rows, "id string, _pos long, embedding array<double>")
    asks = mem.where("_pos IN (1, 2, 3, 70, 26)").select(F.col("id").alias("q_id"), "embedding")
    targets = [("1", "10"), ("1", "11"), ("2", "13"), ("3", "3"), ("70", "11"), ("26", "5"), ("2", "none"), ("2", None)]
    got = {(r["q_id"], r["id"]): r["rank"] for r in knn.ranks_of(asks, mem, spark.createDataFrame(targets, "q_id string, id string")).collect()}

    def rank(q, t):
        if q == t or t in ("none", None) or int(q) % 13 == 0:
            return 0
        unit = lambda i: v[i] / np.linalg.norm(v[i]) if i % 13 else np.zeros(5)
        sims = sorted((-round(float(unit(int(q)) @ unit(i)), 12), i) for i in range(90) if i != int(q))
        return [i for _, i in sims].index(int(t)) + 1

    assert got == {(q, t): rank(q, t) for q, t in targets}


def test_first_memory_that_holds_a_term(spark):
    mem = spark.createDataFrame([("a", 3, "The Sea"), ("b", 1, "a sea of it"), ("c", 2, None), ("d", 0, "x")], "id string, _pos long, text string")
    targets = spark.createDataFrame([("q", "SEA"), ("b", "sea"), ("r", "none"), ("s", None), ("t", "")], "q_id string, term string")
    for size in (1, 2048):
        assert {r["q_id"]: r["id"] for r in lexical.first_holding(targets, mem, size).collect()} == {"q": "b", "b": "a", "r": None, "s": None, "t": "d"}


@pytest.mark.parametrize("bins", [3, 4096])
def test_exact_percentile(spark, bins):
    rng = random.Random(1)
    for values in ([5.0], [1.0, 2.0], [rng.gauss(0, 1e6) for _ in range(501)], [3.5] * 100 + [7.25] * 7 + [None, float("nan")], [1e-300, 1e300, -1e300, 0.0, -0.0], []):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        known = [v for v in values if v is not None and v == v]
        for q in (0.0, 0.5, 0.95, 1.0):
            got = evaluation.exact_percentile(df, "v", q, bins)
            assert got == (pytest.approx(np.percentile(known, 100 * q), rel=1e-12) if known else None)


@pytest.mark.parametrize("span", ["1 day", "400 days"])
def test_as_of_join(spark, span):
    """Ties of time go to the greatest id; a third of all rows may be of one key; null keys and times have no fact."""
    rng, t0 = random.Random(2), datetime(2020, 1, 1)
    key = lambda: rng.choice(["hot", rng.choice("abcd"), None])
    facts = [(key(), t0 + timedelta(hours=rng.randrange(2000)), i) for i in range(300)] + [("hot", None, 999)]
    times = [(key(), t0 + timedelta(hours=rng.randrange(-50, 2050)), i) for i in range(400)] + [("hot", None, 400)] * 2
    got = temporal.as_of_join(spark.createDataFrame(times, "k string, at timestamp, n long"), spark.createDataFrame(facts, "k string, at timestamp, n long"), "k", "at", "at", "n", span)
    want = []
    for k, at, n in times:
        held = [f for f in facts if k is not None and at is not None and f[0] == k and f[1] is not None and f[1] <= at]
        want.append((k, at, n, max(((f[1], f[2]) for f in held), default=(None, None))[1]))
    assert sorted(((r["k"], r["at"], r["n"], r["fact"]["n"] if r["fact"] else None) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_soak_reaches_the_end(spark):
    rows = [(i, "ab", datetime(2024, 1, 1) if i % 3 == 0 else None, i % 5 == 0) for i in range(1234)]
    got = {r["updates"]: tuple(r)[1:] for r in evaluation.soak(spark.createDataFrame(rows, "_pos long, text string, valid_to timestamp, deleted boolean")).collect()}
    assert set(got) == {100, 250, 500, 1000, 1234} and sum(got[1234][:3]) == 1234 and got[1000][3] == 2000


def test_every_branch_occurs():
    """No green query without the rows that make it one."""
    share = lambda rows, value: sum(r == value for r in rows) / len(rows)
    said = by_sql("classifiers", "is_constraint", "is_historical", "has_cue")
    assert all(0.01 <= share([r[i] for r in said], True) < 1 for i in range(3))
    assert all(share(by_sql("initial_tiers", "tier"), (t,)) >= 0.01 for t in ("session", "long_term"))
    assert by_sql("session_expiry", "id")
    tiers = by_sql("write_tiers", "facts", "refusal")
    assert sum(f > 1 for f, _ in tiers) >= 0.01 * len(tiers) and sum(r is not None for _, r in tiers) >= 0.01 * len(tiers)
    assert {a for a, _ in by_sql("reconcile", "action", "needs_review")} >= {"supersede", "store"} and (True,) in by_sql("reconcile", "needs_review")
    assert sum(s >= 0.7 for (s,) in by_sql("subject_overlap", "score")) >= 0.01 * len(by_sql("subject_overlap", "score"))
    assert any("superseded" in r for (r,) in by_sql("scored_outputs", "reasons"))
    assert {c for (c,) in by_sql("golden_diff", "change")} == {"fixed", "regressed"}
    assert {"better", "worse"} <= {m for (m,) in by_sql("ab_table", "mark")}
    assert by_sql("roc_tbr", "broken")[0][0] > 0
    saves = by_sql("replayed_saves", "supersedes", "is_constraint")
    assert any(s for s, _ in saves) and any(c for _, c in saves)
    assert any(r for (r,) in by_sql("target_ranks", "rank"))


def test_whole_rankings(spark):
    rows = queries.geometry(spark, SF).where("part = 'rank'").groupBy("q_id").agg(F.count("*").alias("n"), F.max("rnk").alias("m")).collect()
    assert rows and all(r["n"] == r["m"] == 999 for r in rows)
