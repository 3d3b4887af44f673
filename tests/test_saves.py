"""Saves as a set against saves one by one."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from engrama.operators import knn
from engrama.plans import saves
from engrama.plans.replay import replay
from engrama.plans.store import MemoryStore

T0 = datetime(2024, 1, 1)
SCHEMA = "store_id string, _pos long, text string, embedding array<double>, at timestamp"


def one_by_one(writes, floor=0.535):
    """What a store holds after its writes, each of which sees those before it."""
    out = []
    for store in sorted({w[0] for w in writes}):
        rows, current = [], {}
        for _, _, text, vector, at in sorted((w for w in writes if w[0] == store), key=lambda w: w[1]):
            text = (text or "").strip()
            if not text:
                continue
            if text in current:
                rows[current[text]]["confirmed"] = at
                continue
            row = {"text": text, "v": vector, "confirmed": at, "closed": None, "by": None, "old": None, "rev": 1}
            cue = any(c in text.lower() for c in ("moved", "now "))
            if cue and vector is not None:
                unit = np.array(vector) / np.linalg.norm(vector)
                near = [(float(np.array(rows[i]["v"]) @ unit / np.linalg.norm(rows[i]["v"])), -i) for i in current.values() if rows[i]["v"] is not None]
                if near and max(near)[0] >= floor:
                    i = -max(near)[1]
                    rows[i]["closed"], rows[i]["by"], row["old"], row["rev"] = at, len(rows), i, rows[i]["rev"] + 1
                    del current[rows[i]["text"]]
            current[text] = len(rows)
            rows.append(row)
        name = lambda i: None if i is None else f"{store}:{i + 1}"
        out += [(store, name(i), r["text"], r["closed"], r["confirmed"], name(r["old"]), name(r["by"]), r["rev"]) for i, r in enumerate(rows)]
    return sorted(out, key=repr)


def made(df):
    return sorted(((r["store_id"], r["id"], r["text"], r["valid_to"], r["last_confirmed"], r["supersedes"], r["superseded_by"], r["revision"]) for r in df.collect()), key=repr)


def said(store, n, rng, topics=8, texts=6, cues=0.2):
    """Saves about a few topics, in vectors and words; some repeat, some announce a change."""
    centres = np.random.default_rng(1).normal(size=(topics, 12))
    rows = []
    for i in range(n):
        topic = rng.randrange(topics)
        text = f"topic {topic} text {rng.randrange(texts)}"
        if rng.random() < cues:
            text = f"I moved to {text}" if rng.random() < 0.5 else f"now {text}"
        vector = (centres[topic] + 0.2 * np.random.default_rng(sum(map(ord, text))).normal(size=12)).tolist() if rng.random() < 0.9 else None
        rows.append((store, i, text if rng.random() > 0.02 else "  ", vector, T0 + timedelta(minutes=i)))
    return rows


@pytest.mark.parametrize("block", [2048, 7])
def test_many_stores(spark, monkeypatch, block):
    monkeypatch.setattr(knn, "BLOCK", block)
    monkeypatch.setattr(saves, "BUCKET", 16)
    rng = random.Random(block)
    writes = [w for s in "abcdef" for w in said(s, 60, rng)] + [("one", 0, "alone", None, T0), ("none", 0, " ", None, T0), ("none", 1, None, None, T0)]
    # a text's vector is its own, as from an embedder
    first = {}
    writes = [(s, p, t, first.setdefault((t or "").strip(), v), at) for s, p, t, v, at in writes]
    assert made(replay(spark.createDataFrame(writes, SCHEMA))) == one_by_one(writes)


def test_one_store_of_many_turns_takes_many_tasks(spark):
    """5,000 turns of one store: equal to the fold, in many components."""
    rng = random.Random(9)
    centres = np.random.default_rng(2).normal(size=(400, 16))
    writes = []
    for i in range(5000):
        topic = rng.randrange(400)
        text = f"I moved to place {topic} {rng.randrange(3)}" if rng.random() < 0.1 else f"place {topic} {rng.randrange(3)}"
        writes.append(("s", i, text, (centres[topic] + 0.1 * np.random.default_rng(sum(map(ord, text))).normal(size=16)).tolist(), T0 + timedelta(minutes=i)))
    df = spark.createDataFrame(writes, SCHEMA)
    assert made(replay(df, 0.9)) == one_by_one(writes, 0.9)
    tied = saves.links(saves.prepared(df).checkpoint(), 0.9)
    assert tied.select("b").distinct().count() > 1000


def test_a_text_of_a_third_of_all_saves_is_folded_as_few(spark):
    writes = [("s", i, "same" if i % 3 == 0 else f"I moved to {i % 50}", [1.0, 0.1 * (i % 5)], T0 + timedelta(minutes=i)) for i in range(600)] + [("s", 1000 + i, "same", [1.0, 0.0], T0 + timedelta(days=9, minutes=i)) for i in range(2000)]
    assert made(replay(spark.createDataFrame(writes, SCHEMA))) == one_by_one(writes)


def test_save_set_equals_single_saves(spark, tmp_path):
    rng = random.Random(4)
    rows = said("s", 40, rng, topics=3)
    vectors = {}
    for _, _, t, v, _ in rows:
        vectors.setdefault(t.strip(), v)
    one, many = (MemoryStore(spark, str(tmp_path / n), lambda texts: [vectors.get(t) for t in texts]) for n in "om")
    at = lambda i: (T0 + timedelta(minutes=i)).replace(tzinfo=timezone.utc)
    for _, i, t, _, _ in rows:
        one.save(t, at(i))
    for lo, hi in ((0, 15), (15, 40)):  # the second meets memories that are there
        many.save_set(spark.createDataFrame([(i, t, T0 + timedelta(minutes=i)) for _, i, t, _, _ in rows[lo:hi]], "_pos long, text string, at timestamp"))
    fields = "id", "text", "valid_from", "valid_to", "last_confirmed", "supersedes", "superseded_by", "revision", "_pos", "created"
    told = lambda s: [tuple(r[f] for f in fields) for r in s.read().orderBy("_pos").collect()]
    assert told(many) == told(one)
    assert many.store.version() == 2  # one entry per set


def test_numbered(spark, monkeypatch):
    monkeypatch.setattr(saves, "BUCKET", 5)
    rows = spark.createDataFrame([(s, i * 3) for s in "ab" for i in range(40)], "store_id string, seq long")
    assert sorted((r["store_id"], r["seq"], r["number"]) for r in saves.numbered(rows).collect()) == [(s, i * 3, i + 1) for s in "ab" for i in range(40)]


def test_nothing(spark):
    assert replay(spark.createDataFrame([], SCHEMA)).count() == 0
    assert replay(spark.createDataFrame([("s", 0, " \n", None, T0)], SCHEMA)).count() == 0
    assert replay(spark.createDataFrame([("s", 0, "x", [0.0, 0.0], T0), ("s", 1, "now y", [0.0, 0.0], T0)], SCHEMA).withColumn("extra", F.lit(1))).count() == 2
