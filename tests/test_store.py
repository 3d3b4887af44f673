import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from engrama.operators import evaluation
from engrama.plans import config
from engrama.plans.recall_plan import Options
from engrama.plans.replay import evaluate, replay
from engrama.plans.store import RECALLS, MemoryStore
from engrama.sources import demo, files
from engrama.sources.embedding import from_cache
from engrama.sources.snapshots import Conflict, Snapshots

def as_of():
    return F.lit(datetime(2020, 1, 1))


def test_reading_old_shapes(spark, tmp_path):
    path = tmp_path / "store.jsonl"
    path.write_text("\n".join([
        json.dumps({"id": 1737400000000, "text": "I am vegan", "created": "2024-05-01T00:00:00Z", "importance": "5", "odd": 1}),
        '{"id": 2, "text": "cut', "", json.dumps({"id": "x", "ts": "2024-05-02T00:00:00Z", "text": "b", "embedding": [1, 2.5], "valid_to": "", "superseded_by": 0, "is_constraint": True, "access_count": 3}),
        json.dumps({"id": "x", "text": "again"}), "[1]",
    ]))
    got = files.read_store(spark, str(path), as_of()).orderBy("_pos").collect()
    assert [r["id"] for r in got] == ["1737400000000", "x", "x"]
    a, b, c = got
    assert (a["is_constraint"], a["importance"], a["revision"], a["source"], a["modified"]) == (True, 0.0, 1, "user_stated", a["created"])
    assert (b["embedding"], b["valid_to"], b["superseded_by"], b["is_constraint"], b["access_count"]) == ([1.0, 2.5], None, "0", True, 3)
    assert c["created"] == datetime(2020, 1, 1)
    assert files.lookup(files.read_store(spark, str(path), as_of()), "x").first()["text"] == "b"
    assert {r["id"]: r["text"] for r in files.last_per_id(files.read_store(spark, str(path), as_of())).collect()}["x"] == "again"
    assert files.read_store(spark, str(tmp_path / "none"), as_of()).count() == 0


def test_sidecars(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"counts": {"7": {"n": 2, "last": "2024-01-01T00:00:00Z"}}}))
    assert [tuple(r)[:2] for r in files.read_access(spark, str(tmp_path / "a.json")).collect()] == [("7", 2)]
    (tmp_path / "l.json").write_text(json.dumps({"recalls": 12, "edges": {"1:2": 0.5}}))
    edges, recalls = files.read_ledger(spark, str(tmp_path / "l.json"))
    assert [tuple(r) for r in edges.collect()] == [("1", "2", 0.5)] and recalls.first()[0] == 12
    (tmp_path / "bad.json").write_text("{")
    assert files.read_access(spark, str(tmp_path / "bad.json")).count() == 0
    assert files.read_ledger(spark, str(tmp_path / "none.json"))[1].first()[0] == 0


def test_snapshots_refuse_a_stale_writer(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"))
    assert store.read().count() == 0
    empty = store.read()
    assert store.commit(empty, 0) == 1
    with pytest.raises(RuntimeError):
        store.commit(empty, 0)
    assert store.version() == 1


def test_verbs(spark, tmp_path):
    places = {"I live in Rome": [1.0, 0.0], "I moved to Oslo": [0.9, 0.1], "I like tea": [0.0, 1.0], "where do I live": [1.0, 0.05], "where did I live before": [1.0, 0.05]}
    store = MemoryStore(spark, str(tmp_path / "m"), lambda texts: [places.get(t) for t in texts], options=Options(field=True))
    t0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
    assert store.save("  ") is None
    assert store.recall("x") == "Nothing is stored."
    rome, tea = store.save("I live in Rome", t0), store.save("I like tea", t0 + timedelta(days=1))
    assert store.save("I like tea", t0 + timedelta(days=2)) == tea
    oslo = store.save("I moved to Oslo", t0 + timedelta(days=3))
    mem = {r["id"]: r for r in store.read().collect()}
    assert len(mem) == 3 and mem[rome]["superseded_by"] == oslo and mem[oslo]["supersedes"] == rome and mem[oslo]["revision"] == 2
    assert mem[rome]["valid_to"] == mem[oslo]["valid_from"]
    now = store.recall("where do I live")
    assert "Rome" not in now and now.startswith(f"1. [id {oslo}] I moved to Oslo")
    assert "no longer current — superseded 2024-01-04" in store.recall("where did I live before")
    assert store.recall("tea").startswith(f"1. [id {tea}]")  # no vector: by words
    assert store.edit(tea, "I like mate") and not store.edit("none", "x")
    assert store.remove(tea) and not store.remove("none")
    assert store.vacuum() == 2


def test_two_writers_cannot_both_win(spark, tmp_path):
    """Both start from version 1; the one whose version file comes second fails and nothing of it shows."""
    one, two = Snapshots(spark, str(tmp_path / "s")), Snapshots(spark, str(tmp_path / "s"))
    one.commit(one.read(), 0)
    rows = one.read()
    two.version = lambda: 1  # it looked before the other committed
    one.commit(rows, 1)
    with pytest.raises(RuntimeError):
        two.commit(rows, 1)
    assert one.version() == 2


def test_a_save_appends(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "m"))
    first, second = store.save("I like tea"), store.save("I like mate")
    held = store.store.entry()["files"]
    assert store.store.version() == 2 and len(held) == 2 and held[0] in store.store.entry(1)["files"] and int(second) > int(first)
    assert [r["text"] for r in store.read().orderBy("_pos").collect()] == ["I like tea", "I like mate"]
    assert store.save("I like tea") == first and store.store.version() == 3 and store.read().count() == 2
    assert held[1] in store.store.entry()["files"]  # a confirmation rewrites the one file that holds the memory


def test_an_append_is_never_lost_beside_a_commit(spark, tmp_path):
    """Another save between a writer's read and its commit: the commit fails, and what was saved stays."""
    root = str(tmp_path / "m")
    one, two = MemoryStore(spark, root), MemoryStore(spark, root)
    one.save("fact one")
    version, rows = one.store.version(), one.read()
    two.save("fact two")
    with pytest.raises(Conflict):
        one.store.commit(rows, version)
    assert sorted(r["text"] for r in one.read().collect()) == ["fact one", "fact two"]


def test_two_saves_at_once_take_two_ids(spark, tmp_path):
    """The second writer looked before the first one's entry was there; it is told so, looks again and takes the next id and place."""
    root, t = str(tmp_path / "m"), datetime(2024, 1, 1, tzinfo=timezone.utc)
    one, two = MemoryStore(spark, root), MemoryStore(spark, root)
    one.save("a", t)
    real, put = two.store.append, []

    def late(rows, expected):
        if not put:
            put.append(one.save("b", t))
        return real(rows, expected)

    two.store.append = late
    two.save("c", t)
    rows = one.read().orderBy("_pos").collect()
    assert [r["text"] for r in rows] == ["a", "b", "c"] and len({r["id"] for r in rows}) == len({r["_pos"] for r in rows}) == 3


def test_a_patch_rewrites_the_file_that_holds_its_id(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "m"))
    rows = [(f"{i:04}", None, None, f"t{i}", None, 0.0, 0, None, None, None, None, None, None, 1, False, "x", False, False, i) for i in range(300)]
    schema = "id string, created timestamp, modified timestamp, text string, embedding array<double>, importance double, access_count long, last_access timestamp, valid_from timestamp, valid_to timestamp, last_confirmed timestamp, superseded_by string, supersedes string, revision int, needs_review boolean, source string, is_constraint boolean, deleted boolean, _pos long"
    store.store.commit(spark.createDataFrame(rows, schema).repartitionByRange(30, "id"))
    before = store.store.entry()["files"]
    assert len(before) == 30 and sum(f[1] for f in before) == 300
    assert store.edit("0123", "new") and not store.edit("9999", "x")
    after = store.store.entry()["files"]
    assert len(after) == 30 and len([f for f in after if f not in before]) == 1
    assert store.read().where("id = '0123'").first()["text"] == "new" and store.read().count() == 300
    assert store.store.compact(5) and len(store.store.entry()["files"]) == 1 and store.read().count() == 300
    store.store.expire(1)
    assert store.store.names("versions") == [str(store.store.version())] and store.read().count() == 300


def test_an_access_that_lands_during_a_fold_counts_once(spark, tmp_path):
    root, t = str(tmp_path / "m"), datetime(2024, 1, 1, tzinfo=timezone.utc)
    store, other = (MemoryStore(spark, root, lambda texts: [[1.0, 0.0] for _ in texts]) for _ in range(2))
    store.save("I like tea", t)
    store.recall("tea", now=t)
    real = store.store.commit

    def slow(rows, version, **notes):
        other.recall("tea", now=t)  # after the fold has listed the log
        return real(rows, version, **notes)

    store.store.commit = slow
    store.consolidate()
    assert [r["access_count"] for r in store.store.read().collect()] == [1]
    assert [r["access_count"] for r in store.read().collect()] == [2]
    store.store.commit = real
    store.consolidate()
    store.consolidate()
    assert [r["access_count"] for r in store.store.read().collect()] == [2] and len(store.store.names("access")) == 0


def test_ledger_reads_its_state_and_the_tail_only(spark, tmp_path):
    """Folded in the middle or not, the weights are the same, and what was folded is not read again."""
    places = {"q": at2(0), "a": at2(5), "b": at2(10), "c": at2(40)}
    plain, folded = (MemoryStore(spark, str(tmp_path / n), lambda texts: [places[t] for t in texts], options=Options(field=True, mutual=False)) for n in "pf")
    t = datetime(2024, 1, 1, tzinfo=timezone.utc)
    for store in (plain, folded):
        for x in "abc":
            store.save(x, t)
        store.recall("q", k=2, now=t)
        a, b, c = (r["id"] for r in store.read().orderBy("_pos").collect())
        for i in range(1, 12):
            store._add("recalls", [(i + 1, f"r{i}", a, "primary"), (i + 1, f"r{i}", b, "primary"), (i + 1, f"r{i}", c, "related")], RECALLS, f"r{i:02}")
            if store is folded and i in (3, 9):
                store.fold_ledger()
    weights = lambda s: {(r["a"], r["b"]): round(r["w"], 9) for r in s.ledger().collect()}
    assert weights(plain) == weights(folded) and len(weights(plain)) == 3
    assert folded._ledger(folded.store.entry())[2] == folded._logged("recalls", folded.store.entry()["ledger"]["folded"]) and len(folded._ledger(folded.store.entry())[2]) == 2
    assert len(folded.store.names("recalls")) == 8  # those of the first fold are deleted by the second


def test_recall_counts_accesses_once(spark, tmp_path):
    """Two recalls and edits stay two; a new store object sees the same total."""
    root, t = str(tmp_path / "m"), datetime(2024, 1, 1, tzinfo=timezone.utc)
    store = MemoryStore(spark, root, lambda texts: [[1.0, 0.0] for _ in texts])
    tea = store.save("I like tea", t)
    for n in range(2):
        store.recall("tea", now=t + timedelta(days=n + 1))
    count = lambda s: [(r["access_count"], r["importance"]) for r in s.read().where(F.col("id") == tea).collect()]
    assert count(store) == [(2, 2.0)]
    store.edit(tea, "I like green tea", t)
    store.edit(tea, "I like black tea", t)
    assert count(store) == [(2, 2.0)] and count(MemoryStore(spark, root)) == [(2, 2.0)]
    store.recall("tea", now=t)
    assert count(store) == [(3, 3.0)]
    store.vacuum()
    assert count(store) == [(3, 3.0)]
    assert store.remove(tea, t + timedelta(days=9))
    row = store.read().where(F.col("id") == tea).first()
    assert row["deleted"] and row["modified"] == datetime(2024, 1, 10)


def test_recall_embeds_what_has_no_vector(spark, tmp_path):
    broken = MemoryStore(spark, str(tmp_path / "m"))
    one, two = broken.save("a"), broken.save("b")
    places = {"a": [1.0, 0.0], "b": [0.0, 1.0], "q": [0.1, 1.0]}
    store = MemoryStore(spark, str(tmp_path / "m"), lambda texts: [places[t] for t in texts])
    assert store.recall("q", k=1) == f"1. [id {two}] b"
    assert {r["id"]: r["embedding"] for r in store.read().collect()} == {one: [1.0, 0.0], two: [0.0, 1.0]}
    assert store.recall("q").splitlines() == [f"1. [id {two}] b", f"2. [id {one}] a"]


def test_recall_reinforces(spark, tmp_path):
    """With the field on, what comes up together gains weight; primaries among themselves more than with related ones."""
    places = {"q": at2(0), "a": at2(5), "b": at2(10), "c": at2(40), "d": at2(120)}
    store = MemoryStore(spark, str(tmp_path / "m"), lambda texts: [places[t] for t in texts], options=Options(field=True, mutual=False))
    a, b, c, d = (store.save(x) for x in "abcd")
    assert store.recall("q", k=2).startswith(f"1. [id {a}] a\n2. [id {b}] b\n\nRelated:\n- [id {c}]")
    got = {(r["a"], r["b"]): round(r["w"], 6) for r in store.ledger().collect()}
    assert got == {tuple(sorted((a, b))): 0.1, tuple(sorted((a, c))): 0.02, tuple(sorted((b, c))): 0.02}
    store.recall("q", k=2)
    assert {round(r["w"], 6) for r in store.ledger().collect()} == {0.2, 0.04}
    assert store.recall("q", k=9).count("[id") == 4 and store.ledger().count() == 3  # all returned: nothing to add, nothing learned


def at2(degrees):
    import math

    return [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]


def test_sidecars_go_out_and_in(spark, tmp_path):
    counts = spark.createDataFrame([("7", 2, datetime(2024, 1, 1)), ("8", 1, None)], "id string, n long, last timestamp")
    files.write_access(counts, str(tmp_path / "a"))
    assert sorted(map(tuple, files.read_access(spark, str(tmp_path / "a")).collect())) == sorted(map(tuple, counts.collect()))
    edges = spark.createDataFrame([("1", "2", 0.5)], "a string, b string, w double")
    files.write_ledger(edges, 12, str(tmp_path / "l"))
    got, recalls = files.read_ledger(spark, str(tmp_path / "l"))
    assert [tuple(r) for r in got.collect()] == [("1", "2", 0.5)] and recalls.first()[0] == 12


def test_embedding_cache(spark):
    texts = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "text string")
    cache = spark.createDataFrame([], "hash string, embedding array<double>")
    with pytest.raises(LookupError):
        from_cache(texts, cache)
    got, full = from_cache(texts, cache, lambda x: [[float(ord(t))] for t in x])
    assert sorted((r["text"], r["embedding"]) for r in got.where("text IS NOT NULL").collect()) == [("a", [97.0]), ("a", [97.0]), ("b", [98.0])]
    assert full.count() == 2 and from_cache(texts, full)[0].count() == 4


def test_config_and_demo(spark, tmp_path):
    path = str(tmp_path / "c.json")
    assert not config.field_on(path, {}) and config.field_on(path, {config.VARIABLE: "YES"})
    config.set_field(path, False)
    assert not config.field_on(path, {config.VARIABLE: "1"})
    (tmp_path / "c.json").write_text('{"other": 1, "field": true}')
    assert config.field_on(path, {})
    config.set_field(path, False)
    assert json.loads((tmp_path / "c.json").read_text()) == {"other": 1, "field": False}
    rows = demo.demo(spark, datetime(2024, 1, 1), lambda texts: [[1.0] for _ in texts]).collect()
    assert len(rows) == 24 and rows[0]["id"] == "1000" and all(r["embedding"] == [1.0] for r in rows) and any(r["is_constraint"] for r in rows)


def test_corpus_is_strict(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id": "x-1", "kind": "basic"}\n')
    cases = files.read_corpus(spark, str(tmp_path / "c.jsonl"), "id string, kind string")
    assert [tuple(r) for r in evaluation.with_prefix(cases, "x").collect()] == [("x-1", "basic")] and evaluation.with_prefix(cases, "y").count() == 0
    (tmp_path / "d.jsonl").write_text('{"id": "x-1"\n')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        files.read_corpus(spark, str(tmp_path / "d.jsonl"), "id string, kind string").collect()


def test_replay_equals_single_saves(spark, tmp_path):
    places = {"I live in Rome": [1.0, 0.0], "I moved to Oslo": [0.9, 0.1], "I like tea": [0.0, 1.0], "now it is Turku": [0.95, 0.05]}
    said = ["I live in Rome", "I like tea", " I like tea ", "", "I moved to Oslo", "now it is Turku", "I like tea"]
    t0 = datetime(2024, 1, 1)
    writes = spark.createDataFrame([(s, i, x, places.get(x.strip()), t0 + timedelta(days=i)) for s in ("s", "u") for i, x in enumerate(said)], "store_id string, _pos long, text string, embedding array<double>, at timestamp")
    many = replay(writes).where("store_id = 's'").orderBy("_pos").collect()
    store = MemoryStore(spark, str(tmp_path / "m"), lambda texts: [places[t] for t in texts])
    for i, x in enumerate(said):
        store.save(x, (t0 + timedelta(days=i)).replace(tzinfo=timezone.utc))
    one = store.read().orderBy("_pos").collect()
    number = {r["id"]: f"s:{i}" for i, r in enumerate(one, 1)} | {None: None}
    fields = lambda r, f: (f(r["id"]), r["text"], r["valid_to"], r["last_confirmed"], f(r["supersedes"]), f(r["superseded_by"]), r["revision"])
    assert [fields(r, lambda x: x) for r in many] == [fields(r, number.get) for r in one]


def test_evaluation_runs_each_case_in_its_own_store(spark):
    a = lambda d: at2(d)
    cases = [
        ("rule", "constraint", "roc", None, "dinner", a(0), ["diabetic"], None, None),
        ("plain", "basic", None, None, "capital", a(0), ["Oslo"], ["Rome"], None),
        ("old", "contradictions", None, None, "home", a(0), ["Oslo"], None, True),
    ]
    cases = spark.createDataFrame(cases, "id string, kind string, metric string, field boolean, query string, embedding array<double>, contains array<string>, excludes array<string>, current_only boolean")
    writes = [("rule", i, f"snack {i}", a(i)) for i in range(6)] + [("rule", 9, "I am diabetic", a(52))]
    writes += [("plain", 0, "Oslo is a capital", a(3)), ("old", 0, "I live in Rome", a(1)), ("old", 1, "I moved to Oslo", a(2))]
    writes = spark.createDataFrame([(*w, datetime(2024, 1, 1)) for w in writes], "store_id string, _pos long, text string, embedding array<double>, at timestamp")
    got = {r["key"]: r for r in evaluate(cases, writes).collect()}
    assert {k: r["pass"] for k, r in got.items()} == {"rule [field:off]": False, "rule [field:on]": True, "plain": True, "old": True}
    assert got["rule [field:on]"]["rescued"] and got["rule [field:off]"]["reasons"] == ['missing ["diabetic"]']
    assert {r["key"] for r in evaluate(cases, writes, prefix="ru").collect()} == {"rule [field:off]", "rule [field:on]"}
    assert {r["kind"]: (r["passed"], r["total"]) for r in evaluation.scorecard(spark.createDataFrame(list(got.values()))).collect()}["all"] == (3, 4)
