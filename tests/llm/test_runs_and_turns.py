"""Periodic runs and conversation repair against brute-force versions."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from engrama.llm import conversations, periodic, queries

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute_runs(w):
    out, n = [], len(w)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length, seg = j - i + q, w[i : j + q]
            if length >= max(24, 3 * q) and not any(seg[p:] == seg[:-p] for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def brute_op11(doc_id, text):
    words = planted(doc_id, text)
    found = brute_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    top = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *top, 1000 * top[1] // top[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("dense", [1, 4, 64])
def test_runs_of_random_words(monkeypatch, dense):
    monkeypatch.setattr(periodic, "DENSE", dense)
    rng = random.Random(dense)
    for _ in range(150):
        n, k = rng.randint(0, 600), rng.choice([1, 2, 3, 50, 5000])
        w = [str(rng.randrange(k)) for _ in range(n)]
        for _ in range(rng.randint(0, 4) if n > 30 else 0):
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 3))
            for i in range(a, min(n, a + p * rng.randint(2, 6) + rng.randint(0, p))):
                w[i] = w[a + (i - a) % p]
        assert periodic.runs(w) == brute_runs(w)


def test_long_runs_take_few_lags(monkeypatch):
    """One word a hundred thousand times is one run; its multiples are not even shifted, and a text without repeats shifts dense lags only."""
    seen = []
    real = periodic.matches
    monkeypatch.setattr(periodic, "matches", lambda bits, n, lag, least: seen.append(lag) or real(bits, n, lag, least))
    assert periodic.runs(["a"] * 100_000) == [(0, 100_000, 1)]
    assert periodic.runs([str(i) for i in range(100_000)]) == []
    assert len(seen) == 2 * (periodic.DENSE - 1)


def test_op11(spark, tmp_path):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for sf, rows in (("/root/testdata/sf0.001", rows), (str(tmp_path), [(None, "a " * 40), (1, None), (2, ""), (3, " \n"), (4, "x y z " * 10), (4, "x y z " * 10), *((i, "one two three four five six seven eight nine ten " * 4 + str(i)) for i in range(100, 160))])):
        if sf == str(tmp_path):
            spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
        got = sorted((tuple(r) for r in queries.op11_periodic_runs(spark, sf).collect()), key=repr)
        assert got == sorted((brute_op11(*r) for r in rows), key=repr)
    assert sum(r[1] for r in got) > 60


def test_periodic_runs_replace_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a " * 30, "x", "y", 2)], "doc_id long, text string, runs string, Collapsed string, start int")
    row = periodic.periodic_runs(docs).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 30, 1)] and row["collapsed"] == "a" and row["start"] == 2
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def harmed(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * {0: 0, 3: 2}.get(h, 1)
    return out


def cheapest(turns):
    """By trying all edits, the inserts one at a time; turns: initial, forced, cut. The best of each state after each turn is all that has to be kept."""
    step = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
    least = lambda found, s, c, a: found.__setitem__(s, min(found.get(s, (c, a)), (c, a)))

    def inserted(found):
        for _ in range(3):
            for s, (c, a) in list(found.items()):
                for r in "ua":
                    if (s, r) in step:
                        least(found, r, c + 2, a + "I")
        return found

    found = {"": (0, "")}
    for initial, forced, cut in turns:
        new = {}
        for s, (c, a) in found.items():
            least(new, s, c + 3, a + "D")
        for s, (c, a) in inserted(dict(found)).items():
            if not forced and (s, initial) in step:
                least(new, initial, c + cut, a + "K")
            for r in "ua":
                if not forced and (s, r) in step:
                    least(new, r, c + 2 + cut, a + "R")
        found = new
    found = inserted(found)
    return min(found[s] for s in ("", "a") if s in found)


def brute_op12(rows):
    out = []
    for conv in {r[0] for r in rows}:
        mine = sorted(harmed(r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(":".join([" " if conv is None else str(conv), str(len(r[2].encode())), r[2], r[3]]).encode()).hexdigest()))
        if not mine:
            out.append((conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))
            continue
        known = [r[1] for r in mine if r[1] is not None]
        seen, turns, counts = set(), [], [0, 0, 0]
        for _, _, role, text in mine:
            last = re.findall("[^\x20\x09-\x0D]", text)
            fault = 0 if not last else 1 if (role, text) in seen else 2 if last[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            turns.append((role[:1], fault in (0, 1), fault == 2))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit = cheapest(turns)
        left, fixed = list(mine), []
        for e in audit:
            need = "assistant" if fixed and fixed[-1][0][:1] == "u" else "user"
            if e == "I":
                fixed.append((need, ""))
                continue
            _, _, role, text = left.pop(0)
            if e != "D":
                fixed.append((role if e == "K" else need, text))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in fixed)) and not left
        out.append((conv, max(known) - min(known) + 1 - len(set(known)) if known else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()))
    return sorted(out, key=repr)


ODD = [
    (None, 1, "user", "Hi."), (None, 2, "assistant", "Yes."), (1, None, "user", None), (1, 1, None, "x."), (1, 1, None, "x."), (1, 3, "", "y!"), (2, 5, "user", "Same."), (2, 5, "user", "Same."), (2, 9, "user", "Same."),
    (3, 0, "system", "s."), (3, 1, "system", "t."), (3, 2, "assistant", "cut"), (3, 3, "tool", "out."), (4, 7, "user", " \n"), (5, None, "assistant", "a?"), (5, None, "user", "b?  \n"),
]


@pytest.mark.parametrize("segment", [1, 3, 1024])
def test_repair(spark, segment):
    rng = random.Random(7)
    long = [(9, i, rng.choice(["user", "user", "assistant", "system"]), rng.choice(["Yes.", "No", "", f"word {i}.", f"cut {i}"])) for i in range(400)]
    for rows in (ODD + long, [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]):
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        got = sorted((tuple(r) for r in conversations.repaired_digests(df, conversations.damaged(df), segment).collect()), key=repr)
        assert got == brute_op12(rows)


def test_repaired_turns_are_a_conversation(spark):
    rows = [(1, 0, "system", "Be kind.", 5), (1, 1, "assistant", "Hello.", 5), (1, 2, "user", "Hi.", 5), (1, 3, "user", "Hi.", 5), (1, 4, "user", "Who?", 5)]
    turns, figures = conversations.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int"))
    cost, audit = cheapest([("s", False, False), ("a", False, False), ("u", False, False), ("u", True, False), ("u", False, False)])
    assert (figures.first()["cost"], figures.first()["audit"]) == (cost, audit)
    assert re.fullmatch("s(ua)+", "".join(r["role"][:1] for r in turns.orderBy("place").collect()))
    assert [r["edit"] for r in turns.orderBy("place").collect()] == [e for e in audit if e != "D"]


def test_repair_of_nothing(spark):
    turns, figures = conversations.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert turns.count() == figures.count() == 0
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repaired_digests(empty, conversations.damaged(empty)).count() == 0


def test_repair_by_sql():
    """The registered SQL against the brute-force version, null keys and repeated rows included."""
    import duckdb

    from engrama.llm.oracle import oracle_sql

    rng = random.Random(8)
    rows = ODD + [(9, i, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", "", f"word {i}."])) for i in range(60)]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.execute(oracle_sql()["op12_conversation_repair"]).fetchall(), key=repr) == brute_op12(rows)
