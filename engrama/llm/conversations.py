"""Conversation structure repair by a dynamic programme over retained turns.

A repaired conversation is empty, or one system turn at most and then user and assistant in turns.
The programme chooses which turns stay, as they are or reroled. Between two that stay all others are deleted, which prefix
sums of deletions price, and what must be inserted follows from the two roles alone; so for each role
the cheapest turn to come from, less the deletions before it, is one running minimum. Equal costs
go by the audit, the string of edits: two audits of one cost up to one turn are never one the beginning of the
other, so the lesser stays the lesser whatever follows.

No conversation has to fit a task. Turns are reduced to rows without text, ranged by conversation and turn, and every
segment of at most SEGMENT rows is summed up for each role that it may follow; a conversation's segments are then
folded in order. Texts are moved once, beside the edits of their segment, and streamed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrama.llm.shared import materialise, without

#: What edits cost.
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: Rows without text of which one segment consists at most.
SEGMENT = 1024
ROLES = {"u": "user", "a": "assistant"}
#: Initials of the turn that stays before ("" for none) and after, and how many turns must be inserted between them.
BETWEEN = {("", "s"): 0, ("", "u"): 0, ("", "a"): 1, ("s", "u"): 0, ("s", "a"): 1, ("u", "u"): 1, ("u", "a"): 0, ("a", "u"): 0, ("a", "a"): 1}
#: What must follow the last turn that stays.
AFTER = {"": 0, "s": 2, "u": 1, "a": 0}
STATES = ("", "s", "u", "a")
LEGAL = ("su", "ua", "au")

BLANK = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
COUNTS = ("blank", "duplicate", "truncated", "illegal")

Turn = tuple[str, bool, bool, int]  # initial, whether it must go, whether it is cut off, and how often it stands there
Way = tuple[int, str]  # cost, audit


def ways(turns: list[Turn], before: str) -> dict[str, Way]:
    """The cheapest edits of turns for each last role that can stand after them, if the last one before them is `before`."""
    gone = place = 0
    least: dict[str, tuple[int, str, int]] = {before: (0, "", 0)}  # cost less the deletions so far, audit, place that it ends at
    for initial, forced, cut, times in turns:
        if not forced:
            got = []
            for role in "sua":
                if role == initial:
                    letter, own = "K", CUT * cut
                elif role != "s":
                    letter, own = "R", REROLE + CUT * cut
                else:
                    continue
                costs = {r: v + gone + own + INSERT * BETWEEN[r, role] for r, (v, _, _) in least.items() if (r, role) in BETWEEN}
                if costs:
                    cost = min(costs.values())
                    audit = min(least[r][1] + "D" * (place - least[r][2]) + "I" * BETWEEN[r, role] + letter for r, c in costs.items() if c == cost)
                    got.append((role, cost - gone - DELETE, audit))
            for role, value, audit in got:
                old = least.get(role)
                if old is None or value < old[0] or value == old[0] and audit < old[1] + "D" * (place + 1 - old[2]):
                    least[role] = (value, audit, place + 1)
        gone += DELETE * times
        place += times
    return {r: (v + gone, audit + "D" * (place - at)) for r, (v, audit, at) in least.items()}


def ended(found: dict[str, Way]) -> tuple[str, Way]:
    """The role to end with, and the cost and audit of the whole."""
    whole = {r: (cost + INSERT * AFTER[r], audit + "I" * AFTER[r]) for r, (cost, audit) in found.items()}
    last = min(whole, key=lambda r: whole[r])
    return last, whole[last]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of rows, with what is said (a digest of conversation, role and text)."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    said = F.md5(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.octet_length(role).cast("string"), role, text))
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), said.alias("said"), text.alias("text"))


KEYS = "conv_id long, turn long, role string, said string"
SUMS = f"{KEYS}, blank long, duplicate long, truncated long, illegal long, first string, last string, least long, most long, turns long, last_turn long, has_last boolean, costs array<long>, audits array<string>"
EDITS = f"{KEYS}, edits string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in ddl.split(", "))])


def _summed(batches: Iterator[pa.RecordBatch], segment: int) -> Iterator[pa.RecordBatch]:
    """Segments of rows that come in order: keys of the first row, counts, ends, and the ways through it."""
    def close(rows: list[tuple], opens: bool) -> tuple:
        turns, blanks, copies, cuts, illegal, before = [], 0, 0, 0, 0, None
        for _, _, role, _, blank, cut, again, times in rows:
            initial = role[:1]
            blanks += times * blank
            copies += (not blank) * (times - (not again))
            cuts += (not blank and not again) and cut
            illegal += (before is not None and before + initial not in LEGAL) + (times - 1) * (initial * 2 not in LEGAL)
            before = initial
            turns.append((initial, blank or again, cut, times))
        found = [ways(turns, s) if s == "" or not opens else {} for s in STATES]
        known = [r[1] for r in rows if r[1] is not None]
        costs = [of[t][0] if t in of else None for of in found for t in STATES]
        audits = [of[t][1] if t in of else None for of in found for t in STATES]
        return (*rows[0][:4], blanks, copies, cuts, illegal, rows[0][2][:1], before, min(known, default=None), max(known, default=None), len(set(known)), rows[-1][1], rows[-1][1] is not None, costs, audits)

    def segments() -> Iterator[tuple]:
        held: list[tuple] = []
        opens, first = False, True  # whether the conversation is known to begin with held
        for row in _rows(batches):
            if held and row[0] != held[-1][0]:
                yield close(held, opens)
                held, opens, first = [], True, False
            elif len(held) == segment:
                yield close(held, opens)
                held, opens = [], False
            elif first and not held:
                opens = False
            held.append(row)
        if held:
            yield close(held, opens)

    yield from _batches(segments(), _arrow(SUMS), 64)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a conversation's segments in order: the edits of each, and one row with the counts, the cost and the audit of all."""
    def close(parts: list[tuple], best: dict[str, tuple[int, str, tuple]], sums: list[int], illegal: int, least, most, turns: int) -> Iterator[tuple]:
        last, (cost, audit) = ended({r: (c, a) for r, (c, a, _) in best.items()})
        path = []
        at = best[last][2]
        while at:
            at, edits = at
            path.append(edits)
        for i, (keys, edits) in enumerate(zip(parts, reversed(path), strict=True)):
            yield (*keys, edits + "I" * AFTER[last] * (i + 1 == len(parts)), *[None] * 7)
        gaps = most - least + 1 - turns if least is not None else 0
        yield (parts[0][0], None, None, None, None, gaps, *sums, illegal, cost, audit)

    def rows() -> Iterator[tuple]:
        parts: list[tuple] = []
        for r in _rows(batches):
            keys, sums, illegal, (first, last), (least, most, turns), (last_turn, has_last), costs, audits = r[:4], r[4:7], r[7], r[8:10], r[10:13], r[13:15], r[15], r[16]
            if parts and parts[0][0] != keys[0]:
                yield from close(parts, *state)
                parts = []
            if not parts:
                best, total, wrong, low, high, n, before, turn_before = {"": (0, "", ())}, [0, 0, 0], 0, None, None, 0, None, None
            parts.append(keys)
            new: dict[str, tuple[int, str, tuple]] = {}
            for s, (cost, audit, path) in best.items():
                for j, t in enumerate(STATES):
                    c = costs[4 * STATES.index(s) + j]
                    if c is not None:
                        more = audits[4 * STATES.index(s) + j]
                        if t not in new or cost + c < new[t][0] or cost + c == new[t][0] and audit + more < new[t][1]:
                            new[t] = (cost + c, audit + more, (path, more))
            best, total = new, [a + b for a, b in zip(total, sums, strict=True)]
            wrong += illegal + (before is not None and before + first not in LEGAL)
            n += turns - (turn_before is not None and turn_before == keys[1])
            low = least if low is None else low if least is None else min(low, least)
            high = most if high is None else high if most is None else max(high, most)
            before, turn_before = last, last_turn if has_last else None
            state = best, total, wrong, low, high, n
        if parts:
            yield from close(parts, *state)

    yield from _batches(rows(), _arrow(EDITS), 256)


def edits(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """From turns (conv_id, turn, role, text): for each segment the keys of its first row and its edits, and for each conversation a row with a null turn key and gaps, blank, duplicate, truncated, illegal, cost and audit.

    Written to the shared folder, as both kinds are read by others.
    """
    plain = _turns(turns)
    slim = plain.select(*plain.columns[:4], (~F.col("text").rlike(BLANK)).alias("blank"), (~F.col("text").rlike(ENDED)).alias("cut"))
    rows = slim.groupBy(*slim.columns).agg(F.count("*").alias("times"))
    # a first saying is the earliest turn that says it, so only (digest, turn) is joined; a digest covers its conversation
    first = rows.groupBy("said").agg(F.min(F.struct("turn")).alias("_first"))
    rows = rows.join(first, "said").select(*slim.columns, (~F.col("turn").eqNullSafe(F.col("_first.turn"))).alias("again"), "times")
    rows = materialise(rows, "turns")
    order = ["conv_id", "turn", "role", "said"]
    sums = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda batches: _summed(batches, segment), SUMS)
    sums = materialise(sums, "segments")
    return materialise(sums.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_folded, EDITS), "edits")


REPAIRED = "conv_id long, place long, edit string, role string, text string"


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns after their edits; a segment's edits come before its rows."""
    def rows() -> Iterator[tuple]:
        conv, edits, at, last, place = None, "", 0, "", 0
        opened = False

        def inserts() -> Iterator[tuple]:
            nonlocal at, last, place
            while at < len(edits) and edits[at] == "I":
                last = "a" if last == "u" else "u"
                yield conv, place, "I", ROLES[last], ""
                place, at = place + 1, at + 1

        for conv_id, _, role, _, of_edits, text in _rows(batches):
            if of_edits is not None:
                yield from inserts()
                if not opened or conv_id != conv:
                    conv, last, place, opened = conv_id, "", 0, True
                edits, at = of_edits, 0
                continue
            yield from inserts()
            edit, at = edits[at], at + 1
            if edit == "D":
                continue
            if edit == "R":
                role = ROLES["a" if last == "u" else "u"]
            last = role[:1]
            yield conv, place, edit, role, text
            place += 1
        yield from inserts()

    yield from _batches(rows(), _arrow(REPAIRED))


def repaired(turns: DataFrame, of: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of each conversation after repair, numbered from 0; partitions hold whole conversations in order. of: edits(turns).

    edit is K (kept), R (reroled) or I (inserted, with empty text). Each task streams its turns and holds the edits of one segment.
    """
    order = ["conv_id", "turn", "role", "said"]
    plain = _turns(turns)
    rows = plain.select(*order, F.lit(None).cast("string").alias("edits"), "text")
    marks = of.where("edits IS NOT NULL").select(*order, "edits", F.lit(None).cast("string").alias("text"))
    both = rows.unionByName(marks).repartition("conv_id").sortWithinPartitions(*order, F.col("edits").isNull())
    return both.mapInArrow(_applied, REPAIRED)


def repair(turns: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """Repaired turns (repaired()), and per conversation (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit).

    Turns go by turn (null first), then role, then a digest of their text; of a turn's faults the first counts: blank, said before in the
    conversation with the same role, not ended by [.!?]. Blank and repeated turns must go. An audit has a
    letter per edit: D delete, I insert, K keep, R rerole; of the cheapest the ASCII-least is taken. Null roles and texts
    are one space, a null conv_id is a conversation; rows that are equal in all repeat each other; an empty table gives two empty ones, and columns beyond the four are not read.
    """
    of = edits(turns, segment)
    return repaired(turns, of), of.where("edits IS NULL").select("conv_id", "gaps", *COUNTS, "cost", "audit")


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired(): role:text of each turn, a line end between. A digest has an order, so each conversation's turns stream through one task, one at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            conv, sha = None, None
            for conv_id, place, _, role, text in _rows(batches):
                if place == 0:
                    if sha:
                        yield conv, sha.hexdigest()
                    conv, sha = conv_id, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            if sha:
                yield conv, sha.hexdigest()

        yield from _batches(rows(), _arrow("conv_id long, repaired_sha256 string"))

    return turns.mapInArrow(run, "conv_id long, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of rows, a quarter of them harmed as the CRC-32 of conv_id:turn says: dropped, emptied, without sentence ends, repeated, or made the user's. Nulls are one space."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("_h")).where("_h <> 0")
    text = F.when(F.col("_h") == 1, "").when(F.col("_h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("_h") == 4, "user").otherwise(F.col("role"))})
    return rows.withColumn("_n", F.explode(F.when(F.col("_h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_n", "_h")


def repaired_digests(conversations: DataFrame, turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per conv_id of conversations with the figures of repair(turns) and the digest of what it gives; zeros, an empty audit and the digest of nothing where no turn is left."""
    fixed, figures = repair(turns, segment)
    ids = without(conversations, "gaps").select("conv_id").distinct()
    hashes = digests(fixed).withColumnRenamed("conv_id", "_c")
    figures = figures.withColumnRenamed("conv_id", "_f")
    out = ids.join(figures, F.col("conv_id").eqNullSafe(F.col("_f")), "left").join(hashes, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("conv_id", *map(zero, ("gaps", *COUNTS, "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
