"""The four verbs of one store, over listed files and append-only logs."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrama.functions.text import has_cue, is_constraint, is_historical
from engrama.functions.text import trim as trim_column
from engrama.operators import ledger, temporal
from engrama.operators.recall import RETURNED, in_scope, keyword_recall, listing
from engrama.plans import recall_plan
from engrama.schema import MEMORY
from engrama.sources.embedding import Embed, embedding
from engrama.sources.snapshots import ATTEMPTS, Conflict, Snapshots

ACCESS, RECALLS, STATE = "id string, at timestamp", "t long, r string, id string, role string", "a string, b string, w double, e long"
#: Log entries after which accesses are folded into the memories, and recalls into the ledger's state.
FOLD = 128


class MemoryStore:
    """save, recall, edit and remove. embed turns texts into vectors; without it, or when it fails, memories have none and recall goes by words.

    Recalls only append, each a log entry of its own: accesses, and what came up together. Both are folded once there
    are FOLD of them, accesses into the memories, recalls into a state of the ledger. The store's entry names the log
    entries that it has folded in, so one that lands meanwhile is neither lost nor counted twice. Every other
    change is made anew from what is there by then where another writer came first.
    """

    def __init__(self, spark: SparkSession, root: str, embed: Embed | None = None, floor: float = temporal.FLOOR, options: recall_plan.Options = recall_plan.Options()):
        self.spark, self.store, self.embed, self.floor, self.options = spark, Snapshots(spark, root), embed, floor, options

    def _vectors(self, texts: list[str]) -> list[list[float] | None]:
        try:
            return self.embed(texts) if self.embed else [None] * len(texts)
        except Exception:  # an embedder's outage never costs a memory
            return [None] * len(texts)

    def _logged(self, name: str, folded: list[str]) -> list[str]:
        gone = set(folded)
        return [n for n in self.store.names(name) if n not in gone]

    def _log(self, name: str, entries: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.store.root}/{name}/{n}" for n in entries]) if entries else self.spark.createDataFrame([], schema)

    def _add(self, name: str, rows: list[tuple], schema: str, entry: str) -> None:
        """One log entry; it is written aside and then moved, so that it is there whole or not at all."""
        aside = f"{name}/_{entry}"
        self.spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{self.store.root}/{aside}")
        self.store._fs.rename(self.store._path(aside), self.store._path(f"{name}/{entry}"))

    def _again(self, change: Callable[[int], object]) -> object:
        """change(version), made anew from the version that is there by then where another writer came first."""
        for attempt in range(ATTEMPTS):
            try:
                return change(self.store.version())
            except Conflict:
                if attempt + 1 == ATTEMPTS:
                    raise
        raise Conflict("unreachable")

    def accesses(self) -> DataFrame:
        """(id, n, last) of accesses that are not folded in yet."""
        return temporal.access_counts(self._log("access", self._logged("access", self.store.entry().get("folded", [])), ACCESS))

    def read(self, version: int | None = None) -> DataFrame:
        entry = self.store.entry(version)
        return temporal.fold_access(self.store._rows(entry), temporal.access_counts(self._log("access", self._logged("access", entry.get("folded", [])), ACCESS)))

    def consolidate(self, drop_removed: bool = False) -> None:
        """Writes the counts of all accesses so far into the memories; log entries that an earlier entry has folded in are deleted."""
        def change(version: int) -> None:
            entry = self.store.entry(version)
            before, names = entry.get("folded", []), self._logged("access", entry.get("folded", []))
            mem = temporal.fold_access(self.store._rows(entry), temporal.access_counts(self._log("access", names, ACCESS)))
            self.store.commit(temporal.vacuum(mem) if drop_removed else mem, version, folded=names)
            for n in before:
                self.store.delete(f"access/{n}")

        self._again(change)

    def _ledger(self, entry: dict) -> tuple[DataFrame, int, list[str]]:
        """The ledger's state after all recalls so far, their number, and the log entries that it was brought up with: the last state and the tail alone are read."""
        held = entry.get("ledger") or {"path": None, "recalls": 0, "folded": []}
        state = self.spark.read.schema(STATE).parquet(f"{self.store.root}/{held['path']}") if held["path"] else None
        names = self._logged("recalls", held["folded"])
        return ledger.fold_state(ledger.bumps(self._log("recalls", names, RECALLS), "r"), state), held["recalls"] + len(names), names

    def ledger(self) -> DataFrame:
        """(a, b, w) after all recalls so far."""
        state, recalls, _ = self._ledger(self.store.entry())
        return ledger.as_of(state, F.lit(recalls)).drop("e")

    def fold_ledger(self) -> None:
        """Writes the ledger's state, without the pairs that have faded, in place of the recalls that led to it."""
        def change(version: int) -> None:
            entry = self.store.entry(version)
            state, recalls, names = self._ledger(entry)
            path, epoch = f"ledger/{uuid.uuid4().hex}", F.floor(F.lit(recalls) / ledger.EPOCH)
            ledger.as_of(state, F.lit(recalls)).select("a", "b", "w", epoch.cast("long").alias("e")).coalesce(1).write.parquet(f"{self.store.root}/{path}")
            self.store.note(version, ledger={"path": path, "recalls": recalls, "folded": names})
            for n in (entry.get("ledger") or {"folded": []})["folded"]:
                self.store.delete(f"recalls/{n}")

        self._again(change)

    def _one(self, text: str) -> tuple[str, bool, bool, bool]:
        row = self.spark.createDataFrame([(text,)], "t string").select(trim_column(F.col("t")).alias("t"), has_cue(F.col("t")).alias("c"), is_constraint(F.col("t")).alias("k"), is_historical(F.col("t")).alias("h")).first()
        return row["t"], row["c"], row["k"], row["h"]

    def save(self, content: str, now: datetime | None = None) -> str | None:
        """The id that now holds the content; None for an empty one.

        A current memory with the very text is confirmed; a correction closes what it corrects, both in one
        entry. Anything else is appended. Only files that hold a changed memory are written again.
        """
        now = now or datetime.now(timezone.utc)
        text, cue, rule, _ = self._one(content or "")
        if not text:
            return None
        at, vector = F.lit(now), self._vectors([text])[0]

        def change(version: int) -> str:
            entry = self.store.entry(version)
            mem = self.store._rows(entry)
            same = mem.where(~F.col("deleted") & F.col("valid_to").isNull() & (F.col("text") == text)).orderBy("_pos").limit(1).collect()
            if same:
                found = same[0]["id"]
                self.store.patch([found], lambda rows: rows.withColumn("last_confirmed", F.when(F.col("id") == found, at).otherwise(F.col("last_confirmed"))), expected=version)
                return found
            new_id = str(max(int(now.timestamp() * 1000), entry["top"] + 1))
            row = (new_id, now, now, text, vector, 0.0, 0, None, now, None, now, None, None, 1, False, "user_stated", rule, False)
            new = self.spark.createDataFrame([row], MEMORY).withColumn("_pos", F.lit(entry["place"] + 1).cast("long"))
            got = temporal.supersession_targets(new, in_scope(mem, False), self.floor).collect() if cue and vector else []  # one row at most
            if got:
                old = got[0]["id"]
                targets = self.spark.createDataFrame([(new_id, old, 1.0)], "q_id string, id string, sim double")
                revision = mem.where(F.col("id") == old).select("revision").first()["revision"]
                opened = new.withColumns({"supersedes": F.lit(old), "revision": F.lit(revision + 1)})
                self.store.patch([old], lambda rows: temporal.supersede(rows, targets, at), opened.select(*new.columns), version)
            else:
                self.store.append(new.coalesce(1), version)
            return new_id

        out = self._again(change)
        self.store.compact()
        return out

    def save_all(self, contents: list[str]) -> list[str | None]:
        """Saves in order; each sees those before it."""
        return [self.save(c) for c in contents]

    def save_set(self, texts: DataFrame) -> None:
        """Saves texts (_pos, text, at) as one by one in the order of _pos, in one entry."""
        from engrama.plans.replay import saved

        vectors = embedding(self.embed, trim_column(F.col("text"))) if self.embed else F.lit(None).cast("array<double>")
        writes = texts.withColumn("embedding", vectors)

        def change(version: int) -> None:
            entry = self.store.entry(version)
            new, changed = saved(self.store._rows(entry), writes, entry["top"], entry["place"], self.floor)
            new, changed = new.checkpoint(), changed.checkpoint()
            if new.isEmpty() and changed.isEmpty():
                return
            span = changed.agg(F.min("id"), F.max("id")).first()
            ids = [r["id"] for r in changed.select("id").limit(FOLD + 1).collect()]
            if len(ids) > FOLD:  # too many to look up file by file: all files within their range
                files = [f for f in entry["files"] if f[2] is not None and f[2] <= span[1] and f[3] >= span[0]]
                ids = [f[2] for f in files]
            self.store.patch(ids, lambda rows: temporal.patch(rows, changed), new.select(*MEMORY.names, "_pos"), version)

        self._again(change)

    def recall(self, query: str, k: int = RETURNED, now: datetime | None = None) -> str:
        """The k best memories as text, with related ones below if the field is on. Counts the accesses, embeds what had no vector, and notes what came up together.

        Nothing that is only noted on the way makes a recall fail: where another writer keeps coming first, vectors are filled in by a later one.
        """
        now = now or datetime.now(timezone.utc)
        text, _, _, historical = self._one(query or "")
        if not text:
            return "Nothing to recall."
        entry = self.store.entry()
        mem = self.read()
        scope = in_scope(mem, historical)
        if scope.isEmpty():
            return "Nothing is current." if not mem.where(~F.col("deleted")).isEmpty() else "Nothing is stored."
        vector, got, field = self._vectors([text])[0], None, False
        if vector is None:
            primary = keyword_recall(self.spark.createDataFrame([("q", text)], "q_id string, text string"), scope, k)
        else:
            bare = scope.where(F.col("embedding").isNull()).select("id", "text")
            if not bare.isEmpty():  # old rows, or an outage when they were saved
                fresh = bare.select("id", embedding(self.embed, F.col("text")).alias("embedding")).checkpoint()
                ids = [r["id"] for r in fresh.select("id").collect()] if fresh.count() <= FOLD else [f[2] for f in entry["files"]]
                try:
                    self.store.patch(ids, lambda rows: temporal.backfill(rows, fresh))
                except Conflict:
                    pass
                mem = temporal.backfill(mem, fresh)
                scope = in_scope(mem, historical)
            asked = self.spark.createDataFrame([("q", vector, historical)], "q_id string, embedding array<double>, historical boolean")
            field = self.options.field and scope.count() > k
            got = recall_plan.run(asked, mem, replace(self.options, returned=k, field=field), self.ledger() if field else None)
            primary = got.primary
        shown = primary.select("q_id", "rnk", "id", F.lit("primary").alias("role"))
        if field:
            shown = shown.unionByName(got.related.select("q_id", "rnk", "id", F.lit("related").alias("role")))
        rows = shown.collect()  # a listing's rows
        again = self.spark.createDataFrame([tuple(r) for r in rows], "q_id string, rnk int, id string, role string")
        row = listing(again.where("role = 'primary'"), mem, again.where("role = 'related'"), k).first()
        self._note(rows, now, field)
        return row["listing"] if row else "Nothing is current."

    def _note(self, rows: list, now: datetime, field: bool) -> None:
        name = uuid.uuid4().hex
        self._add("access", [(r["id"], now) for r in rows if r["role"] == "primary"], ACCESS, name)
        entry = self.store.entry()
        if field:
            held = entry.get("ledger") or {"recalls": 0, "folded": []}
            t = held["recalls"] + len(self._logged("recalls", held["folded"])) + 1
            self._add("recalls", [(t, name, r["id"], r["role"]) for r in rows], RECALLS, name)
            if t - held["recalls"] >= FOLD:
                self.fold_ledger()
        if len(self._logged("access", entry.get("folded", []))) >= FOLD:
            self.consolidate()

    def edit(self, id_: str, content: str, now: datetime | None = None) -> bool:
        text, *_ = self._one(content or "")
        at, hit = F.lit(now or datetime.now(timezone.utc)), F.col("id") == id_
        if not text or self.store.read().where(hit).isEmpty():
            return False
        vector = F.lit(self._vectors([text])[0]).cast("array<double>")
        put = {"text": F.lit(text), "embedding": vector, "modified": at, "last_confirmed": at}
        self.store.patch([id_], lambda rows: rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in put.items()}))
        return True

    def remove(self, id_: str, now: datetime | None = None) -> bool:
        at, hit = F.lit(now or datetime.now(timezone.utc)), F.col("id") == id_
        if self.store.read().where(hit).isEmpty():
            return False
        self.store.patch([id_], lambda rows: rows.withColumns({"deleted": F.col("deleted") | hit, "modified": F.when(hit, at).otherwise(F.col("modified"))}))
        return True

    def vacuum(self) -> int:
        """Drops removed rows for good; gives the rows kept."""
        if not self.store.read().where("deleted").isEmpty():
            self.consolidate(drop_removed=True)
        return self.store.read().count()
