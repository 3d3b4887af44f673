"""Access counters, sessions and the decaying ledger over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from engrama.operators.ledger import BETA, EPOCH, FLOOR


def access_stream(log: DataFrame) -> DataFrame:
    """(id, n, last) of a stream of accesses (id, at); for update or complete mode."""
    return log.groupBy("id").agg(F.count("*").alias("n"), F.max("at").alias("last"))


def sessions(log: DataFrame, gap: str = "12 seconds", late: str = "1 minute") -> DataFrame:
    """(id, start, end, n) of runs of accesses with no gap as long as `gap`; rows later than `late` are left out."""
    window = F.session_window("at", gap)
    out = log.withWatermark("at", late).groupBy(window.alias("w"), "id").agg(F.count("*").alias("n"))
    return out.select("id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windowed_counts(log: DataFrame, size: str = "5 minutes", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    out = log.withWatermark("at", late).groupBy(F.window("at", size, slide).alias("w")).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "n")


class LedgerProcessor(StatefulProcessor):
    """One edge's weight. The clock is the recall number that rides on each bump, so decay is made up for when an edge is next touched."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("edge", "w double, e long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        w, e = self.state.get() if self.state.exists() else (0.0, 0)
        bumps = pd.concat(list(rows)).sort_values("t")
        for t, alpha in zip(bumps["t"], bumps["alpha"], strict=True):
            now = (int(t) - 1) // EPOCH
            w *= BETA ** (now - e)
            if now > e and w < FLOOR:
                w = 0.0
            w, e = w + float(alpha), now
        self.state.update((w, e))
        yield pd.DataFrame({"a": [key[0]], "b": [key[1]], "w": [w], "e": [e]})

    def close(self) -> None:
        pass


class FadingLedgerProcessor(LedgerProcessor):
    """One edge's weight, dropped when it fades. Recalls are the clock: recall t is second t of event time, and a timer waits at the first recall of the epoch in which the weight falls under the floor."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        out = list(super().handleInputRows(key, rows, timers))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        w, e = self.state.get()
        lasts = next((n for n in range(1, 1 << 12) if w * BETA**n < FLOOR), 1 << 12)
        self.handle.registerTimer(((e + lasts) * EPOCH + 1) * 1000)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, e = self.state.get()
        self.state.clear()
        yield pd.DataFrame({"a": [key[0]], "b": [key[1]], "w": [0.0], "e": [max(int(e), (expiredTimerInfo.getExpiryTimeInMs() // 1000 - 1) // EPOCH)]})


def ledger_stream(bumps: DataFrame, prune: bool = False, late: int = 0) -> DataFrame:
    """(a, b, w, e) of each edge that a batch of bumps (a, b, t, alpha) touches: its weight as of epoch e. Needs the RocksDB state store.

    prune: edges whose weight has faded leave the state, and come out once more with weight 0. Recalls may
    then arrive at most `late` recalls out of order; later ones are left out.
    """
    schema = "a string, b string, w double, e long"
    if not prune:
        return bumps.groupBy("a", "b").transformWithStateInPandas(LedgerProcessor(), schema, "Update", "None")
    clocked = bumps.withColumn("_at", F.timestamp_seconds("t")).withWatermark("_at", f"{late} seconds")
    return clocked.groupBy("a", "b").transformWithStateInPandas(FadingLedgerProcessor(), schema, "Update", "EventTime")


def save_stream(texts: DataFrame, store, checkpoint: str, **trigger):
    """Saves a stream of texts (at, text) into a store, each micro-batch as one entry in the order of at; returns the running query. A batch that comes again after a failure confirms what it saved before, as its texts are there already."""

    def save(batch: DataFrame, _: int) -> None:
        day = F.floor(F.unix_micros("at") / 86_400_000_000)
        rows = batch.where("text IS NOT NULL AND at IS NOT NULL").withColumns({"_d": day, "_i": F.row_number().over(Window.partitionBy(day).orderBy("at", "text"))})
        # places in the order of time: days are numbered by themselves, then lifted
        lift = rows.groupBy("_d").agg(F.count("*").alias("_n")).withColumn("_lift", F.sum("_n").over(Window.orderBy("_d")) - F.col("_n")).drop("_n")  # one row per day
        store.save_set(rows.join(lift, "_d").select((F.col("_lift") + F.col("_i")).alias("_pos"), "text", "at"))

    return texts.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
