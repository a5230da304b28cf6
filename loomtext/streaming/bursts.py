"""Bursts of file events on a stream: what debounced() gives for a table, with the open bursts of each path as state.

A task merges its own events into bursts before they are dealt by path, so a path with a third of all events costs a row a task and burst. Bursts
are merged like events: inside one no gap is longer than the quiet time, so the order of merging does not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loomtext.operators.sync import renames

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Times in microseconds; at, event_id and op are those of the last event.
BURST = "start long, end long, at long, event_id long, op string, n long"
OUT = "path string, burst_start timestamp, burst_end timestamp, op string, n long, late boolean"


def micros(interval: str) -> int:
    return pd.Timedelta(interval) // pd.Timedelta(1, "us")


def merged(bursts: pd.DataFrame, quiet: int) -> pd.DataFrame:
    """path and BURST of rows of the same kind: one row for all that lie a quiet time or less apart, as in Spark's session windows."""
    rows = bursts.sort_values(["path", "start"], kind="stable")
    reached = rows.groupby("path", sort=False)["end"].cummax()
    apart = (rows["path"] != rows["path"].shift()) | (rows["start"] - reached.shift() > quiet)
    rows = rows.assign(burst=apart.cumsum())
    sums = rows.groupby("burst", sort=True).agg(path=("path", "first"), start=("start", "min"), end=("end", "max"), n=("n", "sum"))
    last = rows.sort_values(["at", "event_id", "op"], kind="stable").groupby("burst", sort=True)[["at", "event_id", "op"]].last()
    return sums.join(last)[["path", *(x.split()[0] for x in BURST.split(", "))]].reset_index(drop=True)


def joined(bursts: list[tuple], quiet: int) -> list[tuple]:
    """What merged() gives, for the bursts of one path as tuples of BURST: a path has few, so they need no table."""
    out: list[tuple] = []
    for start, end, at, event_id, op, n in sorted(bursts, key=lambda b: b[0]):
        if out and start - out[-1][1] <= quiet:
            own = out.pop()
            last = max(own[2:5], (at, event_id, op))
            out.append((own[0], max(own[1], end), *last, own[5] + n))
        else:
            out.append((start, end, at, event_id, op, n))
    return out


class _Open(StatefulProcessor):
    """Keeps the bursts of a path that may still grow; a timer at the earliest end gives them out."""

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", BURST)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        over, new = self._divided([tuple(r)[1:] for r in rows], mark)
        yield from self._shown(key[0], joined(over, self.quiet), True)
        if new:
            old = self._kept()
            self._keep(joined([*old, *new], self.quiet), self._due(old))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        over, rest = self._divided(self._kept(), timerValues.getCurrentWatermarkInMs() * 1000)
        yield from self._shown(key[0], over, False)
        self._keep(rest, None)  # a timer that has fired goes by itself

    def _divided(self, bursts: list[tuple], mark: int) -> tuple[list[tuple], list[tuple]]:
        over = [b for b in bursts if b[1] + self.quiet < mark]
        return over, [b for b in bursts if b[1] + self.quiet >= mark]

    def _shown(self, path: str, bursts: list[tuple], late: bool) -> Iterator[Row]:
        for start, end, _, _, op, n in bursts:
            yield Row(path=path, start=start, end=end + self.quiet, op=op, n=n, late=late)

    def _kept(self) -> list[tuple]:
        return [tuple(b) for b in self.open.get()]

    def _due(self, bursts: list[tuple]) -> int | None:
        """When the timer of some bursts is due: they have one timer, at the earliest end."""
        return (min(b[1] for b in bursts) + self.quiet) // 1000 + 1 if bursts else None

    def _keep(self, bursts: list[tuple], timer: int | None) -> None:
        due = self._due(bursts)
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if bursts:
            self.open.put(bursts)
            if timer != due:
                self.handle.registerTimer(due)
        else:
            self.open.clear()

    def close(self) -> None:
        pass


def debounced_stream(events: DataFrame, quiet: str, late: str) -> DataFrame:
    """path, burst_start, burst_end, op, n, late of a stream of events(event_id, ts, file_path, old_path, op).

    A burst is given out once the watermark (the newest time less late) has passed its end; those that are open stay in the checkpoint and
    survive restarts. An event that comes so late that a burst of its own would be over is not dropped: it is given out at once with late set, merged with others of
    its micro-batch alone, since its true neighbours may be gone. Events without a time or a Markdown path are left out; a missing event_id counts as -1. Sets the session's state store to RocksDB, which timers and lists need.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    gap = micros(quiet)
    timed = renames(events.withColumn("ts", F.col("ts").cast("timestamp"))).where(F.lower("path").endswith(".md") & F.col("ts").isNotNull()).withWatermark("ts", late)
    at = F.unix_micros("ts")  # no event time to Spark, so late rows reach the processor
    points = timed.select("path", at.alias("start"), at.alias("end"), at.alias("at"), F.coalesce(F.col("event_id").cast("long"), F.lit(-1)).alias("event_id"), "op", F.lit(1).cast("long").alias("n"))

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield merged(b, gap)

    found = points.mapInPandas(combine, f"path string, {BURST}").groupBy("path").transformWithState(_Open(gap), "path string, start long, end long, op string, n long, late boolean", "append", "EventTime")
    return found.select("path", F.timestamp_micros("start").alias("burst_start"), F.timestamp_micros("end").alias("burst_end"), "op", "n", "late")
