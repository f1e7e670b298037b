"""Operators of the live lane that act on the clock: silence alarms and the debounce of dirty people.

In processing time both run on a stream that brings nothing at all: Spark keeps starting batches for
their timers. The debounce also runs in event time, where its rows can be compared with a batch query.
"""

from __future__ import annotations

import time
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ensure_checkpoint_dir


class SilenceAlarm(StatefulProcessor):
    """STR-10: a source is down when it has brought nothing for `quiet_s` seconds of processing time.

    The incident is raised by a timer, so it comes although no source brings anything. While the
    silence lasts it is renewed every `renew_s` seconds, as incidents expire; the next row of the
    source clears it. One timer per source; expected sources can start with a state of their own.
    """

    def __init__(self, quiet_s: float, renew_s: float | None = None):
        self.quiet_ms, self.renew_ms = int(quiet_s * 1000), int(renew_s * 1000) if renew_s else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "seen long, down boolean, due long")

    def _arm(self, seen: int, down: bool, due: int, before: int) -> None:
        if before > 0:
            self.handle.deleteTimer(before)
        if due > 0:
            self.handle.registerTimer(due)
        self.state.update((seen, down, due))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        now = timerValues.getCurrentProcessingTimeInMs()
        self._arm(now, False, now + self.quiet_ms, 0)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for _ in rows:
            pass
        now = timerValues.getCurrentProcessingTimeInMs()
        seen, down, due = tuple(self.state.get()) if self.state.exists() else (now, False, 0)
        self._arm(now, False, now + self.quiet_ms, due)
        yield self._rows([(key[0], "recovered", now, seen)] if down else [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        seen, down, _ = tuple(self.state.get())
        self._arm(seen, True, now + self.renew_ms if self.renew_ms else 0, 0)
        yield self._rows([(key[0], "renewed" if down else "silent", now, seen)])

    def _rows(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["source", "status", "at_ms", "seen_ms"])

    def close(self) -> None:
        pass


def silence_alarm(stream: DataFrame, source: str, quiet_s: float = 21_600, renew_s: float | None = 300, expected: DataFrame | None = None) -> DataFrame:
    """(source, status, at_ms, seen_ms). expected: (source) rows that are watched from the start, though they never spoke."""
    rows = stream.select(F.col(source).cast("string").alias("source")).groupBy("source")
    first = expected.select(F.col("source").cast("string").alias("source")).groupBy("source") if expected is not None else None
    return rows.transformWithStateInPandas(SilenceAlarm(quiet_s, renew_s), "source string, status string, at_ms long, seen_ms long", "Append", "ProcessingTime", initialState=first)


#: Changes that wait for the watermark are held in blocks of so many milliseconds.
BLOCK_MS = 600_000


class Debounce(StatefulProcessor):
    """STR-03: one row per person for a burst of changes, and one for every quiet interval.

    The first change opens a burst; `wait_s` seconds later the person is handed on once, with the number
    of changes that came meanwhile. `tick_s` seconds after a person was handed on without a change since,
    it is handed on again. Only counts by time are held, and one timer per person. The counts of a block of time are
    one entry of the state, so the calls to it grow with the time that waits and not with the changes.
    """

    def __init__(self, wait_s: float, tick_s: float | None, event_time: bool):
        self.wait, self.tick, self.event_time = int(wait_s * 1000), int(tick_s * 1000) if tick_s else None, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # changes that the watermark has not passed yet, in order
        self.waiting = handle.getMapState("waiting", "block long", "at array<long>, n array<long>")
        self.state = handle.getValueState("state", "opened long, n long, out long, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat([pdf["ms"].value_counts() for pdf in rows]).groupby(level=0).sum()
        if not self.event_time:
            now = timerValues.getCurrentProcessingTimeInMs()
            yield self._settle(key, [(now, int(got.sum()))], now)
            return
        upto = timerValues.getCurrentWatermarkInMs()
        held = {k[0] for k in self.waiting.keys()}
        for block, part in got.groupby(got.index.astype("int64") // BLOCK_MS):
            fresh = dict(zip(part.index.astype("int64").tolist(), part.tolist()))
            if block in held:
                for at, n in zip(*self.waiting.getValue((int(block),))):
                    fresh[int(at)] = fresh.get(int(at), 0) + int(n)
            times = sorted(fresh)
            self.waiting.updateValue((int(block),), (times, [fresh[t] for t in times]))
        changes, later = self._passed(upto)
        yield self._settle(key, changes, upto, later)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        changes, later = self._passed(upto) if self.event_time else ([], -1)
        yield self._settle(key, changes, upto, later)

    def _passed(self, upto: int) -> tuple[list[tuple[int, int]], int]:
        """Changes before the watermark, taken out of the state, and the time of the first that stays (−1: none)."""
        ready: list[tuple[int, int]] = []
        for block in sorted(k[0] for k in self.waiting.keys()):
            times, counts = ([int(v) for v in held] for held in self.waiting.getValue((block,)))
            cut = bisect_left(times, upto)
            ready += zip(times[:cut], counts[:cut])
            if cut == len(times):
                self.waiting.removeKey((block,))
                continue
            if cut:
                self.waiting.updateValue((block,), (times[cut:], counts[cut:]))
            return ready, times[cut]
        return ready, -1

    def _due(self, opened: int, out: int) -> int:
        return opened + self.wait if opened >= 0 else out + self.tick if out >= 0 and self.tick else -1

    def _settle(self, key, changes: list[tuple[int, int]], upto: int, later: int = -1) -> pd.DataFrame:
        opened, n, out, armed = tuple(self.state.get()) if self.state.exists() else (-1, 0, -1, -1)
        rows = []
        for at, held in [*changes, (upto, 0)]:
            while 0 <= (due := self._due(opened, out)) <= at:
                rows.append((key[0], due, "burst" if opened >= 0 else "tick", n))
                opened, n, out = -1, 0, due
            if held:
                opened, n = (at if opened < 0 else opened), n + held
        due = self._due(opened, out)
        if later >= 0:
            due = min(later + 1, due) if due >= 0 else later + 1
        if due != armed:
            if armed > upto:
                self.handle.deleteTimer(armed)
            if due >= 0:
                due = max(due, upto + 1)
                self.handle.registerTimer(due)
        self.state.update((opened, n, out, due))
        return pd.DataFrame(rows, columns=["person", "at_ms", "reason", "n"])

    def close(self) -> None:
        pass


def debounce(stream: DataFrame, wait_s: float = 3, tick_s: float | None = 60, late: str | None = None) -> DataFrame:
    """(person, at_ms, reason burst or tick, n). stream: (person, ts); late: event time with this delay, else processing time."""
    rows = stream.withWatermark("ts", late) if late else stream
    keyed = rows.select("person", "ts", F.unix_millis("ts").alias("ms")).groupBy("person")
    return keyed.transformWithStateInPandas(Debounce(wait_s, tick_s, late is not None), "person string, at_ms long, reason string, n long", "Append", "EventTime" if late else "ProcessingTime")


# --- sinks and running ------------------------------------------------------------------------------------


def log_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Appends micro-batches to a log; a replayed batch overwrites the partition it owns."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    return write


def open_incidents(log: DataFrame, now_ms: int | None = None, ttl_s: float | None = None) -> DataFrame:
    """Sources that are down by their last row, not older than the time to live."""
    w = Window.partitionBy("source").orderBy(F.col("at_ms").desc(), F.col("seen_ms").desc())
    last = log.withColumn("_r", F.row_number().over(w)).where("_r = 1 and status <> 'recovered'").drop("_r", "batch_id")
    return last if ttl_s is None else last.where(F.lit(now_ms) - F.col("at_ms") <= ttl_s * 1000)


def run_until(stream: DataFrame, done: Callable[[DataFrame], bool], limit_s: float = 90, every: str = "500 milliseconds", base: str | None = None, meanwhile: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Runs a stream on a processing-time trigger until `done` holds for its log, and gives the log."""
    spark: SparkSession = stream.sparkSession
    base = base or f"{ensure_checkpoint_dir(spark)}/live-{uuid.uuid4().hex}"
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in stream.schema)}, batch_id long"
    spark.createDataFrame([], schema).write.mode("append").partitionBy("batch_id").parquet(f"{base}/log")
    read = lambda: spark.read.schema(schema).parquet(f"{base}/log")
    query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{base}/ckpt").trigger(processingTime=every).foreachBatch(log_sink(f"{base}/log")).start()
    try:
        end = time.monotonic() + limit_s
        while not done(read()):
            if query.exception() is not None:
                raise query.exception()
            if time.monotonic() > end:
                raise TimeoutError("the stream did not reach the awaited state")
            if meanwhile is not None:
                meanwhile(read())
            time.sleep(0.5)
    finally:
        query.stop()
    return read()
