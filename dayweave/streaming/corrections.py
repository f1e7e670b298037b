"""STR-08: readings whose values are corrected after delivery.

The last write of a (series, time) wins, by the number of the write. A later write replaces the value
downstream: the change log retracts the old row and adds the new one, and a window whose rows changed in
a micro-batch is given out again, once. A row delivered again changes nothing. Rows are held until
the watermark is `keep` past their block of windows; corrections that come later are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGES = "person string, binding string, us long, op int, num double, str string, write_seq long"
WINDOWS = "person string, binding string, window_start long, n long, total double, vmax double, last double, version long"
#: Windows that are one entry of the state.
TOGETHER = 24
#: With more blocks of windows than these in a batch, the state is asked once which of them it holds.
FEW = 16


class LastWrite(StatefulProcessor):
    """State of a series: the rows of a block of windows are one entry, so a batch touches only the blocks it brings.

    The calls to the state grow with the time that is held and not with the windows; rows are held until their block ends.
    """

    def __init__(self, windows: bool, width_min: int):
        self.windows, self.width, self.block = windows, width_min, width_min * TOGETHER

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "window_start long", "us array<long>, seq array<long>, num array<double>, str array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[int, list[tuple]] = {}
        for pdf in rows:
            us, num, text = pdf["us"].astype("int64"), pdf["num"].astype("float64"), pdf["str"].astype("object")
            at = us // 60_000_000
            lists = (at - at % self.block).tolist(), us.tolist(), pdf["write_seq"].astype("int64").tolist(), num.tolist(), text.where(text.notna(), None).tolist()
            for start, *row in zip(*lists):
                fresh.setdefault(start, []).append(row)
        # one call for the blocks that are held, and not one for each that comes
        held = {k[0] for k in self.held.keys()} if len(fresh) > FEW else None
        out = []
        for start, new in sorted(fresh.items()):
            before = self._read(start) if held is None or start in held else {}
            after = dict(before)
            for us, seq, num, text in new:
                # equal numbers are one write delivered twice
                if us not in after or seq > after[us][0]:
                    after[us] = (seq, None if num != num else num, text)
            written = sorted({r[0] for r in new if r[0] not in before or before[r[0]] != after[r[0]]})
            changed = [us for us in written if us not in before or before[us][1:] != after[us][1:]]
            if written:
                times = sorted(after)
                self.held.updateValue((start,), (times, [after[t][0] for t in times], [after[t][1] for t in times], [after[t][2] for t in times]))
                if not before:
                    self.handle.registerTimer((start + self.block) * 60_000)
            out += self._windows(key, changed, after) if self.windows else self._changes(key, changed, before, after)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in (WINDOWS if self.windows else CHANGES).split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # the watermark has passed these blocks: no correction can come any more
        done = timerValues.getCurrentWatermarkInMs()
        for start in [k[0] for k in self.held.keys() if (k[0] + self.block) * 60_000 <= done]:
            self.held.removeKey((start,))
        yield pd.DataFrame([], columns=[c.split()[0] for c in (WINDOWS if self.windows else CHANGES).split(", ")])

    def _read(self, start: int) -> dict[int, tuple]:
        if not self.held.containsKey((start,)):
            return {}
        us, seq, num, text = self.held.getValue((start,))
        plain = lambda v: None if v is None or v != v else v
        return {int(u): (int(s), plain(n), plain(t)) for u, s, n, t in zip(us, seq, num, text)}

    def _changes(self, key, changed: list[int], before: dict, after: dict) -> list[tuple]:
        out = []
        for us in changed:
            if us in before:
                out.append((*key, us, -1, before[us][1], before[us][2], before[us][0]))
            out.append((*key, us, 1, after[us][1], after[us][2], after[us][0]))
        return out

    def _windows(self, key, changed: list[int], after: dict) -> list[tuple]:
        start_of = lambda us: us // 60_000_000 - us // 60_000_000 % self.width
        parts: dict[int, dict] = {start_of(us): {} for us in changed}
        for us, row in after.items() if parts else ():
            if (start := start_of(us)) in parts:
                parts[start][us] = row
        return [self._window(key, start, rows) for start, rows in parts.items()]

    def _window(self, key, start: int, rows: dict) -> tuple:
        nums = [(us, r[1]) for us, r in sorted(rows.items()) if r[1] is not None]
        values = [n for _, n in nums]
        return (*key, start, len(rows), sum(values) if values else None, max(values, default=None), values[-1] if values else None, max(r[0] for r in rows.values()))

    def close(self) -> None:
        pass


def _run(stream: DataFrame, windows: bool, width_min: int, keep: str, schema: str) -> DataFrame:
    rows = stream.withWatermark("ts", keep).select("person", "binding", "ts", F.unix_micros("ts").alias("us"), "num", "str", "write_seq")
    return rows.groupBy("person", "binding").transformWithStateInPandas(LastWrite(windows, width_min), schema, "Append", "EventTime")


def corrected_readings(stream: DataFrame, keep: str = "7 days", width_min: int = 30) -> DataFrame:
    """Change log with op +1 (row added) and -1 (row retracted). stream: (person, binding, ts, num, str, write_seq)."""
    return _run(stream, False, width_min, keep, CHANGES)


def corrected_windows(stream: DataFrame, keep: str = "7 days", width_min: int = 30) -> DataFrame:
    """Window rows; a window is given again whenever its rows changed, with a higher version."""
    return _run(stream, True, width_min, keep, WINDOWS)


def newest(windows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The newest row of each key of a log of versions."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(v).desc() for v in version])
    return windows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def folded(changes: DataFrame) -> DataFrame:
    """(person, binding, us, num, str): the rows that a change log leaves. Sums of op cancel what was retracted."""
    return changes.groupBy("person", "binding", "us", "num", "str").agg(F.sum("op").alias("op")).where("op > 0").drop("op")
