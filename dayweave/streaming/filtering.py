"""STR-06: the forward filter with transition and duration prior as keyed state.

A person's state is the window scored last, its label and the length of its run. Windows wait until
the watermark passes them, so they settle in the order of time, and the rows are those of the batch
operator. A correction of a window that has settled comes too late. The person's tables travel with
the rows from a static table, which is read anew for every micro-batch: a model learned meanwhile holds from then on.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.chains import Model, advance
from ..operators.runs import GRID_MIN

FILTERED = "person string, w long, coarse string, coarse_confidence double, probs string, run_len long"


class ForwardFilter(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "w long", "part string, gate string, probs string, fired string")
        self.last = handle.getValueState("last", "w long, state string, run long")
        self.tables = handle.getValueState("tables", "moves string, ends string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        text = lambda v: v if isinstance(v, str) else None
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                self.waiting.updateValue((int(r.w),), (text(r.part), text(r.gate), text(r.probs), text(r.fired)))
            self.tables.update((text(r.moves), text(r.ends)))
        yield self._settle(key, timerValues.getCurrentWatermarkInMs() // 60_000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._settle(key, timerValues.getCurrentWatermarkInMs() // 60_000)

    def _settle(self, key, upto: int) -> pd.DataFrame:
        times = sorted(k[0] for k in self.waiting.keys())
        ready, out = [w for w in times if w < upto], []
        last = tuple(self.last.get()) if self.last.exists() else None
        model = Model(*self.tables.get()) if ready else None
        for w in ready:
            part, gate, probs, fired = self.waiting.getValue((w,))
            self.waiting.removeKey((w,))
            if last is not None and w <= last[0]:
                continue
            held = (last[1], last[2]) if last is not None and w - last[0] == GRID_MIN else None
            state, confidence, now, run = advance(model, held, part, gate, json.loads(probs) if probs else None, json.loads(fired) if fired else [])
            last = (w, state, run)
            out.append((key[0], w, state, confidence, json.dumps(now), run))
        if out:
            self.last.update(last)
        if len(ready) < len(times):
            self.handle.registerTimer((times[len(ready)] + 1) * 60_000)
        return pd.DataFrame(out, columns=["person", "w", "coarse", "coarse_confidence", "probs", "run_len"])

    def close(self) -> None:
        pass


def stream_filter(stream: DataFrame, models: DataFrame, late: str = "10 minutes") -> DataFrame:
    """stream: (person, ts, w, part, gate, probs, fired), maps and markers as JSON; models: (person, moves, ends) of `model_texts`.

    run_len counts up to the longest run the prior knows.
    """
    rows = stream.withWatermark("ts", late).select("person", "ts", "w", "part", "gate", "probs", "fired").join(models, "person", "left")
    return rows.groupBy("person").transformWithStateInPandas(ForwardFilter(), FILTERED, "Append", "EventTime")
