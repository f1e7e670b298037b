"""Alarms, debounce, corrections and the forward filter over several batches and restarts."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from dayweave.operators.chains import filtered_states, model_texts
from dayweave.plans.live import flat_windows
from dayweave.session import materialise, scratch_path
from dayweave.streaming import alarms as A
from dayweave.streaming import corrections as C
from dayweave.streaming import live as S
from dayweave.streaming.filtering import stream_filter
from test_chains import filter_inputs


@pytest.fixture(autouse=True)
def state_store(spark):
    S.use_rocksdb(spark)


def deliver(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}")


def source(spark, path, schema):
    return S.file_source(spark, f"{path}/*", spark.createDataFrame([], schema).schema, files_per_trigger=1)


# --- silence -------------------------------------------------------------------------------------------

EVENT = "ts timestamp, source string"


def at(seconds):
    import datetime

    return datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=seconds)


def test_alarm_is_raised_without_any_input_and_cleared_by_the_next_row(spark):
    path = scratch_path(spark, "silence")
    deliver(spark, path, 0, [(at(0), "a"), (at(0), "b")], EVENT)
    expected = spark.createDataFrame([("a",), ("never",)], "source string")
    sent = []

    def speak_again(log):
        if not sent and {r.source for r in log.where("status = 'silent'").collect()} == {"a", "b", "never"}:
            sent.append(1)
            deliver(spark, path, 1, [(at(1), "b")], EVENT)

    stream = A.silence_alarm(source(spark, path, EVENT), "source", quiet_s=2, renew_s=2, expected=expected)
    log = A.run_until(stream, lambda df: df.where("status = 'recovered'").count() > 0 and df.where("status = 'renewed'").count() > 0, meanwhile=speak_again)
    seen = {}
    for r in log.orderBy("at_ms").collect():
        seen.setdefault(r.source, []).append(r.status)
    assert seen["a"][0] == seen["never"][0] == "silent" and "recovered" not in seen["a"] + seen["never"]
    assert [s for s in seen["b"] if s != "renewed"][:2] == ["silent", "recovered"]
    assert all(r.at_ms - r.seen_ms >= 2000 for r in log.where("status <> 'recovered'").collect())
    down = {r.source for r in A.open_incidents(log).collect()}
    assert {"a", "never"} <= down
    newest = log.agg(F.max("at_ms")).first()[0]
    assert A.open_incidents(log, newest + 3_600_000, 600).count() == 0


# --- debounce ------------------------------------------------------------------------------------------


def debounced(times, upto, wait, tick):
    out, opened, n, last = [], None, 0, None
    for t in [*sorted(times), upto]:
        while True:
            due = opened + wait if opened is not None else last + tick if last is not None else None
            if due is None or due > t:
                break
            out.append((due, "burst" if opened is not None else "tick", n))
            opened, n, last = None, 0, due
        if t != upto:
            opened, n = (t if opened is None else opened), n + 1
    return out


def test_debounce_over_batches_and_a_restart_equals_one_pass(spark):
    import random

    random.seed(5)
    times = {p: sorted(random.choice([0, 300]) + random.randrange(0, 280) for _ in range(30)) for p in "xyz"}
    times["x"] = [t for t in times["x"] if t < 300]
    rows = sorted((at(t), p) for p, ts in times.items() for t in ts) + [(at(900), "end")]
    path, base, schema = scratch_path(spark, "bursts"), scratch_path(spark, "run"), "ts timestamp, person string"
    run = lambda: S.run_available(A.debounce(source(spark, path, schema), 3, 60, late="10 seconds"), base=base)
    for i in range(2):
        deliver(spark, path, i, rows[25 * i : 25 * i + 25], schema)
    early = run().count()
    deliver(spark, path, 2, rows[50:], schema)
    got = {}
    for r in run().collect():
        got.setdefault(r.person, []).append((r.at_ms - int(at(0).timestamp() * 1000), r.reason, r.n))
    start = {p: [1000 * t for t in ts] for p, ts in times.items()}
    zone = min(x[0] for x in got["y"]) - debounced(start["y"], 890_000, 3000, 60_000)[0][0]  # the session reads naive times in its own zone
    want = {p: debounced(ts, 890_000, 3000, 60_000) for p, ts in start.items()}
    assert early > 0 and {p: [(a - zone, r, n) for a, r, n in sorted(v)] for p, v in got.items() if p != "end"} == want
    assert {r for v in want.values() for _, r, _ in v} == {"burst", "tick"}
    assert all(sum(n for _, _, n in want[p]) == len(times[p]) for p in "xyz")


class CountedState:
    """Stands for the state of one person, and counts the calls that would each go to Spark."""

    def __init__(self):
        self.calls, self.values, self.timers = 0, {}, set()

    def getMapState(self, name, *_):
        return self

    def getValueState(self, name, *_):
        return Value(self)

    def __getattr__(self, name):
        do = {"keys": lambda: iter(list(self.values)), "iterator": lambda: iter(list(self.values.items())), "getValue": lambda k: self.values[k], "containsKey": lambda k: k in self.values,
              "updateValue": lambda k, v: self.values.__setitem__(k, v), "removeKey": lambda k: self.values.pop(k), "registerTimer": self.timers.add, "deleteTimer": self.timers.discard}[name]

        def call(*args):
            self.calls += 1
            return do(*args)

        return call


class Value:
    def __init__(self, handle):
        self.handle, self.held = handle, None

    def exists(self):
        self.handle.calls += 1
        return self.held is not None

    def get(self):
        self.handle.calls += 1
        return self.held

    def update(self, v):
        self.handle.calls += 1
        self.held = v


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_debounce_calls_its_state_by_time_and_not_by_change():
    hour, got = 3_600_000, {}
    for step in (3_600, 36):  # a thousand and a hundred thousand changes of an hour
        handle = CountedState()
        p = A.Debounce(3, 60, True)
        p.init(handle)
        times = list(range(0, hour, step))
        first, second = pd.DataFrame({"ms": times[::2] + times[:1]}), pd.DataFrame({"ms": times[1::2]})
        out = [*p.handleInputRows(("y",), iter([first]), Clock(0)), *p.handleInputRows(("y",), iter([second]), Clock(hour // 2))]
        out += p.handleExpiredTimer(("y",), Clock(hour - 10_000), None)
        rows = [r for pdf in out for r in pdf.itertuples(index=False)]
        want = debounced([t for t in [times[0], *times] if t < hour - 10_000], hour - 10_000, 3000, 60_000)
        assert [(r.at_ms, r.reason, r.n) for r in rows] == want
        got[step] = handle.calls
    assert got[36] == got[3_600] < 100


def test_debounce_by_the_clock_ticks_without_input(spark):
    path = scratch_path(spark, "live")
    deliver(spark, path, 0, [(at(0), "p")] * 5, "ts timestamp, person string")
    log = A.run_until(A.debounce(source(spark, path, "ts timestamp, person string"), wait_s=1, tick_s=2), lambda df: df.count() >= 3)
    rows = log.orderBy("at_ms").collect()
    assert (rows[0].reason, rows[0].n) == ("burst", 5) and {(r.reason, r.n) for r in rows[1:]} == {("tick", 0)}
    assert rows[1].at_ms - rows[0].at_ms == 2000


# --- corrections ---------------------------------------------------------------------------------------

READING = "person string, binding string, ts timestamp, num double, str string, write_seq long"


def test_corrections_replace_values_and_replays_change_nothing(spark):
    path, base = scratch_path(spark, "fixes"), scratch_path(spark, "run")
    first = [("p", "b", at(60 * m), float(m), None, m) for m in (0, 5, 31, 40)] + [("p", "t", at(0), None, "on", 1)]
    parts = [
        first,
        [("p", "b", at(300), 50.0, None, 100), ("p", "b", at(300), 60.0, None, 101), ("p", "t", at(0), None, "off", 9)],  # two corrections at once
        first + [("p", "b", at(300), 60.0, None, 101)],  # delivered again
        [("p", "b", at(300), 7.0, None, 50), ("p", "b", at(600), 1.0, None, 4)],  # an older write, and a new row
        [("p", "b", at(0), 0.0, None, 200)],  # a later write of the same value
    ]
    for i, part in enumerate(parts):
        deliver(spark, path, i, part, READING)
    changes = S.run_available(C.corrected_readings(source(spark, path, READING), keep="30 days"))
    got = [(r.binding, r.op, r.num if r.str is None else r.str) for r in changes.collect()]
    assert sorted(map(str, got)) == sorted(map(str, [("b", 1, 0.0), ("b", 1, 5.0), ("b", 1, 31.0), ("b", 1, 40.0), ("t", 1, "on"), ("b", -1, 5.0), ("b", 1, 60.0), ("t", -1, "on"), ("t", 1, "off"), ("b", 1, 1.0)]))
    left = {(r.binding, r.num, r.str) for r in C.folded(changes).collect()}
    assert left == {("b", 0.0, None), ("b", 60.0, None), ("b", 31.0, None), ("b", 40.0, None), ("b", 1.0, None), ("t", None, "off")}
    log = f"{base}/log"
    S.run_available(C.corrected_windows(source(spark, path, READING), keep="30 days"), sink=A.log_sink(log), base=base)
    again = spark.read.parquet(log)
    # two windows at first, the first again for the correction and for the new row
    assert again.where("binding = 'b'").groupBy("batch_id").count().count() == 3 and again.where("binding = 'b'").count() == 4
    now = {r.window_start: (r.n, r.total, r.vmax, r.last) for r in C.newest(again.where("binding = 'b'"), ["person", "binding", "window_start"], ["batch_id"]).collect()}
    assert sorted(now.values()) == [(2, 71.0, 40.0, 40.0), (3, 61.0, 60.0, 1.0)]


def test_corrections_after_a_restart_and_after_the_horizon(spark):
    path, base = scratch_path(spark, "late"), scratch_path(spark, "run")
    run = lambda: S.run_available(C.corrected_readings(source(spark, path, READING), keep="1 hour"), base=base)
    deliver(spark, path, 0, [("p", "b", at(0), 1.0, None, 1), ("p", "b", at(3000), 2.0, None, 2)], READING)
    assert run().count() == 2
    deliver(spark, path, 1, [("p", "b", at(0), 9.0, None, 3)], READING)
    assert {(r.op, r.num) for r in run().collect()} == {(1, 1.0), (1, 2.0), (-1, 1.0), (1, 9.0)}
    deliver(spark, path, 2, [("p", "b", at(20_000), 3.0, None, 4)], READING)
    run()
    deliver(spark, path, 3, [("p", "b", at(0), 8.0, None, 5), ("p", "b", at(20_001), 4.0, None, 6)], READING)
    assert {(r.op, r.num) for r in run().collect()} == {(1, 1.0), (1, 2.0), (-1, 1.0), (1, 9.0), (1, 3.0), (1, 4.0)}


# --- forward filter ------------------------------------------------------------------------------------


def test_stream_filter_equals_the_batch_over_batches_and_a_restart(spark):
    *_, rows, matrices, hazards = filter_inputs(spark, 6)
    # event times before 1970 lie behind the first watermark
    rows, models = materialise(rows.withColumn("w", F.col("w") + 30_000_000), "rows"), materialise(model_texts(matrices, hazards), "models")
    want = {(r.person, r.w): (r.coarse, r.coarse_confidence, r.probs) for r in filtered_states(rows, matrices, hazards).collect()}
    base, path = scratch_path(spark, "run"), scratch_path(spark, "windows")
    flat = flat_windows(rows)
    lo, hi = flat.agg(F.min("w"), F.max("w")).first()
    part = F.floor((F.col("w") - lo) * 5 / (hi - lo + 1))

    def run(*parts):
        for i in parts:
            flat.where(part == i).coalesce(1).write.parquet(f"{path}/{i}")
        return S.run_available(stream_filter(S.file_source(spark, f"{path}/*", flat.schema, files_per_trigger=1), models), base=base)

    early = run(0, 1, 2).count()
    got = {(r.person, r.w): (r.coarse, r.coarse_confidence, json.loads(r.probs)) for r in run(3, 4).collect()}
    assert 0 < early < len(got) and got == {k: v for k, v in want.items() if k[1] < hi - 10}


def test_a_row_that_settled_is_not_scored_again(spark):
    schema = "person string, ts timestamp, w long, part string, gate string, probs string, fired string"
    path, base = scratch_path(spark, "again"), scratch_path(spark, "run")
    models = materialise(spark.createDataFrame([], "person string, moves string, ends string"), "models")
    row = lambda i: ("p", at(1800 * i), 30 * i, "0", None, json.dumps({"a": 0.6, "b": 0.4}), None)
    base_w = int(at(0).timestamp()) // 60
    rows = [tuple(base_w + v if k == 2 else v for k, v in enumerate(row(i))) for i in range(6)]
    run = lambda: S.run_available(stream_filter(source(spark, path, schema), models), base=base)
    deliver(spark, path, 0, rows[:4], schema)
    run()
    deliver(spark, path, 1, rows[3:], schema)
    got = run().collect()
    assert len(got) == len({r.w for r in got}) and max(r.run_len for r in got) == len(got)
