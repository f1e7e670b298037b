"""Joins on few keys with many rows, overlaps of feature sets, boosting sums that stay on the executors."""

import random

import numpy as np
import pandas as pd
import pytest
from dayweave.functions import blocks, ranks
from dayweave.operators import boosting, joins, metadata, scoring, stats, topk
from dayweave.streaming import corrections
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F


def test_blocks_give_the_plain_join_over_many_tasks(spark):
    """Copies, null keys and keys of one side; a key is not left to one task."""
    left = spark.createDataFrame([(k, i % 40) for k in (1, 2, None) for i in range(50)], "k int, a int")
    right = spark.createDataFrame([(k, i % 30) for k in (1, 3, None) for i in range(90)], "k int, b int")
    got = blocks.join_in_blocks(left, right, ["k"], block=10)
    want = left.join(right, "k")
    assert sorted(map(tuple, got.select("k", "a", "b").collect())) == sorted(map(tuple, want.select("k", "a", "b").collect()))
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_scope_and_gates_of_one_home_are_spread(spark):
    """All rows share a home; before, they met in one task."""
    people = spark.createDataFrame([(f"c{i}", 0) for i in range(300)], "person_id string, home int")
    own = lambda i: f"c{i}" if i % 5 == 0 else None
    bound = spark.createDataFrame([(0, f"b{i}", own(i), i % 7 > 0) for i in range(6000)], "home int, name string, person_id string, enabled boolean")
    got = metadata.person_scope(bound, people)
    want = sorted((0, f"c{p}", f"b{i}") for p in range(300) for i in range(6000) if i % 7 and own(i) in (None, f"c{p}"))
    assert sorted(map(tuple, got.collect())) == want
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 2
    facts = spark.createDataFrame([(f"f{i}", "asleep" if i % 3 else "away", own(i), 0, i % 7 > 0) for i in range(60)], "fact_id string, gate string, person_id string, home int, enabled boolean")
    verdicts = spark.createDataFrame([(f"f{i}", "fact" if i % 2 else "suspect") for i in range(60)], "fact_id string, decision string")
    gates = sorted((f"c{p}", f"f{i}", "asleep") for p in range(300) for i in range(60) if i % 2 and i % 3 and i % 7 and own(i) in (None, f"c{p}"))
    assert sorted(map(tuple, scoring.earned_gates(facts, verdicts, people).collect())) == gates


def test_frequent_columns_are_matched_in_many_tasks(spark):
    """A column of most rows, with a binding or without, and rows without a column are not left to one task."""
    said = {"hour_of_day": None, "hall_door_1_max_w": "hall_door_1", "hall_2_on_frac_lag1": "hall_2", None: None}
    rows = [(i, [*said][i % 7 % 3] if i % 10 else None) for i in range(20_000)] + [(20_000 + i, f"hall_{i % 9}_mean") for i in range(100)]
    names = spark.createDataFrame([("hall", 7), *[(f"hall_{i}", i) for i in range(5)], ("hall_door_1", 9)], "name string, role int")
    kept = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for c, v in zip(kept, ("false", "-1")):
            spark.conf.set(c, v)
        got = metadata.match_binding(spark.createDataFrame(rows, "id int, feature string"), names).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    want = lambda f: said[f] if f in said else f[:6] if int(f[5]) < 5 else "hall"
    assert sorted((r.id, r.name) for r in got) == sorted((i, want(f)) for i, f in rows)
    assert {r.suffix for r in got if r.feature == "hall_door_1_max_w"} == {"max_w"} and {r.role for r in got if r.feature == "hall_2_on_frac_lag1"} == {2}
    held = [r.task for r in got]
    assert max(held.count(t) for t in set(held)) < 0.4 * len(rows)


def test_drift_reads_a_value_once_and_cuts_ranks_once(spark, monkeypatch):
    """Both sides of a value are one row, and rows and offsets have the same cuts, however a sketch comes out again."""
    long = spark.range(4000).select(F.lit("v").alias("feature"), F.when(F.col("id") % 2 == 0, "expected").otherwise("actual").alias("side"), (F.floor(F.col("id") / 2) % 500).cast("double").alias("value"))
    kept, rows = stats.materialise, []

    def watched(df, name):
        out = kept(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(stats, "materialise", watched)
    got = stats.psi(long, ["feature"]).first()
    assert (round(got.psi, 9), got.n_expected, got.n_actual) == (0, 2000, 2000) and rows == [500]
    plan = ranks.value_cdf(long, ["feature"], "value")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx" not in plan


class _Handle:
    """The state of one series, with a count of the calls to it."""

    def __init__(self):
        self.map, self.calls, self.timers = {}, 0, 0

    def getMapState(self, *_):
        return self

    def registerTimer(self, _):
        self.timers += 1

    def _called(self, value):
        self.calls += 1
        return value

    def keys(self):
        return self._called(iter(list(self.map)))

    def containsKey(self, k):
        return self._called(k in self.map)

    def getValue(self, k):
        return self._called(self.map[k])

    def updateValue(self, k, v):
        self.map[k] = self._called(v)


def test_corrections_hold_many_windows_in_one_entry():
    got = corrections.LastWrite(False, 30)
    got.init(handle := _Handle())
    at = 1_800_000_000 * np.arange(200)
    first = pd.DataFrame({"us": at, "write_seq": range(200), "num": [None, *[1.0] * 199], "str": ["on", *[None] * 199]})
    (out,) = got.handleInputRows(("p", "b"), iter([first]), None)
    assert len(out) == 200 and handle.calls <= 20 and handle.timers <= 10
    later = first.assign(num=[None, 2.0, *[1.0] * 198], write_seq=first["write_seq"] + 500)
    (out,) = got.handleInputRows(("p", "b"), iter([later]), None)
    assert [tuple(r) for r in out[["us", "op", "num"]].to_numpy()] == [(at[1], -1, 1.0), (at[1], 1, 2.0)]
    (out,) = got.handleInputRows(("p", "b"), iter([later, first]), None)
    assert len(out) == 0 and handle.timers <= 10


@pytest.fixture(scope="module")
def cards(spark):
    rng = random.Random(3)
    rows = [(i // 2 if i < 20 else i, rng.sample("uvwxyz", rng.randint(1, 5))) for i in range(80)]
    return [*rows, rows[5], (None, ["u", "v", "w"]), (99, None)]


def test_overlaps_and_contrast_against_all_pairs(spark, cards):
    df = spark.createDataFrame(cards, "card int, features array<string>")
    named = [(c, f) for c, f in cards if c is not None and c % 4 == 0]
    known = {(c, tuple(f)) for c, f in cards if c is not None and f}
    pairs = [(a, b, len({*f[:4]} & {*g[:4]})) for a, f in known for b, g in {(c, tuple(f)) for c, f in named} if a != b]
    got = topk.signature_overlaps(df, df.where("card % 4 = 0"), "card", 3)
    assert sorted(map(tuple, got.collect())) == sorted(p for p in pairs if p[2] >= 3)
    best = {}
    for a, b, n in pairs:
        if n >= 2:
            best[a] = min(best.get(a, (0, 0)), (-n, b))
    assert {r.card: (-r.shared, r.like) for r in joins.contrast(df, df.where("card % 4 = 0")).collect()} == best


def test_contrast_of_like_cards_makes_no_pairs(spark):
    """60,000 cards of one set would be 900 million pairs."""
    like = spark.range(60_000).select(F.col("id").alias("card"), F.array(*map(F.lit, "uvwx")).alias("features"))
    got = joins.contrast(like, like.where("card % 4 = 0")).agg(F.count("*"), F.min("shared"), F.sum("like")).first()
    assert tuple(got) == (60_000, 4, 4)


def test_boosting_sends_one_row_a_node_to_the_driver(spark):
    rows = spark.range(400).select((F.col("id") % 3).alias("label"), array_to_vector(F.array(*[((F.col("id") * (7 + i)) % 13).cast("double") for i in range(5)])).alias("features"))
    seen = []
    kept = boosting.node_splits

    def watched(sums, width):
        whole = {}
        for r in sums.collect():
            whole.setdefault((r.k, r.node), np.zeros((3, width, 256)))[:, r.col, r.bin] += (r.g, r.h, r.n)
        got = kept(sums, width)
        assert got.keys() == whole.keys() and all(got[at][2:6] == pytest.approx(boosting.best_split(part)[2:6]) for at, part in whole.items())
        seen.append(len(got))
        return got

    boosting.node_splits = watched
    try:
        boosting.SoftmaxBooster(numClasses=3, maxIter=2, fewRows=0).fit(rows)
    finally:
        boosting.node_splits = kept
    assert seen and max(seen) <= 12
