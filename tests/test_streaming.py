"""Streams over several small batches must end where the batch operators end."""

import uuid

import pytest
from pyspark.sql import functions as F

from dayweave.operators.windows import RECIPES
from dayweave.plans.live import EVENT_SCHEMA
from dayweave.session import scratch_path
from dayweave.sources import tables as T
from dayweave.streaming import live as S


@pytest.fixture(scope="module")
def parts(spark, sf_dir):
    """The event table in four files, oldest first; the last one lacks two people."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts").limit(400).toPandas()
    path = scratch_path(spark, "parts")
    cut = [raw.iloc[:100], raw.iloc[100:200], raw.iloc[200:300], raw.iloc[300:][raw.iloc[300:].user_id % 8 > 1]]
    for k, part in enumerate(cut):
        spark.createDataFrame(part, EVENT_SCHEMA).coalesce(1).write.parquet(f"{path}/{k}")
    return path


def stream(spark, parts):
    S.use_rocksdb(spark)
    return T.as_events(S.file_source(spark, f"{parts}/*", EVENT_SCHEMA, files_per_trigger=1))


def batch(spark, parts):
    return T.as_events(spark.read.schema(EVENT_SCHEMA).parquet(f"{parts}/*"))


def test_merged_state_keeps_people_absent_from_the_last_batch(spark, parts):
    path = scratch_path(spark, "state")
    S.run_available(stream(spark, parts).select("person", F.unix_micros("ts").alias("w"), "event_type"), sink=S.state_sink(path))
    got = {r.person: (r.w, r.event_type) for r in S.current_state(spark, path).collect()}
    want = {r.person: (r.w, r.event_type) for r in batch(spark, parts).groupBy("person").agg(F.max(F.unix_micros("ts")).alias("w"), F.max_by("event_type", "ts").alias("event_type")).collect()}
    assert got == want and len(want) == 8


def test_merged_state_survives_replays_and_late_rows(spark):
    path = scratch_path(spark, "state")
    write = S.state_sink(path)
    rows = lambda *r: spark.createDataFrame(list(r), "person string, w long, v string")
    write(rows(("a", 5, "x"), ("b", 1, "y")), 0)
    write(rows(("a", 9, "z")), 1)
    write(rows(("a", 9, "z")), 1)
    write(rows(("a", 3, "late"), ("c", 2, "w")), 2)
    assert {tuple(r) for r in S.current_state(spark, path).collect()} == {("a", 9, "z"), ("b", 1, "y"), ("c", 2, "w")}
    assert S._versions(spark, path) == [1, 2]


def test_raw_writer_writes_a_replayed_batch_once(spark, parts):
    path = scratch_path(spark, "raw")
    write = S.raw_writer(path)
    rows = T.as_readings(batch(spark, parts)).cache()
    for batch_id in (0, 1, 1, 0):
        write(rows.where(F.col("write_seq") % 2 == batch_id), batch_id)
    assert spark.read.parquet(path).count() == rows.count()
    rows.unpersist()


def test_intervals_over_many_batches_equal_one_batch(spark, parts):
    many = S.run_available(S.stream_intervals(T.as_readings(stream(spark, parts))))
    S.use_rocksdb(spark)
    one = S.run_available(S.stream_intervals(T.as_readings(T.as_events(S.file_source(spark, f"{parts}/*", EVENT_SCHEMA)))))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(many) == key(one) and many.select("role").distinct().count() > 5
    assert all(r.to_min - r.from_min <= RECIPES[r.role].fill_min + 1 for r in many.collect())


@pytest.mark.parametrize("k", [1, 2, 3])
def test_smoother_equals_hysteresis_for_every_k(spark, k):
    from dayweave.operators.runs import hysteresis

    rows = spark.range(240).select(
        F.concat(F.lit("p"), (F.col("id") % 2).cast("string")).alias("person"), F.floor(F.col("id") / 2).alias("w"),
        F.element_at(F.array(*map(F.lit, "abc")), (F.pmod(F.xxhash64("id"), F.lit(3)) + 1).cast("int")).alias("predicted"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)) / 100.0).alias("confidence"),
    ).withColumn("ts", F.timestamp_seconds(F.col("w") * 60)).cache()
    path = scratch_path(spark, "labels")
    for part in range(3):
        rows.where(F.floor(F.col("w") / 40) == part).coalesce(1).write.parquet(f"{path}/{part}")
    S.use_rocksdb(spark)
    got = S.run_available(S.stream_smoothing(S.file_source(spark, f"{path}/*", rows.schema, files_per_trigger=1), k=k, grid_min=1))
    want = {(r.person, r.w): r.published for r in hysteresis(rows.select("person", "w", "predicted", "confidence"), ["person"], k=k).collect()}
    mine = {(r.person, r.w): r for r in got.collect()}
    assert len(mine) > 180 and all(want[key] == r.published for key, r in mine.items())
    for (person, w), r in mine.items():
        before = mine.get((person, w - 1))
        assert r.run_len == (before.run_len + 1 if before is not None and before.published == r.published else 1)
    rows.unpersist()


def test_names_avoid_all_names_in_use(spark):
    from dayweave.operators.metadata import approve_pending

    pending = spark.createDataFrame([(f"e{i}", "light", "lamp") for i in range(4)] + [("x", "light", "fan")], "entity_id string, suggested_role string, suggested_name string")
    used = spark.createDataFrame([("lamp",), ("lamp_2",), ("lamp_4",), ("fan_2",)], "name string")
    got = {r.entity_id: r.name for r in approve_pending(pending, pending, used).collect()}
    assert got == {"e0": "lamp_3", "e1": "lamp_5", "e2": "lamp_6", "e3": "lamp_7", "x": "fan"}


def test_no_table_stays_in_memory_after_the_flagship(spark, sf_dir):
    from dayweave.plans import registry

    kept = lambda: set(spark.sparkContext._jsc.getPersistentRDDs())
    before = kept()  # other tests may hold tables of their own
    registry.flagship(spark, sf_dir).collect()
    assert kept() <= before
