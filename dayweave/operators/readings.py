"""Reading, writing and maintaining the long raw table, features, labels and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Roles whose state is a number, and the words read as 1 and 0.
NUMERIC_ROLES = ["presence", "bed", "power", "env", "door", "focus", "steps", "battery", "light", "custom"]
SLOW_ROLES = ["person", "alarm_time"]
ON_WORDS = ["on", "true", "open", "detected", "home", "playing", "occupied"]
OFF_WORDS = ["off", "false", "closed", "clear", "not_home", "idle", "empty"]
VOID_STATES = ["unknown", "unavailable", ""]

PAYLOAD = T.StructType(
    [
        T.StructField("entity_id", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
        T.StructField("last_updated", T.StringType()),
    ]
)


def parse_payload(df: DataFrame, json_col: str = "payload", now: Column | None = None) -> DataFrame:
    """SRC-02: JSON state change → (entity_id, state, attributes, ts); a missing time is now."""
    now = F.current_timestamp() if now is None else now
    got = df.withColumn("_p", F.from_json(json_col, PAYLOAD))
    return got.select(
        *[c for c in df.columns if c != json_col],
        F.col("_p.entity_id").alias("entity_id"),
        F.col("_p.state").alias("state"),
        F.col("_p.attributes").alias("attributes"),
        F.coalesce(F.try_to_timestamp(F.col("_p.last_updated")), now).alias("ts"),
    )


def coerce_state(role: Column, state: Column) -> tuple[Column, Column]:
    """SRC-09: (num, str) of a state; unknown, unavailable and blank are NULL in both."""
    void = state.isNull() | state.isin(VOID_STATES)
    word = F.lower(F.trim(state))
    numeric = role.isin(NUMERIC_ROLES)
    number = F.when(word.isin(ON_WORDS), 1.0).when(word.isin(OFF_WORDS), 0.0).otherwise(word.try_cast("double"))
    return F.when(~void & numeric, number), F.when(~void & ~numeric, state)


def to_readings(states: DataFrame, bindings: DataFrame) -> DataFrame:
    """SRC-01/10: bound entities only, coerced, tagged; rows without a value are dropped."""
    tagged = states.join(
        bindings.select("entity_id", F.col("name").alias("binding"), "role", "room", "person_id"), "entity_id"
    )
    num, text = coerce_state(F.col("role"), F.col("state"))
    return tagged.withColumns({"num": num, "str": text}).where(F.col("num").isNotNull() | F.col("str").isNotNull())


def latest_write(df: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """SRC-10/15: last write wins per key, as a partial aggregate (safe for a hot key)."""
    rest = [c for c in df.columns if c not in keys]
    order = F.col(order) if isinstance(order, str) else order
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def missing_rows(history: DataFrame, stored: DataFrame, now: Column, hours: float = 6.0, on=("binding", "ts")) -> DataFrame:
    """SRC-04: rows of the last hours that the store lacks."""
    since = now - F.lit(int(hours * 60))
    recent = history.where(F.col("minute") >= since)
    return recent.join(stored.where(F.col("minute") >= since).select(*on), list(on), "left_anti")


def choose_layout(merged: DataFrame, default: DataFrame, keys: list[str], chunk_days: int = 30) -> DataFrame:
    """SRC-05: two source layouts (keys, ts, minute, value). Per series the layout whose first
    chunk comes earliest wins (merged on ties); then the last value per minute."""
    both = merged.withColumn("layout", F.lit(0)).unionByName(default.withColumn("layout", F.lit(1)))
    chunk = F.floor(F.col("minute") / (chunk_days * 1440))
    first = both.groupBy(*keys).agg(F.min(F.struct(chunk.alias("chunk"), "layout")).alias("_first"))
    kept = both.join(first, keys).where(F.col("layout") == F.col("_first.layout"))
    return kept.groupBy(*keys, "layout", "minute").agg(F.max_by("value", "ts").alias("value"))


def import_counts(history: DataFrame, bindings: DataFrame) -> DataFrame:
    """SRC-06: imported rows per binding, 0 for a silent one."""
    counts = history.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    return bindings.join(counts, "entity_id", "left").select("name", F.coalesce("n", F.lit(0)).alias("imported"))


def earliest_time(df: DataFrame, col: str = "minute") -> DataFrame:
    """SRC-07."""
    return df.agg(F.min(col).alias("earliest"))


def retention_floor(now: Column, days: int = 90) -> Column:
    """SRC-08: oldest minute an import may write (one hour of margin)."""
    return now - F.lit(days * 1440) + F.lit(60)


def keep_since(df: DataFrame, floor: Column, col: str = "minute") -> DataFrame:
    return df.where(F.col(col) >= floor)


def apply_retention(df: DataFrame, now: Column, days: int, col: str = "minute") -> DataFrame:
    """SRC-27: expire whole days; days ≤ 0 keeps everything."""
    if days <= 0:
        return df
    return df.where(F.floor(F.col(col) / 1440) >= F.floor(now / 1440) - F.lit(days))


def read_minutes(
    readings: DataFrame, keys: list[str], start: Column, end: Column, slow_days: int = 7, label: str = "start"
) -> DataFrame:
    """SRC-11: last value per minute and series; slow roles reach slow_days further back.

    label="stop" stamps a minute by its end, as stores that label intervals by their stop do.
    """
    begin = start - F.when(F.col("role").isin(SLOW_ROLES), F.lit(slow_days * 1440)).otherwise(F.lit(0))
    rows = readings.where((F.col("minute") >= begin) & (F.col("minute") < end))
    shift = F.lit(1 if label == "stop" else 0)
    return (
        rows.withColumn("minute", F.col("minute") + shift)
        .groupBy(*keys, "role", "room", "minute")
        .agg(F.max_by(F.struct("num", "str"), F.struct("ts", "write_seq")).alias("_v"))
        .select(*keys, "role", "room", "minute", "_v.num", "_v.str")
    )


def pivot_minutes(minutes: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """SRC-11 edge: one column per named binding (the list is known from the bindings)."""
    text = F.coalesce(F.col("str"), F.col("num").cast("string"))
    return minutes.groupBy(*keys, "minute").pivot("binding", names).agg(F.first(text, ignorenulls=True))


def write_features(feats: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SRC-12: partitioned by feature set, person bucket and date; only touched partitions are replaced."""
    (
        feats.withColumn("person_bucket", F.pmod(F.xxhash64("person"), F.lit(64)))
        .withColumn("date", F.to_date(F.timestamp_seconds(F.col("window_start") * 60)))
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("feature_set", "person_bucket", "date")
        .parquet(path)
    )


def read_features(store: DataFrame, person: str, feature_set: str, start, end) -> DataFrame:
    """SRC-13: the predicates on the partition columns prune files."""
    bucket = F.pmod(F.xxhash64(F.lit(person)), F.lit(64))
    rows = store.where((F.col("feature_set") == feature_set) & (F.col("person") == person))
    if "person_bucket" in store.columns:
        rows = rows.where(F.col("person_bucket") == bucket)
    return rows.where((F.col("window_start") >= start) & (F.col("window_start") < end))


def widen_features(long_feats: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """SRC-13 for a long store: feature → column, names given so no extra job runs."""
    return long_feats.groupBy(*keys).pivot("feature", names).agg(F.max("value"))


def last_feature_time(feats: DataFrame, keys=("person", "feature_set")) -> DataFrame:
    """SRC-14."""
    return feats.groupBy(*keys).agg(F.max("window_start").alias("last_window"))


def stored_set(pred_set: Column, predicted: Column) -> Column:
    """SRC-15: a prediction set is kept only when it says more than the top class."""
    return F.when(~((F.size(pred_set) == 1) & (pred_set[0] == predicted)), pred_set)


def read_labels(labels: DataFrame, start: Column, end: Column, by: str = "written") -> DataFrame:
    """SRC-17: the range is on the write time unless by="window"; optional fields get defaults."""
    col = "written_min" if by == "written" else "window_min"
    rows = labels.where((F.col(col) >= start) & (F.col(col) < end))
    return rows.withColumns(
        {"gold": F.coalesce("gold", F.lit(False)), "source": F.coalesce("source", F.lit("ui"))}
    )


def read_predictions(preds: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """SRC-18: one row per key, rows with a model field preferred, later write on ties."""
    pref = F.struct(F.col("model").isNotNull().alias("has_model"), F.col(seq).alias("seq"))
    return latest_write(preds, keys, pref)


def series_counts(readings: DataFrame, series: DataFrame, on: list[str], now: Column, days: int = 7) -> DataFrame:
    """SRC-19: rows per series in the last days, 0 for silent ones."""
    counts = readings.where(F.col("minute") > now - F.lit(days * 1440)).groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    return series.join(counts, on, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def total_count(readings: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """SRC-20."""
    return readings.where(F.col("minute") > now - F.lit(hours * 60)).agg(F.count(F.lit(1)).alias("n"))


def active_series(readings: DataFrame, on: list[str], now: Column, minutes: int = 15) -> DataFrame:
    """SRC-21."""
    return readings.where(F.col("minute") > now - F.lit(minutes)).select(*on).distinct()


def traces(readings: DataFrame, keys: list[str], start: Column, end: Column, buckets: int = 60) -> DataFrame:
    """SRC-22: mean per bucket of max(60 s, span div buckets); one ordered array per series."""
    every = F.greatest(F.lit(60), F.floor(F.greatest((end - start) * 60, F.lit(60)) / max(buckets, 1)))
    rows = readings.where((F.col("minute") >= start) & (F.col("minute") < end) & F.col("num").isNotNull())
    sec = F.unix_micros("ts")
    per = rows.groupBy(*keys, F.floor(sec / (every * 1000000)).alias("b")).agg(F.avg("num").alias("m"))
    # at most `buckets` + 1 entries per series
    return per.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("b", "m"))), lambda e: e["m"]).alias("trace")
    )


def heartbeat_gaps(beats: DataFrame, cadence_min: Column | int) -> DataFrame:
    """SRC-23: beats (job, minute) followed after more than twice the cadence; split by day."""
    from ..functions.segments import with_previous

    distinct = beats.select("job", "minute").distinct()
    prev = with_previous(distinct, ["job"], ["minute"], ["minute"], F.floor(F.col("minute") / 1440))
    gap = F.col("minute") - F.col("prev_minute")
    return prev.where(gap > 2 * F.lit(cadence_min)).select("job", "minute", gap.alias("gap_min"))


def without_person(df: DataFrame, person: str, col: str = "person") -> DataFrame:
    """SRC-24: everything but a person's rows; shared (NULL) rows stay."""
    return df.where(~F.col(col).eqNullSafe(F.lit(person)))


def purge_report(df: DataFrame, person: str, col: str = "person") -> DataFrame:
    hit = F.col(col).eqNullSafe(F.lit(person))
    return df.agg(F.count_if(hit).alias("removed"), F.count_if(~hit).alias("kept"))


def orphaned_persons(data: DataFrame, persons: DataFrame) -> DataFrame:
    """SRC-25: identities with data but no current person."""
    return data.select("person").distinct().join(
        persons.select(F.col("person_id").alias("person")), "person", "left_anti"
    )


def relink(df: DataFrame, current: str, old: str, col: str = "person") -> DataFrame:
    """SRC-26: move app rows onto the older identity; a clash keeps the old identity's row."""
    return df.withColumn(col, F.when(F.col(col) == current, old).otherwise(F.col(col)))


def source_profile(readings: DataFrame, dataset: str, series: str, now: Column) -> DataFrame:
    """SRC-28: series, rows of the last 24 h and earliest minute per dataset."""
    return readings.groupBy(dataset).agg(
        F.count_distinct(series).alias("series"),
        F.count_if(F.col("minute") > now - 1440).alias("points_24h"),
        F.min("minute").alias("earliest"),
    )


def parse_settings(settings: DataFrame, schema: str) -> DataFrame:
    """SRC-30: (key, value_json) rows with the JSON value read as the given type."""
    return settings.select("key", F.from_json("value_json", schema).alias("value"))


def newest_first(df: DataFrame, col: str) -> DataFrame:
    return df.orderBy(F.col(col).desc())


def per_person_latest(preds: DataFrame) -> DataFrame:
    """SRC-29: the row a sink publishes for each person."""
    return latest_write(preds, ["person"], F.col("w"))


