"""Column helpers: time buckets, text normalisation, probability maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MIN = 1440


def r6(c) -> Column:
    return F.round(c, 6)


def epoch_minute(ts) -> Column:
    """Whole minutes since the epoch of a timestamp column."""
    return F.expr(f"unix_micros({ts}) div 60000000") if isinstance(ts, str) else F.floor(F.unix_micros(ts) / 60000000)


def minute_to_ts(c) -> Column:
    return F.timestamp_seconds(c * 60)


def floor_to(c, step) -> Column:
    """Floor a non-negative integer column to a multiple of step."""
    return c - F.pmod(c, F.lit(step))


def local_ts(minute, tz: str = "UTC") -> Column:
    return F.from_utc_timestamp(F.timestamp_seconds(minute * 60), tz)


def part_of_day(hour) -> Column:
    """0 night, 1 morning, 2 afternoon, 3 evening."""
    return (
        F.when((hour < 5) | (hour >= 22), 0).when(hour < 11, 1).when(hour < 17, 2).otherwise(3).cast("double")
    )


def time_columns(minute, granularity: str = "coarse", tz: str = "UTC") -> dict[str, Column]:
    local = local_ts(minute, tz)
    weekend = (F.weekday(local) >= 5).cast("double")
    if granularity == "none":
        return {}
    if granularity == "full":
        return {
            "hour_of_day": F.hour(local).cast("double"),
            "day_of_week": F.weekday(local).cast("double"),
            "is_weekend": weekend,
        }
    return {"time_bucket": part_of_day(F.hour(local)), "is_weekend": weekend}


def day_bounds_utc(now_ts, tz: str, days_back: int = 1) -> tuple[Column, Column]:
    """[start, end) of a local calendar day as UTC instants; right across DST changes."""
    local_midnight = F.date_trunc("day", F.from_utc_timestamp(now_ts, tz))
    start = local_midnight - F.make_interval(days=F.lit(days_back))
    end = local_midnight - F.make_interval(days=F.lit(days_back - 1))
    return F.to_utc_timestamp(start, tz), F.to_utc_timestamp(end, tz)


def tokens(c) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: t != ""))


def slugify(c) -> Column:
    """Object part of an entity id, lower case, other characters folded to single underscores."""
    tail = F.element_at(F.split(c, r"\."), -1)
    return F.regexp_replace(F.regexp_replace(F.lower(tail), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def room_key(c) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def duration_text(minutes) -> Column:
    """Minutes as 2h30m / 2h / 45m."""
    total = F.round(minutes).cast("long")
    h, m = F.floor(total / 60), total % 60
    return (
        F.when(h == 0, F.concat(m.cast("string"), F.lit("m")))
        .when(m == 0, F.concat(h.cast("string"), F.lit("h")))
        .otherwise(F.concat(h.cast("string"), F.lit("h"), m.cast("string"), F.lit("m")))
    )


def map_total(m) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0.0), lambda a, v: a + v)


def map_renormalise(m) -> Column:
    total = map_total(m)
    return F.when(total > 0, F.transform_values(m, lambda k, v: v / total)).otherwise(m)


def ranked_entries(m) -> Column:
    """Map entries, most probable first, ties by key."""
    entries = F.transform(F.map_entries(m), lambda e: F.struct((-e["value"]).alias("neg"), e["key"].alias("k")))
    return F.transform(F.array_sort(entries), lambda e: F.struct(e["k"].alias("k"), (-e["neg"]).alias("p")))


def map_argmax(m) -> Column:
    return F.element_at(ranked_entries(m), 1)["k"]


def map_text(m, digits: int = 6) -> Column:
    """Stable text of a number map, keys in order; for reports and comparisons."""
    entries = F.array_sort(F.map_entries(m))
    return F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.format_string(f"%.{digits}f", e["value"]))), ","
    )
