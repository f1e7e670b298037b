"""Minute grid, validity intervals and window formation.

A reading is valid from its minute until the next reading of its series, its role's
fill limit, or the end of the frame. Window features are weighted aggregates over
interval ∩ window, so no dense minute grid is ever built.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cols import time_columns


@dataclass(frozen=True)
class Recipe:
    fill_min: int  # carry a value at most this long
    absence: float  # value of an absent sensor
    suffixes: tuple[str, ...]
    window_min: int = 30  # look-back from the shared window end
    slow: bool = False


# What every role is read with.
RECIPES = {
    "presence": Recipe(5, 0.0, ("frac", "any", "transitions"), 15),
    "bed": Recipe(10, -1.0, ("mean", "max", "occupied")),
    "power": Recipe(10, 0.0, ("on", "max_w")),
    "light": Recipe(240, 0.0, ("on_last", "on_frac")),
    "media": Recipe(5, 0.0, ("playing", "paused", "active"), 15),
    "env": Recipe(120, 0.0, ("mean", "delta", "max"), 60),
    "person": Recipe(10080, -1.0, ("home_last", "home_frac"), slow=True),
    "focus": Recipe(10, 0.0, ("on_last",)),
    "alarm_time": Recipe(10080, 0.0, ("minutes_until", "imminent"), slow=True),
    "door": Recipe(0, 0.0, ("opened_any", "open_count")),
    "steps": Recipe(30, 0.0, ("delta",), 180),
    "battery": Recipe(120, 0.0, ("delta",), 180),
    "custom": Recipe(30, 0.0, ("mean", "max", "delta")),
}
EVENT_ROLES = ["presence", "door", "media"]
WIDTH = 30


def role_value(role: Column, field: str) -> Column:
    pairs = [F.lit(x) for r, rec in RECIPES.items() for x in (r, getattr(rec, field))]
    return F.create_map(*pairs)[role]


def minute_last(readings: DataFrame, keys: list[str]) -> DataFrame:
    """WIN-01: last non-null value per series and minute."""
    rows = readings.where(F.col("num").isNotNull() | F.col("str").isNotNull())
    return (
        rows.groupBy(*keys, "role", "room", "minute")
        .agg(F.max_by(F.struct("num", "str"), F.struct("ts", "write_seq")).alias("_v"))
        .select(*keys, "role", "room", "minute", "_v.num", "_v.str")
    )


def intervals(minutes: DataFrame, frame: list[str], series: list[str]) -> DataFrame:
    """WIN-02: validity intervals [from_min, to_min) plus the previous interval's value and end.

    The frame ends at the last minute over all series of the frame key. A series has at
    most one row per minute here, whatever its raw rate, so its window stays small.
    """
    ends = minutes.groupBy(*frame).agg((F.max("minute") + 1).alias("frame_stop"))
    w = Window.partitionBy(*series).orderBy("minute")
    limit = role_value(F.col("role"), "fill_min")
    rows = minutes.withColumn("_next", F.lead("minute").over(w)).join(ends, frame)
    out = rows.select(
        *dict.fromkeys([*frame, *series]),
        "role",
        "room",
        F.col("minute").alias("from_min"),
        F.least(F.col("minute") + 1 + limit, F.col("_next"), F.col("frame_stop")).alias("to_min"),
        "num",
        "str",
        "frame_stop",
    )
    w2 = Window.partitionBy(*series).orderBy("from_min")
    return out.withColumns(
        {"prev_num": F.lag("num").over(w2), "prev_str": F.lag("str").over(w2), "prev_to": F.lag("to_min").over(w2)}
    )


def grid_of(start: Column, end: Column, stride: int, width: int = WIDTH) -> Column:
    """WIN-03: window starts aligned to the stride, first ≥ start, whole window before end."""
    first = F.ceil(start / stride) * stride
    last = F.floor((end - width) / stride) * stride
    return F.when(first <= last, F.sequence(first, last, F.lit(stride).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def window_grid(bounds: DataFrame, keys: list[str], stride: int = WIDTH, width: int = WIDTH) -> DataFrame:
    """bounds: (keys, start, end) in minutes → one row per window start."""
    return bounds.select(*keys, F.explode(grid_of(F.col("start"), F.col("end"), stride, width)).alias("window_start"))


def data_bounds(minutes: DataFrame, keys: list[str], width: int = WIDTH) -> DataFrame:
    lo, hi = F.min("minute"), F.max("minute")
    return minutes.groupBy(*keys).agg(
        (lo - F.pmod(lo, F.lit(width))).alias("start"), (hi - F.pmod(hi, F.lit(width)) + width).alias("end")
    )


def to_windows(iv: DataFrame, stride: int = WIDTH, lookback: Column | int | None = None, width: int = WIDTH) -> DataFrame:
    """WIN-04..06: every interval copied to the window ends its look-back reaches.

    Adds window_start, lo (look-back start), a, b (overlap), n minutes and whether the previous
    interval of the series reaches into the same look-back (prev_in).
    """
    look = role_value(F.col("role"), "window_min") if lookback is None else (
        F.lit(lookback) if isinstance(lookback, int) else lookback
    )
    frame_last = F.floor((F.col("frame_stop") - 1) / width) * width + width
    first = F.floor(F.col("from_min") / stride) * stride + stride
    last = F.least(F.floor((F.col("to_min") + look - 1) / stride) * stride, frame_last)
    # a window needs its full width after the grid start: ends below one width are cut by the grid join
    rows = iv.withColumns({"_l": look, "_f": first, "_t": last}).where("_f <= _t")
    out = rows.withColumn("we", F.explode(F.sequence("_f", "_t", F.lit(stride).cast("long"))))
    lo = F.col("we") - F.col("_l")
    a, b = F.greatest("from_min", lo), F.least("to_min", "we")
    return out.withColumns(
        {
            "window_start": F.col("we") - width,
            "lo": lo,
            "a": a,
            "n": b - a,
            "prev_in": F.coalesce(F.col("prev_to") > lo, F.lit(False)),
        }
    ).drop("_l", "_f", "_t")


def since_high_water(readings: DataFrame, feats: DataFrame, keys: list[str], now: Column, step: int = 5, back: int = 120, preroll: int = 180) -> DataFrame:
    """WIN-07/08: raw rows an incremental build needs, with the first window start to emit.

    Start = last feature + step, else now − back; raw is read preroll minutes earlier.
    """
    marks = feats.groupBy(*keys).agg(F.max("window_start").alias("_mark"))
    rows = readings.join(marks, keys, "left")
    start = F.coalesce(F.col("_mark") + step, now - back)
    return rows.withColumn("emit_from", start).where(F.col("minute") >= start - preroll).drop("_mark")


def needs_rebuild(have: DataFrame, models: DataFrame, keys: list[str], need: int = 100) -> DataFrame:
    """WIN-09: keys below the minimum number of windows that own a promoted model."""
    promoted = models.where("promoted").select(*keys).distinct()
    return have.where(F.col("windows") < need).join(promoted, keys, "left_semi")


def rebuild_chunks(keys_df: DataFrame, keys: list[str], start: Column, end: Column, chunk_days: int = 7) -> DataFrame:
    step = chunk_days * 1440
    begins = F.sequence(start, end - 1, F.lit(step).cast("long"))
    return keys_df.select(*keys, F.explode(begins).alias("chunk_start"), end.alias("_e")).select(
        *keys, "chunk_start", F.least(F.col("chunk_start") + step, "_e").alias("chunk_end")
    )


def current_window(now: Column, grid_min: int = 5, width: int = WIDTH) -> tuple[Column, Column]:
    """WIN-10: (start, end) of the window ending now, on the five-minute grid."""
    end = now - F.pmod(now, F.lit(grid_min))
    return end - width, end


def with_time_features(df: DataFrame, granularity: str = "coarse", tz: str = "UTC", col: str = "window_start") -> DataFrame:
    """WIN-11/12."""
    return df.withColumns(time_columns(F.col(col), granularity, tz))


def feature_set_version(composites=(), granularity: str = "coarse", spec=(), version: str = "1") -> str:
    """WIN-13: short hash of everything that shapes the columns; the partition key of the store."""
    import hashlib

    config = {
        "version": version,
        "time": granularity,
        "recipes": {r: [rec.fill_min, rec.absence, list(rec.suffixes), rec.window_min, rec.slow] for r, rec in RECIPES.items()},
        "composites": list(composites),
        "spec": list(spec),
    }
    return "v" + hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:10]


def bucket_last(samples: DataFrame, keys: list[str], minutes: int, value: str) -> DataFrame:
    """WIN-14: last sample per N-minute bucket."""
    b = F.col("minute") - F.pmod("minute", F.lit(minutes))
    return samples.groupBy(*keys, b.alias("bucket")).agg(F.max_by(value, "ts").alias(value))
