"""Summaries of activity timelines: budgets, rhythm, transitions, trends, body, household.

A timeline has one row per (person, w) where w is the window start in epoch minutes, so a
person's rows grow with elapsed time only and per-person windows stay small.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.cols import duration_text, local_ts

UNKNOWN = "unknown"
# A counter drop beyond this share is a reset; steps per active window.
RESET_DROP = 0.5
ACTIVE_AMOUNT = 100.0
TRUE_WORDS = ["on", "charging", "true", "1", "yes", "full"]


def basis_of(version: Column) -> Column:
    """SUM-04: fact, rule or model."""
    v = F.lower(F.coalesce(version, F.lit("")))
    return F.when(v.startswith("fact"), "fact").when(v.startswith("rules"), "rule").otherwise("model")


def state_of(smoothed: Column, predicted: Column) -> Column:
    blank = lambda c: F.when(c != "", c)
    return F.coalesce(blank(smoothed), blank(predicted), F.lit(UNKNOWN))


def prepare(rows: DataFrame, tz: str = "UTC") -> DataFrame:
    """Adds state, basis and local calendar parts."""
    local = local_ts(F.col("w"), tz)
    return rows.withColumns(
        {
            "state": state_of(F.col("smoothed"), F.col("predicted")),
            "basis": basis_of(F.col("model_version")),
            "date": F.to_date(local).cast("string"),
            "dow": F.weekday(local).cast("long"),
            "hour": F.hour(local).cast("long"),
        }
    )


def known(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("state") != UNKNOWN)


def time_budget(rows: DataFrame, keys: list[str], window_min: int = 30) -> DataFrame:
    """SUM-01: minutes per state (unknown is a state of its own row)."""
    return rows.groupBy(*keys, "state").agg((F.count(F.lit(1)) * float(window_min)).alias("minutes"))


def day_totals(rows: DataFrame, keys: list[str], window_min: int = 30) -> DataFrame:
    """SUM-02: per local date: minutes per state as a map, unknown, fact and inferred minutes."""
    w = float(window_min)
    per = rows.groupBy(*keys, "date", "state").agg(
        (F.count(F.lit(1)) * w).alias("m"), (F.count_if(F.col("basis") == "fact") * w).alias("f")
    )
    is_known = F.col("state") != UNKNOWN
    entry = F.when(is_known, F.struct("state", "m"))
    return per.groupBy(*keys, "date").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("totals"),
        F.sum(F.when(is_known, 0.0).otherwise(F.col("m"))).alias("unknown_min"),
        F.sum(F.when(is_known, F.col("f")).otherwise(0.0)).alias("fact_min"),
        F.sum(F.when(is_known, F.col("m") - F.col("f")).otherwise(0.0)).alias("inferred_min"),
    )


def coverage(rows: DataFrame, keys: list[str], window_min: int = 30) -> DataFrame:
    """SUM-03."""
    is_known = F.col("state") != UNKNOWN
    n, k = F.count(F.lit(1)), F.count_if(is_known)
    fact = F.count_if(is_known & (F.col("basis") == "fact"))
    return rows.groupBy(*keys).agg(
        (n * float(window_min)).alias("total_min"),
        (k * float(window_min)).alias("classified_min"),
        F.round(F.when(n > 0, k / n).otherwise(0.0), 4).alias("coverage"),
        F.round(F.when(k > 0, fact / k).otherwise(0.0), 4).alias("known_fraction"),
    )


def rhythm_grid(rows: DataFrame, keys: list[str], window_min: int = 30) -> DataFrame:
    """SUM-05: weekday × hour × state minutes."""
    return known(rows).groupBy(*keys, "dow", "hour", "state").agg((F.count(F.lit(1)) * float(window_min)).alias("minutes"))


def minutes_per_day(rows: DataFrame, keys: list[str], states: list[str], window_min: int = 30) -> DataFrame:
    """SUM-06: minutes of named states per local date."""
    return rows.where(F.col("state").isin(states)).groupBy(*keys, "date", "state").agg(
        (F.count(F.lit(1)) * float(window_min)).alias("minutes")
    )


def episodes(rows: DataFrame, keys: list[str], by: list[str] = ("state",), window_min: int = 30) -> DataFrame:
    """SEQ-01/02: maximal runs of the same `by` values on touching windows."""
    w = Window.partitionBy(*keys).orderBy("w")
    same = F.lag("w").over(w) + window_min == F.col("w")
    for c in by:
        same = same & (F.lag(c).over(w) == F.col(c))
    marked = rows.withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("long"))
    run = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*keys, "_run", *by).agg(
        F.min("w").alias("start"), (F.max("w") + window_min).alias("end"), F.count(F.lit(1)).alias("windows")
    ).drop("_run")


def today_segments(rows: DataFrame, keys: list[str], now: Column, tz: str = "UTC", window_min: int = 30) -> DataFrame:
    """SEQ-02: runs of (state, basis) on the local day of now."""
    today = F.to_date(local_ts(now, tz)).cast("string")
    shown = rows.where(F.col("date") == today).withColumn(
        "basis", F.when(F.col("state") == UNKNOWN, UNKNOWN).otherwise(F.col("basis"))
    )
    return episodes(shown, keys, ["state", "basis"], window_min)


def sessions(rows: DataFrame, keys: list[str], window_min: int = 30) -> DataFrame:
    """SUM-07: episode statistics per activity with its last window and basis."""
    ep = episodes(rows, keys, ["state"], window_min).where(F.col("state") != UNKNOWN)
    dur = (F.col("end") - F.col("start")).cast("double")
    stats = ep.groupBy(*keys, "state").agg(
        F.count(F.lit(1)).alias("episodes"),
        F.round(F.avg(dur), 1).alias("mean_min"),
        F.round(F.median(dur), 1).alias("median_min"),
        F.max(dur).alias("longest_min"),
    )
    last = known(rows).groupBy(*keys, "state").agg(F.max("w").alias("last_w"), F.max_by("basis", "w").alias("last_basis"))
    return stats.join(last, [*keys, "state"])


def regularity(rows: DataFrame, keys: list[str], sleep: str = "asleep", min_sleep_min: float = 180.0, tz: str = "UTC", window_min: int = 30) -> DataFrame:
    """SUM-08: wake and bed time averages and spreads; bed time counts from 18:00."""
    ep = episodes(rows, keys, ["state"], window_min)
    ep = ep.where((F.col("state") == sleep) & (F.col("end") - F.col("start") >= min_sleep_min))
    clock = lambda m: F.hour(local_ts(m, tz)) * 60 + F.minute(local_ts(m, tz))
    nights = ep.select(*keys, F.pmod(clock(F.col("start")) - 1080, F.lit(1440)).alias("bed"), clock(F.col("end")).alias("wake"))
    got = nights.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("nights"),
        F.avg("wake").alias("wa"), F.stddev_pop("wake").alias("ws"), F.avg("bed").alias("ba"), F.stddev_pop("bed").alias("bs"),
    )
    ok = F.col("nights") >= 2
    band = lambda s: F.when(s <= 20, "very regular").when(s <= 45, "fairly regular").when(s <= 90, "varies").otherwise("irregular")
    return got.select(
        *keys, "nights",
        F.when(ok, F.round("wa").cast("long")).alias("wake_avg_min"),
        F.when(ok, F.round("ws").cast("long")).alias("wake_spread_min"),
        F.when(ok, band(F.col("ws"))).alias("wake_band"),
        F.when(ok, F.round(F.pmod(F.col("ba") + 1080, F.lit(1440.0))).cast("long")).alias("bed_avg_min"),
        F.when(ok, F.round("bs").cast("long")).alias("bed_spread_min"),
        F.when(ok, band(F.col("bs"))).alias("bed_band"),
    )


def transitions(rows: DataFrame, keys: list[str], window_min: int = 30, top: int = 24) -> DataFrame:
    """SUM-09: changes between windows exactly one window apart; an unknown row breaks the chain."""
    w = Window.partitionBy(*keys).orderBy("w")
    pairs = rows.withColumns({"src": F.lag("state").over(w), "_pw": F.lag("w").over(w)}).where(
        (F.col("w") - F.col("_pw") == window_min)
        & (F.col("src") != UNKNOWN) & (F.col("state") != UNKNOWN) & (F.col("src") != F.col("state"))
    )
    counts = pairs.groupBy(*keys, "src", F.col("state").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    out = counts.withColumn("prob", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "src")), 4))
    rank = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "src", "dst")
    return out.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top)


def callouts(df: DataFrame, period_days: int = 7, min_delta: float = 20.0, min_pct: float = 0.25) -> DataFrame:
    """Notable moves from total minutes `recent` and `prior`; used by SUM-10 and SUM-14."""
    r, p = F.col("recent") / period_days, F.col("prior") / period_days
    delta = r - p
    direction = F.when(p == 0, "new").when(r == 0, "stopped").when(delta > 0, "up").otherwise("down")
    pct = F.when(p == 0, 1.0).when(r == 0, -1.0).otherwise(delta / F.when(p != 0, p))
    got = df.where(~((r == 0) & (p == 0))).withColumns({"direction": direction, "_pct": pct, "_delta": delta, "_r": r, "_p": p})
    sizeable = F.greatest("_r", "_p") >= min_delta
    moved = (F.abs("_delta") >= min_delta) & (F.abs("_pct") >= min_pct)
    keep = (F.col("direction").isin("new", "stopped") & sizeable) | moved
    return got.where(keep).select(
        *[c for c in df.columns if c not in ("recent", "prior")],
        F.round("_r", 1).alias("recent_avg_min"), F.round("_p", 1).alias("prior_avg_min"),
        F.round("_delta", 1).alias("delta_min"), F.round("_pct", 4).alias("pct"), "direction",
    )


def trends(rows: DataFrame, keys: list[str], now: Column, window_min: int = 30, period_days: int = 7, top: int = 6, **floors) -> DataFrame:
    """SUM-10: last period against the one before."""
    w, span = float(window_min), period_days * 1440
    recent = F.col("w") >= now - span
    prior = (F.col("w") >= now - 2 * span) & ~recent
    # the range goes to the scan; older rows are never read
    sums = known(rows).where(F.col("w") >= now - 2 * span).groupBy(*keys, F.col("state").alias("activity")).agg(
        (F.count_if(recent) * w).alias("recent"),
        (F.count_if(prior) * w).alias("prior"),
        (F.count_if(recent & (F.col("basis") == "fact")) * w).alias("_fact"),
    )
    share = F.when(F.col("recent") > 0, F.col("_fact") / F.col("recent")).otherwise(0.0)
    basis = F.when(share >= 0.8, "fact").when(share <= 0.05, "inferred").otherwise("mixed")
    got = callouts(sums.withColumn("basis", basis).drop("_fact"), period_days, **floors)
    rank = Window.partitionBy(*keys).orderBy(F.abs("delta_min").desc(), "activity")
    return got.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top)


# --- body counters (SUM-11..14) ------------------------------------------------------------


def counter_deltas(samples: DataFrame, keys: list[str], window_min: int = 30) -> DataFrame:
    """SUM-11: amount per window of a cumulative counter; the first window only seeds."""
    from .windows import bucket_last

    last = bucket_last(samples, keys, window_min, "value")
    prev = F.lag("value").over(Window.partitionBy(*keys).orderBy("bucket"))
    reset = F.col("value") < F.col("_p") - F.abs("_p") * RESET_DROP
    amount = F.when(reset, F.greatest(F.col("value"), F.lit(0.0))).otherwise(F.greatest(F.col("value") - F.col("_p"), F.lit(0.0)))
    return last.withColumn("_p", prev).where(F.col("_p").isNotNull()).select(*keys, "bucket", amount.alias("amount"))


def charging_windows(samples: DataFrame, keys: list[str], window_min: int = 30) -> DataFrame:
    """SUM-12: windows with a truthy charging sample; state is text or a number in text."""
    word = F.lower(F.trim("state"))
    on = F.coalesce(word.try_cast("double") > 0.5, F.lit(False)) | word.isin(TRUE_WORDS)
    b = F.col("minute") - F.pmod("minute", F.lit(window_min))
    return samples.where(on).select(*keys, b.alias("bucket")).distinct()


def primary_signal(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """First signal by name that mentions steps, else the first."""
    not_step = ~F.lower("signal").contains("step")
    return deltas.groupBy(*keys).agg(F.min_by("signal", F.struct(not_step, F.col("signal"))).alias("primary"))


def worn_deltas(samples: DataFrame, charging: DataFrame, keys: list[str], window_min: int = 30) -> DataFrame:
    d = counter_deltas(samples, [*keys, "signal"], window_min)
    return d.join(charging_windows(charging, keys, window_min), [*keys, "bucket"], "left_anti")


def body_summary(samples: DataFrame, charging: DataFrame, keys: list[str], now: Column, window_min: int = 30) -> DataFrame:
    """SUM-13: worn, charging, absent, active and sedentary minutes, coverage, primary total."""
    w = window_min
    d = worn_deltas(samples, charging, keys, w)
    prim = d.join(primary_signal(d, keys), keys)
    is_p = F.col("signal") == F.col("primary")
    per_bucket = prim.groupBy(*keys, "primary", "bucket").agg(F.max(F.when(is_p, F.col("amount"))).alias("amt"))
    worn = per_bucket.groupBy(*keys, "primary").agg(
        F.count(F.lit(1)).alias("worn_n"),
        F.min("bucket").alias("w0"),
        F.count_if(F.col("amt") >= ACTIVE_AMOUNT).alias("act"),
        F.count_if(F.col("amt") < ACTIVE_AMOUNT).alias("sed"),
        F.round(F.sum("amt"), 2).alias("primary_total"),
    )
    ch = charging_windows(charging, keys, w).groupBy(*keys).agg(
        F.count_if(F.col("bucket") < now).alias("charge_n"), F.min("bucket").alias("c0")
    )
    j = worn.join(ch, keys, "left")
    span = F.greatest(F.floor((now - F.least("w0", "c0")) / w), F.lit(0))
    charge = F.coalesce("charge_n", F.lit(0))
    return j.select(
        *keys, "primary", "primary_total",
        (F.col("worn_n") * w).alias("worn_min"), (charge * w).alias("charging_min"),
        (F.greatest(span - F.col("worn_n") - charge, F.lit(0)) * w).alias("absent_min"),
        F.round(F.when(span > 0, F.least(F.lit(1.0), F.col("worn_n") / span)).otherwise(0.0), 4).alias("coverage"),
        (F.col("act") * w).alias("active_min"), (F.col("sed") * w).alias("sedentary_min"),
    )


def body_days(samples: DataFrame, charging: DataFrame, keys: list[str], tz: str = "UTC", window_min: int = 30) -> DataFrame:
    """SUM-13: totals per local day and signal."""
    d = worn_deltas(samples, charging, keys, window_min)
    date = F.to_date(local_ts(F.col("bucket"), tz)).cast("string")
    return d.groupBy(*keys, date.alias("date"), "signal").agg(
        F.round(F.sum("amount"), 2).alias("total"), (F.count(F.lit(1)) * window_min).alias("covered_min")
    )


def body_by_activity(deltas: DataFrame, rows: DataFrame, keys: list[str], window_min: int = 30) -> DataFrame:
    """JON-05: primary amount during each activity."""
    prim = deltas.join(primary_signal(deltas, keys), keys).where(F.col("signal") == F.col("primary"))
    b = F.col("w") - F.pmod("w", F.lit(window_min))
    return known(rows).withColumn("bucket", b).join(prim, [*keys, "bucket"]).groupBy(*keys, "state").agg(
        F.round(F.sum("amount"), 2).alias("amount")
    )


def active_trends(samples: DataFrame, charging: DataFrame, keys: list[str], now: Column, period_days: int = 7, window_min: int = 30) -> DataFrame:
    """SUM-14: active and sedentary minutes, last period against the one before."""
    d = worn_deltas(samples, charging, keys, window_min)
    prim = d.join(primary_signal(d, keys), keys).where(F.col("signal") == F.col("primary"))
    kind = F.when(F.col("amount") >= ACTIVE_AMOUNT, "active").otherwise("sedentary")
    recent = F.col("bucket") >= now - period_days * 1440
    prior = (F.col("bucket") >= now - 2 * period_days * 1440) & ~recent
    sums = prim.groupBy(*keys, kind.alias("activity")).agg(
        (F.count_if(recent) * float(window_min)).alias("recent"), (F.count_if(prior) * float(window_min)).alias("prior")
    )
    return callouts(sums, period_days)


# --- household, footprint, rhythm (SUM-15..19) ---------------------------------------------


def household_pairs(rows: DataFrame, home: str = "home", window_min: int = 30) -> DataFrame:
    """JON-04: what two members of a home did in the same bucket; the earliest row of a bucket counts.

    Buckets hold one row per member, so a join group is as large as a household squared.
    """
    b = F.col("w") - F.pmod("w", F.lit(window_min))
    one = known(rows).groupBy(home, "person", b.alias("bucket")).agg(F.min_by("state", "w").alias("state"))
    a = one.select(home, "bucket", F.col("person").alias("person_a"), F.col("state").alias("a"))
    other = one.select(home, "bucket", F.col("person").alias("person_b"), F.col("state").alias("b"))
    return a.join(other, [home, "bucket"]).where(F.col("person_a") != F.col("person_b"))


def cooccurrence(pairs: DataFrame, window_min: int = 30, min_state_min: float = 60.0, top: int = 12) -> DataFrame:
    """SUM-15: per activity of a, what b did most often meanwhile and how often."""
    keys = ["person_a", "person_b"]
    counts = pairs.groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*keys, "a").agg(
        F.sum("n").alias("t"), F.max("n").alias("n"), F.min_by("b", F.struct((-F.col("n")).alias("neg"), "b")).alias("b")
    ).where(F.col("t") * window_min >= min_state_min)
    rank = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "a")
    return best.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top).select(
        *keys, "a", "b", (F.col("n") * float(window_min)).alias("minutes"), F.round(F.col("n") / F.col("t"), 4).alias("frac"), "rank"
    )


def consenting(rows: DataFrame, persons: DataFrame) -> DataFrame:
    """SUM-16: only people who opted in, before any household join."""
    ok = persons.where(F.col("enabled") & F.col("opted_in")).select(F.col("person_id").alias("person"))
    return rows.join(ok, "person", "left_semi")


def footprint(feats: DataFrame, keys: list[str], now: Column, days: int = 7) -> DataFrame:
    """SUM-17: mobility averages over active windows, labels and week-over-week shift."""
    active = feats.where(F.col("mob_rooms_active") > 0)
    end = lambda lo, hi: (F.col("window_start") >= now - lo * 1440) & (F.col("window_start") < now - hi * 1440)
    shown = F.col("window_start") >= now - days * 1440
    mean = lambda c, cond: F.avg(F.when(cond, F.col(c)))
    got = active.where(F.col("window_start") >= now - max(days, 14) * 1440).groupBy(*keys).agg(
        F.round(mean("mob_rooms_active", shown), 1).alias("rooms"),
        mean("mob_room_entropy", shown).alias("roaming"),
        mean("mob_room_switches", shown).alias("pacing"),
        F.count_if(shown).alias("windows"),
        (mean("mob_room_entropy", F.col("window_start") >= now - 7 * 1440) - mean("mob_room_entropy", end(14, 7))).alias("_d"),
    )
    pacing = F.when(F.col("pacing") < 1, "calm").when(F.col("pacing") < 4, "some moving about").otherwise("lots of moving about")
    trend = F.when(F.abs("_d") >= 0.12, F.when(F.col("_d") > 0, "roaming more than last week").otherwise("more settled than last week"))
    return got.where(F.col("windows") > 0).select(
        *keys, "rooms", "roaming", "pacing", pacing.alias("pacing_label"), trend.alias("trend"), "windows"
    )


def hourly_counts(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Zero-filled hours between a key's first and last activity (through the hour the last one ends in)."""
    h = F.floor(F.col("w") / 60)
    per = rows.groupBy(*keys, h.alias("h")).agg(F.sum(value).cast("double").alias("x"))
    span = per.groupBy(*keys).agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    full = span.select(*keys, F.explode(F.sequence("lo", "hi")).alias("h"))
    return full.join(per, [*keys, "h"], "left").fillna(0.0, subset=["x"])


def autocorrelation(hours: DataFrame, keys: list[str], lags: dict[str, int]) -> DataFrame:
    """SUM-18: correlation of the hourly series with itself at each lag."""
    w = Window.partitionBy(*keys).orderBy("h")
    shifted = hours.withColumns({f"_{n}": F.lag("x", k).over(w) for n, k in lags.items()})
    agg = []
    for n in lags:
        both = F.col(f"_{n}").isNotNull()
        a, b = F.when(both, F.col(f"_{n}")), F.when(both, F.col("x"))
        flat = (F.stddev_pop(a) < 1e-9) | (F.stddev_pop(b) < 1e-9)
        agg.append(F.when(flat, 0.0).otherwise(F.corr(a, b)).alias(n))
    return shifted.groupBy(*keys).agg(F.count(F.lit(1)).alias("hours"), *agg).where(F.col("hours") >= 48)


def dominant_period(hours: DataFrame, keys: list[str]) -> DataFrame:
    """SUM-19: strongest period in hours by the power spectrum; hours per key are few thousand at most."""

    @pandas_udf("double")
    def peak(xs: pd.Series) -> pd.Series:
        import numpy as np

        def one(x):
            x = np.asarray(x, dtype=float)
            n = len(x)
            if n < 8:
                return None
            power = np.abs(np.fft.rfft(x - x.mean())) ** 2
            power[: 2] = 0.0  # constant part and periods longer than half the series
            k = int(power.argmax())
            return n / k if power[k] > 0 else None

        return xs.map(one).astype("float64")

    series = hours.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("h", "x"))), lambda e: e["x"]).alias("xs")
    )
    return series.select(*keys, F.size("xs").cast("long").alias("hours"), F.round(peak("xs"), 4).alias("period_h"))


# --- reports ---------------------------------------------------------------------------------


def digest(budget: DataFrame, per_day: DataFrame, cover: DataFrame, keys: list[str]) -> DataFrame:
    """SUM-37: the facts of the weekly message as text."""
    w = Window.partitionBy(*keys).orderBy(F.col("minutes").desc(), "state")
    top = known(budget).withColumn("_r", F.row_number().over(w)).where("_r <= 3")
    line = top.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "state", "minutes"))),
                                 lambda e: F.concat_ws(" ", e["state"], duration_text(e["minutes"]))), ", ").alias("mostly")
    )
    week = per_day.groupBy(*keys).agg(
        duration_text(F.sum(F.when(F.col("state") == "asleep", F.col("minutes"))) / 7).alias("slept"),
        duration_text(F.sum(F.when(F.col("state") == "away", F.col("minutes"))) / 7).alias("out"),
    )
    pct = F.round(F.col("coverage") * 100).cast("long")
    return line.join(week, keys, "left").join(cover, keys).select(*keys, "mostly", "slept", "out", pct.alias("coverage_pct"))


def heat_map(rhythm: DataFrame, keys: list[str], span: int = 1) -> DataFrame:
    """SUM-38: dominant activity and intensity per weekday × hour block."""
    block = F.floor(F.col("hour") / span)
    cells = rhythm.groupBy(*keys, "dow", block.alias("block"), "state").agg(F.sum("minutes").alias("m"))
    dom = cells.groupBy(*keys, "dow", "block").agg(
        F.min_by("state", F.struct((-F.col("m")).alias("neg"), "state")).alias("dominant"), F.sum("m").alias("minutes")
    )
    peak = F.max("minutes").over(Window.partitionBy(*keys))
    return dom.withColumn("intensity", F.round(F.lit(0.25) + 0.75 * F.col("minutes") / F.greatest(peak, F.lit(1.0)), 4))


def hour_majority(rows: DataFrame, keys: list[str]) -> DataFrame:
    """SUM-43: most frequent activity per local day and hour."""
    per = rows.groupBy(*keys, "date", "hour", "state").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*keys, "date", "hour").agg(F.min_by("state", F.struct((-F.col("n")).alias("neg"), "state")).alias("state"))


def week_mix(rows: DataFrame, keys: list[str], days: int = 7, window_min: int = 30) -> DataFrame:
    """SUM-38: share of classified time and hours per day by activity."""
    b = known(rows).groupBy(*keys, "state").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    return b.select(*keys, "state", F.round(share, 4).alias("share"), F.round(F.col("n") * window_min / 60.0 / days, 2).alias("hours_per_day"))
