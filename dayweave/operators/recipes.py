"""Per-window features: role recipes, named transforms, event dynamics, mobility, imputation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import with_composites
from ..functions.segments import last_known
from ..session import materialise
from .windows import EVENT_ROLES, RECIPES, WIDTH, with_time_features

IDLE_CAP = 240


def _num(c) -> Column:
    return c.cast("double")


def window_stats(win: DataFrame, keys: list[str]) -> DataFrame:
    """One partial-aggregated row per (keys, window): every number the recipes need."""
    num, text, n = F.col("num"), F.col("str"), F.col("n")
    on = num > 0
    fresh = ~F.col("prev_in")
    prev_on = F.col("prev_num") > 0
    home = text == "home"
    return win.groupBy(*keys, "role", "window_start").agg(
        F.sum("n").alias("minutes"),
        F.sum(num * n).alias("weighted"),
        F.max("num").alias("vmax"),
        F.min("num").alias("vmin"),
        F.min_by("num", "a").alias("first"),
        F.max_by("num", "a").alias("last"),
        F.max_by("str", "a").alias("last_str"),
        F.sum(F.when(on, n).otherwise(0)).alias("on_minutes"),
        F.sum((F.col("prev_in") & (on != prev_on)).cast("long")).alias("flips"),
        F.sum((on & (fresh | ~prev_on)).cast("long")).alias("rises"),
        F.sum(F.when(home, n).otherwise(0)).alias("home_minutes"),
        F.max(_num(text == "playing")).alias("any_playing"),
        F.max(_num(text == "paused")).alias("any_paused"),
        F.bool_and(text.try_cast("double").isNotNull()).alias("text_numeric"),
        F.max(_num(text.try_cast("double") > 0)).alias("text_positive"),
    )


def recipe_columns(tz: str = "UTC", bed_threshold: float = 1.5, power_on: float = 10.0, imminent: float = 40.0) -> dict[str, dict[str, Column]]:
    """AGG-01..13: role → suffix → column over window_stats."""
    c = F.col
    frac = lambda x: c(x) / c("minutes")
    mean, delta = frac("weighted"), c("last") - c("first")
    two = c("minutes") >= 2
    clock = F.split(F.element_at(F.split("last_str", " "), -1), ":")
    alarm = F.get(clock, F.lit(0)).try_cast("int") * 60 + F.get(clock, F.lit(1)).try_cast("int")
    end_local = F.from_utc_timestamp(F.timestamp_seconds((c("window_start") + WIDTH) * 60), tz)
    now = F.hour(end_local) * 60 + F.minute(end_local)
    until = F.pmod(alarm - now + 720, F.lit(1440)) - 720
    playing = F.when(c("text_numeric"), c("text_positive")).otherwise(c("any_playing"))
    return {
        "presence": {"frac": frac("on_minutes"), "any": _num(c("on_minutes") > 0), "transitions": _num(c("flips"))},
        "bed": {"mean": mean, "max": c("vmax"), "occupied": _num(c("vmax") > bed_threshold)},
        "power": {"on": _num(c("vmax") > power_on), "max_w": c("vmax")},
        "light": {"on_last": _num(c("last") > 0), "on_frac": frac("on_minutes")},
        "media": {
            "playing": playing,
            "paused": F.when(c("text_numeric"), 0.0).otherwise(c("any_paused")),
            "active": F.when(c("text_numeric"), c("text_positive")).otherwise(F.greatest("any_playing", "any_paused")),
        },
        "env": {"mean": mean, "delta": delta, "max": c("vmax")},
        "person": {"home_last": _num(c("last_str") == "home"), "home_frac": frac("home_minutes")},
        "focus": {"on_last": _num(c("last") > 0)},
        "alarm_time": {"minutes_until": _num(until), "imminent": _num((until >= -10) & (until <= imminent))},
        "door": {"opened_any": _num(c("on_minutes") > 0), "open_count": _num(c("rises"))},
        "steps": {"delta": F.when(two, F.greatest(delta, F.lit(0.0)))},
        "battery": {"delta": F.when(two, delta)},
        "custom": {"mean": mean, "max": c("vmax"), "delta": delta},
    }


def recipe_features(stats: DataFrame, role: str, keys: list[str], **options) -> DataFrame:
    """The recipe of one role, one column per suffix."""
    cols = recipe_columns(**options)[role]
    return stats.where(F.col("role") == role).select(*keys, "window_start", *[v.alias(k) for k, v in cols.items()])


def long_features(stats: DataFrame, keys: list[str], **options) -> DataFrame:
    """All recipes at once: (keys, window_start, feature = binding_suffix, value)."""
    per_role = F
    for role, cols in recipe_columns(**options).items():
        rows = F.array(*[F.struct(F.lit(s).alias("suffix"), v.cast("double").alias("value")) for s, v in cols.items()])
        per_role = per_role.when(F.col("role") == role, rows)
    got = stats.select(*keys, "window_start", F.explode(per_role).alias("f"))
    return got.select(
        *keys, "window_start", F.concat_ws("_", "binding", "f.suffix").alias("feature"), F.col("f.value").alias("value")
    )


# --- named transforms (AGG-14..25) -------------------------------------------------------


def transform_stats(win: DataFrame, keys: list[str]) -> DataFrame:
    """Aggregates behind the named transforms; state is the reading as text or number."""
    num, n = F.col("num"), F.col("n")
    same = F.col("num").eqNullSafe(F.col("prev_num")) & F.col("str").eqNullSafe(F.col("prev_str"))
    changed = F.col("prev_in") & ~same
    # exact integer sums of sample positions: pos is the running minute count of the series
    x0 = F.col("pos") + (F.col("a") - F.col("from_min"))
    sx = n * x0 + n * (n - 1) / 2
    sxx = n * x0 * x0 + x0 * n * (n - 1) + (n - 1) * n * (2 * n - 1) / 6
    return win.groupBy(*keys, "window_start", "we").agg(
        F.sum("n").alias("minutes"),
        F.sum(F.when(num.isNotNull(), n).otherwise(0)).alias("num_minutes"),
        F.sum(num * n).alias("weighted"),
        F.max("num").alias("vmax"),
        F.min("num").alias("vmin"),
        F.min_by("num", "a").alias("first"),
        F.max_by("num", "a").alias("last"),
        F.min("a").alias("first_min"),
        F.max(F.col("a") + n - 1).alias("last_min"),
        F.sum(F.when(num > 0.5, n).otherwise(0)).alias("on_minutes"),
        F.sum(changed.cast("long")).alias("changes"),
        F.max(F.when(changed, F.col("a"))).alias("last_change"),
        F.sum(sx.cast("long")).alias("sx"),
        F.sum(sxx.cast("long")).alias("sxx"),
        F.sum(num * sx).alias("sxy"),
        F.max_by(F.coalesce("str", F.col("num").cast("string")), "a").alias("last_state"),
    )


def with_positions(iv: DataFrame, series: list[str]) -> DataFrame:
    """Running number of valid minutes before each interval of a series."""
    w = Window.partitionBy(*series).orderBy("from_min").rowsBetween(Window.unboundedPreceding, -1)
    return iv.withColumn("pos", F.coalesce(F.sum(F.col("to_min") - F.col("from_min")).over(w), F.lit(0)))


def transform_columns(cap_min: float = 240.0) -> dict[str, Column]:
    c = F.col
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    n = c("num_minutes")
    delta = c("last") - c("first")
    span = (c("last_min") - c("first_min")).cast("double")
    den = n * c("sxx") - c("sx") * c("sx")
    since = c("we") - F.coalesce("last_change", "first_min")
    return {
        "occupancy_fraction": zero(c("on_minutes") / n),
        "any_active": _num(c("on_minutes") > 0),
        "transition_count": _num(c("changes")),
        "time_since_last_change": F.when(c("minutes") < 2, cap_min).otherwise(F.least(F.greatest(since, F.lit(0)), F.lit(cap_min)).cast("double")),
        "window_mean": zero(c("weighted") / n),
        "window_max": zero(c("vmax")),
        "window_minimum": zero(c("vmin")),
        "window_delta": zero(delta),
        "window_slope": F.when((n >= 2) & (den > 0), (n * c("sxy") - c("sx") * c("weighted")) / den).otherwise(0.0),
        "counter_rate": F.when((n >= 2) & (delta >= 0) & (span > 0), delta / span).otherwise(0.0),
    }


def state_dwell(win: DataFrame, keys: list[str], state: str) -> DataFrame:
    """AGG-22: share of valid minutes in a state."""
    return win.groupBy(*keys, "window_start").agg(
        (F.sum(F.when(F.col("str") == state, F.col("n")).otherwise(0)) / F.sum("n")).alias("dwell")
    )


def longest_on_run(win: DataFrame, keys: list[str], series: list[str]) -> DataFrame:
    """AGG-17: longest on-run in minutes; NULL minutes are skipped, off intervals break a run.

    win must carry run_id (see with_run_ids), so only sums remain per window."""
    runs = win.groupBy(*keys, "window_start", "run_id").agg(
        F.sum(F.when(F.col("num") > 0.5, F.col("n")).otherwise(0)).alias("r")
    )
    return runs.groupBy(*keys, "window_start").agg(F.max("r").cast("double").alias("run_length_on"))


def with_run_ids(iv: DataFrame, series: list[str]) -> DataFrame:
    w = Window.partitionBy(*series).orderBy("from_min").rowsBetween(Window.unboundedPreceding, 0)
    off = ~F.coalesce(F.col("num") > 0.5, F.lit(False))
    return iv.withColumn("run_id", F.sum(off.cast("long")).over(w))


def one_hot_state(stats: DataFrame, keys: list[str], states: list[str]) -> DataFrame:
    """AGG-23/24: state at the window end and one 0/1 column per named state."""
    return stats.select(
        *keys, "window_start", "last_state", *[_num(F.col("last_state") == s).alias(f"is_{s}") for s in states]
    )


def baseline_deviation(values: DataFrame, keys: list[str], days: int, value: str = "value") -> DataFrame:
    """AGG-25: value minus the mean of the same half hour over the days before."""
    slot, day = F.pmod("window_start", F.lit(1440)), F.floor(F.col("window_start") / 1440)
    w = Window.partitionBy(*keys, "_slot").orderBy("_day").rangeBetween(-days, -1)
    return (
        values.withColumns({"_slot": slot, "_day": day})
        .withColumn("deviation", F.col(value) - F.avg(value).over(w))
        .drop("_slot", "_day")
    )


def sequence_within(firsts: dict[str, Column], max_gap: int) -> Column:
    """AGG-26: all inputs fired, in the given order, each within max_gap minutes of the one before."""
    steps = list(firsts.values())
    ok = F.lit(True)
    for a, b in zip(steps, steps[1:]):
        ok = ok & (b >= a) & (b - a <= max_gap)
    return F.coalesce(ok, F.lit(False)).cast("double")


def co_occurrence_and(cols: list[Column], threshold: float = 0.5) -> Column:
    """AGG-28."""
    hits = [F.coalesce(c, F.lit(0.0)) >= threshold for c in cols]
    return _num(_all(hits)) if hits else F.lit(0.0)


def co_occurrence_count(cols: list[Column]) -> Column:
    return sum((_num(F.coalesce(c, F.lit(0.0)) > 0) for c in cols), F.lit(0.0))


def absence_and(cols: list[Column]) -> Column:
    hits = [F.coalesce(c, F.lit(0.0)) < 0.5 for c in cols]
    return _num(_all(hits)) if hits else F.lit(0.0)


def _all(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def build_spec(iv: DataFrame, spec: list[dict], keys: list[str], stride: int = WIDTH) -> tuple[DataFrame, list[tuple[str, str]]]:
    """AGG-29: validated definitions → one column each; definitions without an executor are returned.

    Definitions are grouped by look-back: one explode and one aggregate per distinct look-back.
    spec items: name, transform, inputs, params, window_min. Composites read earlier outputs.
    """
    from .windows import to_windows

    combos = {
        "co_occurrence_and": lambda cols, p: co_occurrence_and(cols, float(p.get("threshold", 0.5))),
        "co_occurrence_count": lambda cols, p: co_occurrence_count(cols),
        "absence_and": lambda cols, p: absence_and(cols),
    }
    entity = set(transform_columns()) | {"home_fraction", "run_length_on", "state_dwell_fraction"}
    skipped = [(d["name"], f"no executor for {d['transform']}") for d in spec if d["transform"] not in entity | set(combos)]
    singles = [d for d in spec if d["transform"] in entity]
    series = [*keys, "binding"]
    wanted = iv.where(F.col("binding").isin(sorted({d["inputs"][0] for d in singles})))
    prepared = with_run_ids(with_positions(wanted, series), series)
    out = None
    for look in sorted({d.get("window_min") or WIDTH for d in singles}):
        group = [d for d in singles if (d.get("window_min") or WIDTH) == look]
        win = to_windows(prepared, stride, look)
        stats = transform_stats(win, series)
        if any(d["transform"] == "run_length_on" for d in group):
            stats = stats.join(longest_on_run(win, series, series), [*series, "window_start"])
        if any(d["transform"] == "state_dwell_fraction" for d in group):
            for i, state in enumerate(sorted({d["params"]["state"] for d in group if d["transform"] == "state_dwell_fraction"})):
                dw = state_dwell(win, series, state).withColumnRenamed("dwell", f"_dwell_{state}")
                stats = stats.join(dw, [*series, "window_start"])
        aggs = []
        for d in group:
            p = d.get("params") or {}
            if d["transform"] == "run_length_on":
                col = F.col("run_length_on")
            elif d["transform"] == "state_dwell_fraction":
                col = F.col(f"_dwell_{p['state']}")
            else:
                name = "occupancy_fraction" if d["transform"] == "home_fraction" else d["transform"]
                col = transform_columns(float(p.get("cap_min", 240)))[name]
            aggs.append(F.max(F.when(F.col("binding") == d["inputs"][0], col)).alias(d["name"]))
        part = stats.groupBy(*keys, "window_start").agg(*aggs)
        out = part if out is None else out.join(part, [*keys, "window_start"], "full_outer")
    caps = {d["name"]: float((d.get("params") or {}).get("cap_min", 240)) for d in singles if d["transform"] == "time_since_last_change"}
    out = out.fillna({d["name"]: caps.get(d["name"], 0.0) for d in singles})
    for d in spec:
        if d["transform"] in combos:
            known = [F.col(i) if i in out.columns else F.lit(0.0) for i in d["inputs"]]
            out = out.withColumn(d["name"], combos[d["transform"]](known, d.get("params") or {}))
    return out, skipped


# --- event dynamics and mobility (AGG-30..33) --------------------------------------------


def change_rows(iv: DataFrame) -> DataFrame:
    """Minutes at which a direct sensor moved by more than 0.5 against the minute before."""
    touched = F.col("prev_to") == F.col("from_min")
    moved = F.abs(F.col("num") - F.col("prev_num")) > 0.5
    return iv.where(F.col("role").isin(EVENT_ROLES) & F.col("num").isNotNull() & touched & moved).withColumn(
        "minute", F.col("from_min")
    )


def event_dynamics(changes: DataFrame, keys: list[str], width: int = WIDTH) -> DataFrame:
    """AGG-30: events, active sensors and share of the busiest sensor per window."""
    return window_dynamics(changes, keys, width).select(*keys, "window_start", "evt_count", "evt_active_sensors", "evt_dominant_share")


def window_dynamics(changes: DataFrame, keys: list[str], width: int = WIDTH) -> DataFrame:
    """AGG-30 and AGG-32 in one chain: changes per sensor, then per room, then per window."""
    ws = F.col("minute") - F.pmod("minute", F.lit(width))
    sensor = changes.groupBy(*keys, ws.alias("window_start"), "binding", "room").agg(F.count(F.lit(1)).alias("n"))
    room = sensor.groupBy(*keys, "window_start", "room").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.count(F.lit(1)).alias("sensors"))
    named = F.col("room").isNotNull()
    in_room = F.when(named, F.col("n"))
    per = room.groupBy(*keys, "window_start").agg(
        F.sum("n").alias("_all"), F.sum("sensors").alias("_sensors"), F.max("top").alias("_top"),
        F.sum(in_room).alias("_t"), F.count_if(named).alias("_r"), F.max(in_room).alias("_m"), F.sum(in_room * F.ln(in_room)).alias("_nln"),
        F.min_by(F.col("room"), F.when(named, F.struct((-F.col("n")).alias("neg"), F.col("room")))).alias("dominant_room"),
    )
    # -Σ p ln p = ln t − Σ n ln n / t
    entropy = F.when(F.col("_r") > 1, (F.ln("_t") - F.col("_nln") / F.col("_t")) / F.ln("_r")).otherwise(0.0)
    return per.select(
        *keys, "window_start", F.col("_all").cast("double").alias("evt_count"), F.col("_sensors").cast("double").alias("evt_active_sensors"),
        (F.col("_top") / F.col("_all")).alias("evt_dominant_share"), F.col("_r").cast("double").alias("mob_rooms_active"),
        F.coalesce(F.col("_m") / F.col("_t"), F.lit(0.0)).alias("mob_top_room_frac"), entropy.alias("mob_room_entropy"), "dominant_room",
    )


def idle_minutes(changes: DataFrame, grid: DataFrame, frame_end: DataFrame, keys: list[str], cap: int = IDLE_CAP, width: int = WIDTH) -> DataFrame:
    """AGG-31: minutes since the last direct event at the window end, or at the last minute
    with data when that comes earlier."""
    ends = grid.join(frame_end, keys).select(
        *keys,
        "window_start",
        F.least(F.col("window_start") + width, F.col("last_minute")).alias("minute"),
        F.lit(None).cast("long").alias("event_min"),
        F.lit(1).alias("kind"),
    )
    hits = changes.select(*keys, "minute").distinct().select(
        *keys, F.lit(None).cast("long").alias("window_start"), "minute", F.col("minute").alias("event_min"), F.lit(0).alias("kind")
    )
    both = ends.unionByName(hits)
    got = last_known(both, keys, ["minute", "kind"], "event_min", F.floor(F.col("minute") / 1440), "last_event")
    idle = F.least(F.col("minute") - F.col("last_event"), F.lit(cap))
    return got.where("kind = 1").select(*keys, "window_start", F.coalesce(idle, F.lit(cap)).cast("double").alias("evt_idle_minutes"))


def mobility_stats(changes: DataFrame, keys: list[str], width: int = WIDTH) -> DataFrame:
    """AGG-32: active rooms, share of the busiest, entropy over ln(active rooms)."""
    d = window_dynamics(changes.where(F.col("room").isNotNull()), keys, width)
    return d.select(*keys, "window_start", "mob_rooms_active", "mob_top_room_frac", "mob_room_entropy", "dominant_room")


def dominant_rooms(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Busiest room per minute; ties go to the room of the first sensor by name."""
    per = changes.where(F.col("room").isNotNull()).groupBy(*keys, "minute", "room").agg(
        F.count(F.lit(1)).alias("n"), F.min("binding").alias("b")
    )
    return per.groupBy(*keys, "minute").agg(F.min_by("room", F.struct((-F.col("n")).alias("neg"), "b")).alias("room"))


def room_switches(changes: DataFrame, keys: list[str], width: int = WIDTH) -> DataFrame:
    """AGG-33: moves between the dominant rooms of a window's minutes (at most `width` rows each)."""
    dom = dominant_rooms(changes, keys).withColumn("window_start", F.col("minute") - F.pmod("minute", F.lit(width)))
    w = Window.partitionBy(*keys, "window_start").orderBy("minute")
    moved = dom.withColumn("_m", F.coalesce(F.lag("room").over(w) != F.col("room"), F.lit(False)))
    return moved.groupBy(*keys, "window_start").agg(F.sum(_num(F.col("_m"))).alias("mob_room_switches"))


def room_transition_count(changes: DataFrame, keys: list[str], rooms: list[str], width: int = WIDTH) -> DataFrame:
    """AGG-27: moves between two of the named rooms."""
    return room_switches(changes.where(F.col("room").isin(rooms)), keys, width)


# --- imputation and the full build (AGG-34..37) ------------------------------------------


def feature_names(bindings: list[tuple[str, str]]) -> list[str]:
    """(binding, role) pairs → wide column names in recipe order."""
    return [f"{b}_{s}" for b, role in bindings for s in RECIPES[role].suffixes]


def add_lags(df: DataFrame, names: list[str], keys: list[str], order: str = "window_start") -> DataFrame:
    """AGG-36: value of the previous row of the key (by row, not by clock)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumns({f"{n}_lag1": F.lag(n).over(w) for n in names if n in df.columns})


def missing_flags(df: DataFrame, bindings: list[tuple[str, str]]) -> DataFrame:
    """AGG-34: 1 where every output of a binding is NULL."""
    flags = {}
    for b, role in bindings:
        cols = [f"{b}_{s}" for s in RECIPES[role].suffixes if f"{b}_{s}" in df.columns]
        if cols:
            flags[f"{b}_missing"] = _num(F.coalesce(*[F.col(c) for c in cols]).isNull())
    return df.withColumns(flags)


def impute(df: DataFrame, bindings: list[tuple[str, str]], keys: list[str]) -> DataFrame:
    """AGG-34/35: flags first, then role sentinels, lags from their base, the rest 0."""
    out = missing_flags(df, bindings)
    fill = {f"{b}_{s}": RECIPES[role].absence for b, role in bindings for s in RECIPES[role].suffixes}
    out = out.fillna({k: v for k, v in fill.items() if k in out.columns})
    lags = {c: F.coalesce(c, F.col(c[:-5])) for c in out.columns if c.endswith("_lag1") and c[:-5] in out.columns}
    out = out.withColumns(lags) if lags else out
    rest = [c for c, t in out.dtypes if t == "double" and c not in keys]
    return out.fillna(0.0, subset=rest)


class UserRecipe(NamedTuple):
    """A feature of one role, computed by a function of a window's values and the minutes they held."""

    role: str
    suffix: str
    fn: Callable[[pd.Series, pd.Series], float]
    absence: float = 0.0


def user_recipe(role: str, suffix: str, absence: float = 0.0) -> Callable[[Callable[[pd.Series, pd.Series], float]], UserRecipe]:
    """Decorator: makes a recipe of a function (values, minutes) → number, for `build_features(recipes=…)`."""
    if role not in RECIPES:
        raise ValueError(f"unknown role {role}")
    return lambda fn: UserRecipe(role, suffix, fn, absence)


def user_features(win: DataFrame, keys: list[str], recipes: list[UserRecipe]) -> DataFrame:
    """(keys, window_start, feature, value) by grouped Arrow aggregation; a group is a series' intervals in one window."""

    def aggregate(fn):
        def value(num: pd.Series, minutes: pd.Series) -> float:
            return float(fn(num, minutes))

        return F.pandas_udf(value, "double")

    parts = []
    for r in recipes:
        own = win.where((F.col("role") == r.role) & F.col("num").isNotNull())
        got = own.groupBy(*keys, "window_start").agg(aggregate(r.fn)(F.col("num").cast("double"), F.col("n").cast("double")).alias("value"))
        parts.append(got.select(*keys, "window_start", F.concat_ws("_", "binding", F.lit(r.suffix)).alias("feature"), "value"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def build_features(
    iv: DataFrame,
    grid: DataFrame,
    bindings: list[tuple[str, str]],
    key: str = "person",
    composites=(),
    lags=(),
    granularity: str = "coarse",
    tz: str = "UTC",
    recipes: Sequence[UserRecipe] = (),
) -> DataFrame:
    """AGG-37: recipes → dynamics → mobility → composites → lags → imputation; one row per window.

    recipes: further ones of the caller, each giving a column binding_suffix for the bindings of its role.
    """
    from .windows import to_windows

    keys = [key]
    # read by five branches below: written once instead of scanning the raw history five times
    iv = materialise(iv, "intervals")
    win = to_windows(iv)
    stats = window_stats(win, [key, "binding"])
    long = long_features(stats, [key, "binding"], tz=tz)
    own = {f"{name}_{r.suffix}": r.absence for name, role in bindings for r in recipes if r.role == role}
    if own:
        long = long.unionByName(user_features(win, [key, "binding"], list(recipes)))
    wide = long.groupBy(key, "window_start").pivot("feature", [*feature_names(bindings), *own]).agg(F.max("value"))
    changes = change_rows(iv)
    on = [key, "window_start"]
    frame_end = iv.groupBy(key).agg((F.max("frame_stop") - 1).alias("last_minute"))
    out = grid.join(wide, on, "left").fillna(own) if own else grid.join(wide, on, "left")
    for part in (
        window_dynamics(changes, keys).drop("dominant_room"),
        room_switches(changes, keys),
        idle_minutes(changes, grid, frame_end, keys),
    ):
        out = out.join(part, on, "left")
    zero = ["evt_count", "evt_active_sensors", "evt_dominant_share", "mob_rooms_active", "mob_top_room_frac", "mob_room_entropy", "mob_room_switches"]
    out = out.fillna(0.0, subset=zero).fillna(float(IDLE_CAP), subset=["evt_idle_minutes"])
    out = with_time_features(out, granularity, tz)
    out = with_composites(out, list(composites))
    out = add_lags(out, list(lags), keys)
    return impute(out, bindings, on)
