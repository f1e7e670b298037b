"""Sensor profiles, health, coverage, capability, advisories and evidence cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import quantiles
from ..functions.segments import with_previous
from ..session import materialise

ENUM_MAX = 12
# Which sensor to suggest first for a room.
SUGGEST_ORDER = ["presence", "power", "door", "env"]
GOLD_MIN, F1_RELIABLE, F1_UNRELIABLE, CONFUSE_MAX, MIN_SUPPORT = 30, 0.7, 0.5, 0.4, 10
SEVERITY = {"info": 1, "warn": 2, "critical": 3}


def value_type(kind: dict[str, Column]) -> Column:
    """SUM-21 from aggregates: n, numeric share, whether all 0/1, whether all whole, distinct values."""
    return (
        F.when(kind["n"] == 0, "unknown")
        .when(kind["numeric"] >= 0.95, F.when(kind["binary"], "boolean").when(kind["whole"] & (kind["distinct"] <= ENUM_MAX), "numeric_discrete").otherwise("numeric_continuous"))
        .when(kind["distinct"] <= ENUM_MAX, "enum")
        .otherwise("string")
    )


def value_types(history: DataFrame, keys: list[str]) -> DataFrame:
    """SUM-21. history: (keys, ts, state). States collapse to counts first, so a busy key stays small."""
    per = history.where(F.col("state").isNotNull()).groupBy(*keys, "state").agg(F.count(F.lit(1)).alias("n"))
    num = F.col("state").try_cast("double")
    a = per.groupBy(*keys).agg(
        F.sum("n").alias("samples"),
        (F.sum(F.when(num.isNotNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("numeric"),
        F.coalesce(F.bool_and(num.isin(0.0, 1.0)), F.lit(False)).alias("binary"),
        F.coalesce(F.bool_and(num == F.round(num)), F.lit(False)).alias("whole"),
        F.count(F.lit(1)).alias("distinct_values"),
    )
    kind = {"n": F.col("samples"), "numeric": F.col("numeric"), "binary": F.col("binary"), "whole": F.col("whole"), "distinct": F.col("distinct_values")}
    return a.select(*keys, "samples", "distinct_values", value_type(kind).alias("value_type"))


def entity_profile(history: DataFrame, keys: list[str], end: Column, days: int) -> DataFrame:
    """SUM-20: changes per day, gaps, flatline share, staleness and numeric quantiles of each entity.

    history: (keys, minute, sec, state). The previous row is found per day segment, the median gap
    and the quantiles come from exact distributed ranks; no entity is ever sorted in one task.
    """
    day = F.floor(F.col("minute") / 1440)
    # the history is read once; each of the two tables below is then read by several branches
    history = materialise(history.select(*keys, "minute", "sec", "state"), "history")
    p = with_previous(history, keys, ["sec"], ["sec", "state"], day)
    gap, num, pnum = F.col("sec") - F.col("prev_sec"), F.col("state").try_cast("double"), F.col("prev_state").try_cast("double")
    rows = materialise(p.withColumns({"gap": gap.cast("double"), "num": num}), "history-gaps")
    a = rows.groupBy(*keys).agg(
        F.round(F.count_if(F.col("state") != F.col("prev_state")) / days, 3).alias("changes_per_day"),
        F.coalesce(F.max("gap"), F.lit(0.0)).alias("_long"), F.min("sec").alias("_first"), F.max("sec").alias("_last"),
        F.round(F.min("num"), 4).alias("vmin"), F.round(F.max("num"), 4).alias("vmax"),
        F.round(F.avg((num >= pnum).cast("double")), 4).alias("rising_share"),
    )
    q = quantiles(rows, keys, "num", {"p05": 0.05, "median": 0.5, "p95": 0.95})
    g = quantiles(rows, keys, "gap", {"median_gap_s": 0.5})
    t = value_types(history, keys)
    j = a.join(t, keys).join(q, keys, "left").join(g, keys, "left")
    tail = F.greatest(end - F.col("_last"), F.lit(0))
    longest = F.greatest(F.col("_long"), tail)
    span = F.greatest(F.col("_last") - F.col("_first"), end - F.col("_first"))
    flat = F.when(F.col("distinct_values") <= 1, 1.0).when(span > 0, F.round(F.least(longest / F.when(span > 0, span), F.lit(1.0)), 4)).otherwise(0.0)
    return j.select(
        *keys, "value_type", "distinct_values", "changes_per_day", F.round("median_gap_s", 1).alias("median_gap_s"), F.round(longest / 3600, 2).alias("longest_gap_h"),
        flat.alias("flatline_frac"), F.round(tail / 3600, 2).alias("age_h"), "vmin", F.round("p05", 4).alias("p05"), F.round("median", 4).alias("median"),
        F.round("p95", 4).alias("p95"), "vmax", F.coalesce("rising_share", F.lit(1.0)).alias("rising_share"),
    )


def hour_histogram(rows: DataFrame, keys: list[str], hour: Column) -> DataFrame:
    """SUM-40: 24 counts per key."""
    per = rows.groupBy(*keys, hour.alias("h")).agg(F.count(F.lit(1)).alias("n"))
    m = per.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("h").cast("int"), "n"))).alias("m"))
    return m.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.col("m")[h], F.lit(0))).alias("hist"))


def hist_total(hist: Column) -> Column:
    return F.aggregate(hist, F.lit(0).cast("long"), lambda a, v: a + v)


def looks_like_marker(hist: Column, n_windows: Column) -> Column:
    """SUM-41."""
    total = hist_total(hist)
    desc = F.sort_array(hist, asc=False)
    tight = (desc[0] / F.when(total > 0, total) >= 0.4) | ((desc[0] + desc[1]) / F.when(total > 0, total) >= 0.6)
    return F.coalesce((total >= 3) & tight & (n_windows <= 8), F.lit(False))


def peak_span(hist: Column) -> Column:
    """SUM-39: from the smallest set of hours that covers 70 %: first and last hour, peak, part of day."""
    total = hist_total(hist)
    order = F.array_sort(F.transform(hist, lambda v, i: F.struct((-v).alias("neg"), i.alias("h"))))
    zero = F.struct(F.lit(0).cast("long").alias("acc"), F.array().cast("array<int>").alias("hs"))
    step = lambda a, e: F.when(a["acc"] / total >= 0.7, a).otherwise(F.struct((a["acc"] - e["neg"]).alias("acc"), F.array_append(a["hs"], e["h"]).alias("hs")))
    chosen = F.aggregate(order, zero, step)["hs"]
    peak = order[0]["h"]
    part = F.when(peak.between(5, 10), "morning").when(peak.between(11, 16), "afternoon").when(peak.between(17, 21), "evening").otherwise("night")
    return F.when(total > 0, F.struct(F.array_min(chosen).alias("lo"), F.array_max(chosen).alias("hi"), peak.alias("peak"), part.alias("part")))


def cadence(rows: DataFrame, keys: list[str], weekday: Column) -> DataFrame:
    """SUM-39: share of windows on weekdays and its phrase; weekday counts from Monday = 0."""
    share = F.avg((weekday < 5).cast("double"))
    words = F.when(F.col("_s") >= 0.75, "mostly on weekdays").when(F.col("_s") <= 0.25, "mostly at weekends").otherwise("any day of the week")
    return rows.groupBy(*keys).agg(share.alias("_s")).select(*keys, F.round("_s", 2).alias("weekday_frac"), words.alias("phrase"))


def spread_examples(rows: DataFrame, keys: list[str], k: int = 4) -> DataFrame:
    """SUM-39: k moments evenly spaced over a card's windows (a card keeps at most 1000)."""
    r = F.row_number().over(Window.partitionBy(*keys).orderBy("w")) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    marked = rows.withColumns({"_r": r, "_n": n})
    picks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.round(i * (F.col("_n") - 1) / (k - 1)).cast("int"))
    return marked.where((F.col("_n") <= k) | F.array_contains(picks, F.col("_r"))).select(*keys, "w")


def rooms_by_weight(signature: DataFrame, keys: list[str], top: int = 3) -> DataFrame:
    """SUM-39: rooms by Σ|z| of the signature features in them. signature: (keys, room, z)."""
    per = signature.where(F.col("room").isNotNull()).groupBy(*keys, "room").agg(F.sum(F.abs("z")).alias("weight"))
    w = Window.partitionBy(*keys).orderBy(F.col("weight").desc(), "room")
    return per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def reliability_verdict(p: dict[str, Column]) -> Column:
    """SUM-22: ok, suspect or unusable with the first reason that applies."""
    v = lambda a, b: F.struct(F.lit(a).alias("verdict"), F.lit(b).alias("reason"))
    return (
        F.when(p["value_type"] == "unknown", v("unusable", "no readable values"))
        .when((p["distinct"] <= 1) | (p["flat"] == 1.0), v("unusable", "value never changes"))
        .when(p["changes"] < 0.5, v("suspect", "changes less than once every two days"))
        .when(p["flat"] >= 0.9, v("suspect", "flat most of the time"))
        .when(p["gap_h"] >= 72, v("suspect", "long silent gap"))
        .otherwise(v("ok", ""))
    )


def catalog(entities: DataFrame, history: DataFrame, key: str, share: bool, samples: int = 5, chars: int | None = None) -> DataFrame:
    """SUM-23: metadata always; recent samples only with consent, cut to `chars` if given. history: (key, ts, state)."""
    if not share:
        return entities.withColumn("samples", F.lit(None).cast("array<string>"))
    w = Window.partitionBy(key).orderBy(F.col("ts").desc())
    # rank-limited before the shuffle, so only a few rows per entity travel
    last = history.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= samples)
    state = F.col("state") if chars is None else F.substring("state", 1, chars)
    text = F.array_sort(F.collect_list(F.struct("ts", state.alias("state"))))
    got = last.groupBy(key).agg(F.transform(text, lambda e: e["state"]).alias("samples"))
    return entities.join(got, key, "left")


def sensor_health(series: DataFrame, readings: DataFrame, on: list[str], now: Column, hours: int = 168) -> DataFrame:
    """SUM-24: status, observations per day, last activity and min–max scaled trace of each series."""
    win = readings.where(F.col("minute") > now - hours * 60)
    a = win.groupBy(*on).agg(
        F.count(F.lit(1)).alias("n"), F.max("minute").alias("last"), F.min("num").alias("lo"), F.max("num").alias("hi"),
        (F.min("str") != F.max("str")).alias("_text_moves"),
    )
    b = win.where(F.col("num").isNotNull()).groupBy(*on, F.floor(F.col("minute") / (hours * 60 / 60)).alias("b")).agg(F.avg("num").alias("m"))
    tr = b.groupBy(*on).agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "m"))), lambda e: e["m"]).alias("trace"))
    j = series.join(a, on, "left").join(tr, on, "left")
    lo, hi = F.array_min("trace"), F.array_max("trace")
    spark_line = F.transform("trace", lambda v: F.when(hi > lo, (v - lo) / (hi - lo)).otherwise(0.5))
    moving = (F.col("hi") > F.col("lo")) | F.coalesce("_text_moves", F.lit(False))
    status = F.when(F.coalesce("n", F.lit(0)) == 0, "no_data").when(F.coalesce(moving, F.lit(False)), "alive").otherwise("constant")
    return j.select(
        *on, status.alias("status"), F.round(F.coalesce("n", F.lit(0)) / (hours / 24), 2).alias("obs_per_day"),
        F.coalesce(F.col("last") > now - 15, F.lit(False)).alias("recent"), F.size(F.coalesce(spark_line, F.array().cast("array<double>"))).cast("long").alias("points"),
        F.round(F.aggregate(F.coalesce(spark_line, F.array().cast("array<double>")), F.lit(0.0), lambda x, v: x + v), 6).alias("spark_sum"),
    )


def class_balance(labels: DataFrame, keys: list[str], now: Column, days: int = 7) -> DataFrame:
    """SUM-25."""
    return labels.where(F.col("window_min") > now - days * 1440).groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))


def presence_coverage(persons: DataFrame, health: DataFrame) -> DataFrame:
    """SUM-26: does a member have a live person sensor? health: (person, role, status)."""
    ok = health.where("role = 'person'").groupBy("person").agg(F.bool_or(F.col("status") != "no_data").alias("covered"))
    return persons.join(ok, "person", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def methodology(bindings: DataFrame, tier: Column) -> DataFrame:
    """SUM-27: sensors per room and tier, weakest room flagged (fewest direct sensors, then fewest)."""
    per = bindings.where(F.col("enabled") & F.col("room").isNotNull()).groupBy("room").agg(
        F.count(F.lit(1)).alias("sensors"), F.count_if(tier == 1).alias("direct"), F.count_if(tier == 2).alias("behavioral"),
        F.count_if(tier == 3).alias("ambient"), F.count_distinct("role").alias("roles"))
    weakest = per.agg(F.min_by("room", F.struct("direct", "sensors", "room"))).scalar()
    return per.withColumn("weakest", F.col("room") == weakest)


def room_roles(bindings: DataFrame) -> DataFrame:
    """SUM-28: roles present in each room."""
    return bindings.where(F.col("enabled") & F.col("room").isNotNull()).groupBy("room").agg(F.array_sort(F.collect_set("role")).alias("roles"))


def suggest_role_for(roles: Column) -> Column:
    missing = F.filter(F.array(*map(F.lit, SUGGEST_ORDER)), lambda r: ~F.array_contains(F.coalesce(roles, F.array().cast("array<string>")), r))
    return F.get(missing, F.lit(0))


def blind_spots(pairs: DataFrame, activity_room: DataFrame, ambient: DataFrame, rooms: DataFrame, used_rooms: DataFrame) -> DataFrame:
    """SUM-29: confused pairs, weak evidence and rooms without sensors, ranked by severity.

    pairs: (a, b, rate); activity_room: (activity, room); ambient: (activity, share); rooms: room_roles.
    """
    ra, rb = activity_room.select(F.col("activity").alias("a"), F.col("room").alias("ra")), activity_room.select(F.col("activity").alias("b"), F.col("room").alias("rb"))
    confused = pairs.join(ra, "a", "left").join(rb, "b", "left").select(
        F.lit("confused_pair").alias("kind"), F.round(F.least(F.lit(1.0), F.col("rate") * 1.5), 3).alias("severity"),
        F.coalesce("ra", "rb").alias("room"), F.concat_ws("+", F.least("a", "b"), F.greatest("a", "b")).alias("activities"))
    weak = ambient.where(F.col("share") >= 0.5).join(activity_room, "activity", "left").select(
        F.lit("weak_evidence").alias("kind"), F.round(F.least(F.lit(1.0), F.col("share")), 3).alias("severity"), "room", F.col("activity").alias("activities"))
    ghost = used_rooms.select("room").distinct().join(rooms, "room", "left_anti").select(
        F.lit("ghost_room").alias("kind"), F.lit(0.6).alias("severity"), "room", F.lit("").alias("activities"))
    every = confused.unionByName(weak).unionByName(ghost).dropDuplicates(["kind", "room", "activities"])
    out = every.join(rooms, "room", "left")
    role = F.when(F.col("kind") == "ghost_room", "presence").otherwise(suggest_role_for(F.col("roles")))
    return out.select("kind", "severity", "room", "activities", role.alias("suggested_role"))


def capability(report: DataFrame, partners: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """SUM-30: reliable, learning or unreliable per activity.

    report: (keys, class, f1, support); partners: (keys, class, partner, rate); models: (keys, n_gold, validated, beats_flat).
    """
    j = report.join(partners, [*keys, "class"], "left").join(models, keys)
    rate = F.coalesce("rate", F.lit(0.0))
    judged = F.col("validated") | (F.col("n_gold") >= GOLD_MIN)
    tier = (
        F.when((F.col("support") < MIN_SUPPORT) | ~judged, "learning")
        .when((F.col("f1") >= F1_RELIABLE) & F.col("beats_flat") & (rate <= CONFUSE_MAX), "reliable")
        .when(rate > CONFUSE_MAX, "unreliable")
        .when((F.col("f1") < F1_UNRELIABLE) | ~F.col("beats_flat"), "unreliable")
        .otherwise("learning")
    )
    return j.select(*keys, "class", "f1", "support", tier.alias("tier"), F.when(rate > CONFUSE_MAX, F.col("partner")).alias("confused_with"))


def model_insight(accuracy: DataFrame, ece: DataFrame, flat: DataFrame, drift: DataFrame, slices: DataFrame, keys: list[str]) -> DataFrame:
    """SUM-31: the honest facts about a live model.

    accuracy: (keys, n_gold, accuracy_gold); ece: (keys, ece); flat: (keys, flat_accuracy);
    drift: (keys, drifted); slices: (keys, activity, daypart, n, accuracy).
    """
    weak = slices.where(F.col("n") >= 5).groupBy(*keys).agg(F.min_by(F.struct("activity", "daypart", "accuracy"), F.struct("accuracy", "activity", "daypart")).alias("_w"))
    j = accuracy.join(ece, keys, "left").join(flat, keys, "left").join(drift, keys, "left").join(weak, keys, "left")
    return j.select(
        *keys, "n_gold", F.when(F.col("n_gold") >= GOLD_MIN, F.col("accuracy_gold")).alias("accuracy_gold"), "ece", (F.col("ece") <= 0.1).alias("trustworthy"),
        (F.col("accuracy_gold") >= F.col("flat_accuracy")).alias("beats_flat"), F.coalesce("drifted", F.lit(0)).alias("drifted"),
        F.col("_w.activity").alias("weak_activity"), F.col("_w.daypart").alias("weak_daypart"), F.col("_w.accuracy").alias("weak_accuracy"),
    )


def advisory_scan(insight: DataFrame) -> DataFrame:
    """SUM-32: the first finding that applies to each person."""
    kind = (
        F.when(F.col("accuracy_gold") < 0.6, "low_accuracy").when(F.col("drifted") > 0, "drift").when(F.col("ece") > 0.15, "confidence_off").when(~F.col("beats_flat"), "no_gain")
    )
    return insight.withColumn("kind", kind).where(F.col("kind").isNotNull()).withColumn("severity", F.when(F.col("kind") == "low_accuracy", "warn").otherwise("info"))


def severity_rank(c: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[c]


def upsert_advisories(old: DataFrame, new: DataFrame, snoozes: DataFrame, now: Column) -> DataFrame:
    """SUM-33: (kind, severity, detail, at): first-seen time kept, a changed text re-opens a snooze.

    Rows of `new` replace those of `old`; order by severity then newest for display.
    """
    o = old.select("kind", F.col("severity").alias("os"), F.col("detail").alias("od"), F.col("at").alias("oa"))
    j = new.join(o, "kind", "full_outer")
    changed = F.col("detail").isNotNull() & F.col("od").isNotNull() & (F.col("detail") != F.col("od"))
    merged = j.select(
        "kind", F.coalesce("severity", "os").alias("severity"), F.coalesce("detail", "od").alias("detail"), F.coalesce("oa", "at").alias("at"), changed.alias("reopened"))
    live = snoozes.where(F.col("until") > now).select("kind", F.lit(True).alias("_z"))
    return merged.join(live, "kind", "left").where(F.col("_z").isNull() | F.col("reopened")).drop("_z")


def event_log(events: DataFrame, keep: int = 120) -> DataFrame:
    """SUM-34: the newest entries."""
    return events.orderBy(F.col("at").desc(), F.col("id").desc()).limit(keep)


def active_incidents(incidents: DataFrame, now: Column, ttl_min: int) -> DataFrame:
    """SUM-35: incidents within their lifetime, worst first, then newest."""
    live = incidents.where(now - F.col("at") <= ttl_min)
    return live.orderBy(severity_rank(F.col("severity")).desc(), F.col("at").desc())


def milestones(counts: DataFrame, fired: DataFrame) -> DataFrame:
    """SUM-36: milestones reached and not fired before. counts: (key, name, reached)."""
    return counts.where("reached").select("key", "name").join(fired, ["key", "name"], "left_anti")


def journey(events: DataFrame, bindings: DataFrame, now: Column) -> DataFrame:
    """SUM-42: days recorded, events of the last day, sensors bound."""
    n = bindings.where("enabled").agg(F.count(F.lit(1))).scalar()
    return events.agg(
        F.ceil((now - F.min("minute")) / 1440).alias("days"), F.count_if(F.col("minute") > now - 1440).alias("events_24h")
    ).withColumn("sensors", n)


def group_caption(sensors: DataFrame, keys: list[str]) -> DataFrame:
    """SUM-44: the room that holds at least 60 % of a group, else its most frequent role."""
    best = lambda c: sensors.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(
        F.min_by(c, F.struct((-F.col("n")).alias("neg"), c)).alias(f"top_{c}"), F.max("n").alias(f"n_{c}"))
    total = sensors.groupBy(*keys).agg(F.count(F.lit(1)).alias("t"))
    j = total.join(best("room"), keys, "left").join(best("role"), keys, "left")
    return j.select(*keys, F.when(F.col("n_room") / F.col("t") >= 0.6, F.col("top_room")).otherwise(F.col("top_role")).alias("caption"))
