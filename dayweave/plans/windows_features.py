"""Window formation and per-window feature queries. The SQL side works on a dense minute grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cols import day_bounds_utc, r6, time_columns
from ..operators import recipes as A
from ..operators import windows as W
from ..sources import tables as T
from .catalog import query

SERIES = ["person", "binding"]


def minutes(spark, sf):
    return W.minute_last(T.readings(spark, sf), SERIES)


def iv_of(spark, sf):
    return W.intervals(minutes(spark, sf), ["person"], SERIES)


def roles_iv(spark, sf, *roles):
    """Intervals of some roles; the frame end still comes from all series."""
    iv = iv_of(spark, sf)
    return iv.where(F.col("role").isin(*roles))


def numeric_iv(spark, sf):
    """Intervals of all numeric series."""
    return iv_of(spark, sf).where(F.col("num").isNotNull())


def binding_roles() -> list[tuple[str, str]]:
    return sorted((f"{t}_{s[0]}", s[0]) for t, ss in T._series().items() for s in ss)


@query("win_minute_resample", "WIN-01", "SELECT person, binding, minute, num, str FROM minutely")
def win_minute_resample(spark, sf):
    return minutes(spark, sf).select("person", "binding", "minute", "num", "str")


@query("win_bounded_fill", "WIN-02", """
SELECT person, binding, count(*) AS minutes, round(sum(num),6) AS total, CAST(sum(m) AS BIGINT) AS minute_sum FROM dense GROUP BY ALL""")
def win_bounded_fill(spark, sf):
    n = F.col("to_min") - F.col("from_min")
    return iv_of(spark, sf).groupBy("person", "binding").agg(
        F.sum(n).alias("minutes"), r6(F.sum(F.col("num") * n)).alias("total"),
        F.sum((n * F.col("from_min") + n * (n - 1) / 2).cast("long")).alias("minute_sum"))


@query("win_grid", "WIN-03", """
SELECT person, unnest(range(CAST(ceil(lo/5.0)*5 AS BIGINT), hi-30+1, 5)) AS window_start FROM (SELECT person, min(minute) AS lo, max(minute) AS hi FROM ev GROUP BY person)""")
def win_grid(spark, sf):
    b = T.events(spark, sf).groupBy("person").agg(F.min("minute").alias("start"), F.max("minute").alias("end"))
    return W.window_grid(b, ["person"], 5)


@query("win_tumbling_mean", "WIN-04", """
SELECT person, binding, ws AS window_start, count(*) AS minutes, round(avg(num),6) AS mean FROM densewin WHERE num IS NOT NULL GROUP BY ALL""")
def win_tumbling_mean(spark, sf):
    win = W.to_windows(numeric_iv(spark, sf))
    s = A.window_stats(win, SERIES)
    return s.select("person", "binding", "window_start", "minutes", r6(F.col("weighted") / F.col("minutes")).alias("mean"))


@query("win_sliding_mean", "WIN-05", """
SELECT person, binding, we-30 AS window_start, count(*) AS minutes, round(avg(num),6) AS mean FROM
 (SELECT *, (m//5+1)*5+5*unnest(range(0,lb//5)) AS we FROM (SELECT *, CASE role WHEN 'presence' THEN 15 WHEN 'media' THEN 15 WHEN 'env' THEN 60 WHEN 'steps' THEN 180 WHEN 'battery' THEN 180 ELSE 30 END AS lb FROM dense WHERE num IS NOT NULL)) WHERE we<=(fe//30)*30+30 GROUP BY ALL""")
def win_sliding_mean(spark, sf):
    win = W.to_windows(numeric_iv(spark, sf), stride=5)
    s = A.window_stats(win, SERIES)
    return s.select("person", "binding", "window_start", "minutes", r6(F.col("weighted") / F.col("minutes")).alias("mean"))


@query("win_role_lookback", "WIN-06", """
SELECT role, ws AS window_start, count(*) AS minutes, count(DISTINCT person) AS persons FROM densewin GROUP BY role, ws""")
def win_role_lookback(spark, sf):
    win = W.to_windows(iv_of(spark, sf))
    per = win.groupBy("role", "person", "window_start").agg(F.sum("n").alias("n"))
    return per.groupBy("role", "window_start").agg(F.sum("n").alias("minutes"), F.count("*").alias("persons"))


@query("win_incremental_build", "WIN-07 WIN-08", """
WITH mk AS (SELECT person, max(minute-minute%30) AS mark FROM ev WHERE event_type='signup' AND k<50 AND minute <= (SELECT max(minute)-1440 FROM ev) GROUP BY person)
SELECT r.person, r.binding, count(*) AS n, min(r.minute) AS first_minute, coalesce(mark+5, (SELECT max(minute) FROM ev)-120) AS emit_from
FROM reading r LEFT JOIN mk USING (person) WHERE r.minute >= coalesce(mark+5, (SELECT max(minute) FROM ev)-120)-180 GROUP BY r.person, r.binding, mark""")
def win_incremental_build(spark, sf):
    rd, ev = T.readings(spark, sf), T.events(spark, sf)
    now = ev.agg(F.max("minute")).scalar()
    feats = ev.where((F.col("event_type") == "signup") & (F.col("k") < 50) & (F.col("minute") <= now - 1440)).select(
        "person", (F.col("minute") - F.col("minute") % 30).alias("window_start"))
    got = W.since_high_water(rd, feats, ["person"], now)
    return got.groupBy("person", "binding", "emit_from").agg(F.count("*").alias("n"), F.min("minute").alias("first_minute"))


@query("win_history_rebuild", "WIN-09", """
WITH have AS (SELECT person, count(DISTINCT w) AS windows FROM timeline GROUP BY person), md AS (SELECT DISTINCT person FROM timeline WHERE model_version='rf-3' AND confidence>0.9),
b AS (SELECT min(minute) AS s, max(minute) AS e FROM ev)
SELECT person, unnest(range(s, e, 10080)) AS chunk_start, least(unnest(range(s, e, 10080))+10080, e) AS chunk_end FROM have SEMI JOIN md USING (person), b WHERE windows<1100""")
def win_history_rebuild(spark, sf):
    tl = T.timeline(spark, sf)
    have = tl.groupBy("person").agg(F.count_distinct("w").alias("windows"))
    models = tl.select("person", ((F.col("model_version") == "rf-3") & (F.col("confidence") > 0.9)).alias("promoted"))
    due = W.needs_rebuild(have, models, ["person"], 1100)
    ev = T.events(spark, sf)
    lo, hi = ev.agg(F.min("minute")).scalar(), ev.agg(F.max("minute")).scalar()
    return W.rebuild_chunks(due, ["person"], lo, hi)


@query("win_current_window", "WIN-10", """
SELECT person, binding, count(*) AS minutes, round(avg(num),6) AS mean FROM dense, (SELECT max(minute)-max(minute)%5 AS e FROM ev) WHERE num IS NOT NULL AND m>=e-30 AND m<e GROUP BY ALL""")
def win_current_window(spark, sf):
    iv = iv_of(spark, sf).where(F.col("num").isNotNull())
    lo, hi = W.current_window(T.events(spark, sf).agg(F.max("minute")).scalar())
    n = F.least(F.col("to_min"), hi) - F.greatest(F.col("from_min"), lo)
    cut = iv.where((F.col("to_min") > lo) & (F.col("from_min") < hi)).withColumn("n", n)
    return cut.groupBy("person", "binding").agg(F.sum("n").alias("minutes"), r6(F.sum(F.col("num") * F.col("n")) / F.sum("n")).alias("mean"))


@query("win_part_of_day", "WIN-11 WIN-12", """
SELECT person, ws AS window_start, CAST(CASE WHEN h<5 OR h>=22 THEN 0 WHEN h<11 THEN 1 WHEN h<17 THEN 2 ELSE 3 END AS DOUBLE) AS time_bucket,
 CAST(h AS DOUBLE) AS hour_of_day, CAST(isodow(t)-1 AS DOUBLE) AS day_of_week, CAST(isodow(t)>=6 AS DOUBLE) AS is_weekend
FROM (SELECT *, hour(t) AS h FROM (SELECT *, make_timestamp(ws*60000000) + INTERVAL 1 HOUR AS t FROM grid))""")
def win_part_of_day(spark, sf):
    g = W.window_grid(W.data_bounds(T.events(spark, sf), ["person"]), ["person"])
    # Amsterdam is one hour ahead throughout January
    cols = {**time_columns(F.col("window_start"), "coarse", "Europe/Amsterdam"), **time_columns(F.col("window_start"), "full", "Europe/Amsterdam")}
    return g.withColumns(cols)


@query("win_feature_set_guard", "WIN-13", """
SELECT person, feature_set, count(*) AS windows, feature_set='v'||substr(sha256('coarse'),1,10) AS current FROM
 (SELECT person, w, 'v'||substr(sha256(CASE WHEN model_version='rf-3' THEN 'coarse' ELSE 'full' END),1,10) AS feature_set FROM timeline) GROUP BY ALL""")
def win_feature_set_guard(spark, sf):
    config = F.when(F.col("model_version") == "rf-3", "coarse").otherwise("full")
    version = lambda c: F.concat(F.lit("v"), F.substring(F.sha2(c, 256), 1, 10))
    tl = T.timeline(spark, sf).withColumn("feature_set", version(config))
    return tl.groupBy("person", "feature_set").agg(F.count("*").alias("windows")).withColumn("current", F.col("feature_set") == version(F.lit("coarse")))


@query("win_bucket_last", "WIN-14", """
SELECT person, minute-minute%20 AS bucket, arg_max(value, ts) AS value FROM ev GROUP BY ALL""")
def win_bucket_last(spark, sf):
    return W.bucket_last(T.events(spark, sf), ["person"], 20, "value")


@query("win_local_day_bounds", "WIN-15 FUN-02", """
SELECT person, event_id, epoch_us((date_trunc('day', (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') - INTERVAL 1 DAY) AT TIME ZONE 'America/New_York')//1000000 AS day_start,
 epoch_us(date_trunc('day', (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AT TIME ZONE 'America/New_York')//1000000 AS day_end FROM ev""")
def win_local_day_bounds(spark, sf):
    lo, hi = day_bounds_utc(F.col("ts"), "America/New_York")
    return T.events(spark, sf).select("person", "event_id", F.unix_seconds(lo).alias("day_start"), F.unix_seconds(hi).alias("day_end"))


# --- recipes: one query per role -----------------------------------------------------------

ORDERED = "WINDOW o AS (PARTITION BY person, binding, ws ORDER BY m)"
RECIPE_SQL = {
    "presence": "round(avg(CAST(num>0 AS DOUBLE)),6) AS frac, max(CAST(num>0 AS DOUBLE)) AS any, CAST(count(*) FILTER (WHERE (num>0) <> (pn>0)) AS DOUBLE) AS transitions",
    "bed": "round(avg(num),6) AS mean, max(num) AS max, CAST(max(num)>1.5 AS DOUBLE) AS occupied",
    "power": "CAST(max(num)>10 AS DOUBLE) AS \"on\", max(num) AS max_w",
    "light": "CAST(arg_max(num,m)>0 AS DOUBLE) AS on_last, round(avg(CAST(num>0 AS DOUBLE)),6) AS on_frac",
    "media": "max(CAST(str='playing' AS DOUBLE)) AS playing, max(CAST(str='paused' AS DOUBLE)) AS paused, max(CAST(str IN ('playing','paused') AS DOUBLE)) AS active",
    "env": "round(avg(num),6) AS mean, round(arg_max(num,m)-arg_min(num,m),6) AS delta, max(num) AS max",
    "person": "CAST(arg_max(str,m)='home' AS DOUBLE) AS home_last, round(avg(CAST(str='home' AS DOUBLE)),6) AS home_frac",
    "focus": "CAST(arg_max(num,m)>0 AS DOUBLE) AS on_last",
    "door": "max(CAST(num>0 AS DOUBLE)) AS opened_any, CAST(count(*) FILTER (WHERE num>0 AND NOT coalesce(pn>0,false)) AS DOUBLE) AS open_count",
    "steps": "CASE WHEN count(*)>=2 THEN greatest(arg_max(num,m)-arg_min(num,m),0.0) END AS delta",
    "battery": "CASE WHEN count(*)>=2 THEN arg_max(num,m)-arg_min(num,m) END AS delta",
    "custom": "round(avg(num),6) AS mean, max(num) AS max, round(arg_max(num,m)-arg_min(num,m),6) AS delta",
}
IDS = dict(zip(["presence", "bed", "power", "light", "media", "env", "person", "focus", "alarm_time", "door", "steps", "battery", "custom"], range(1, 14)))


def _recipe_query(role):
    def run(spark, sf):
        iv = W.intervals(minutes(spark, sf), ["person"], SERIES).where(F.col("role") == role)
        out = A.recipe_features(A.window_stats(W.to_windows(iv), SERIES), role, SERIES)
        rounded = [c for c in out.columns if c in ("frac", "mean", "on_frac", "delta", "home_frac") and role not in ("steps", "battery")]
        return out.withColumns({c: r6(c) for c in rounded}) if rounded else out

    return run


for _role, _cols in RECIPE_SQL.items():
    query(f"agg_recipe_{_role}", f"AGG-{IDS[_role]:02d}", f"""
SELECT person, binding, ws AS window_start, {_cols} FROM (SELECT *, lag(num) OVER o AS pn FROM densewin WHERE role='{_role}' {ORDERED}) GROUP BY person, binding, ws""")(_recipe_query(_role))

query("agg_recipe_alarm_time", "AGG-09", """
SELECT person, binding, ws AS window_start, CAST(d AS DOUBLE) AS minutes_until, CAST(d BETWEEN -10 AND 40 AS DOUBLE) AS imminent FROM (
 SELECT *, ((CAST(split_part(s,':',1) AS BIGINT)*60+CAST(split_part(s,':',2) AS BIGINT)-(ws+30)%1440+720+1440)%1440)-720 AS d FROM
 (SELECT person, binding, ws, arg_max(str,m) AS s FROM densewin WHERE role='alarm_time' GROUP BY ALL))""")(_recipe_query("alarm_time"))


# --- named transforms ------------------------------------------------------------------------


def transform_win(spark, sf):
    return W.to_windows(A.with_run_ids(A.with_positions(numeric_iv(spark, sf), SERIES), SERIES))


@query("agg_transforms_numeric", "AGG-14 AGG-15 AGG-16 AGG-18 AGG-19 AGG-20 AGG-21", """
SELECT person, binding, ws AS window_start, round(avg(CAST(num>0.5 AS DOUBLE)),6) AS occupancy_fraction, max(CAST(num>0.5 AS DOUBLE)) AS any_active,
 CAST(count(*) FILTER (WHERE num<>pn) AS DOUBLE) AS transition_count,
 CASE WHEN count(*)<2 THEN 240.0 ELSE CAST(least(greatest(ws+30-coalesce(max(m) FILTER (WHERE num<>pn), min(m)),0),240) AS DOUBLE) END AS time_since_last_change,
 round(avg(num),6) AS window_mean, max(num) AS window_max, min(num) AS window_minimum, round(arg_max(num,m)-arg_min(num,m),6) AS window_delta,
 round(CASE WHEN count(*)>=2 THEN regr_slope(num, rn) ELSE 0 END,6) AS window_slope,
 round(CASE WHEN count(*)>=2 AND arg_max(num,m)>=arg_min(num,m) THEN (arg_max(num,m)-arg_min(num,m))/(max(m)-min(m)) ELSE 0 END,6) AS counter_rate
FROM (SELECT *, lag(num) OVER o AS pn, row_number() OVER o AS rn FROM densewin WHERE num IS NOT NULL """ + ORDERED + ") GROUP BY person, binding, ws")
def agg_transforms_numeric(spark, sf):
    s = A.transform_stats(transform_win(spark, sf), SERIES)
    cols = {k: r6(v) for k, v in A.transform_columns().items()}
    return s.select("person", "binding", "window_start", *[v.alias(k) for k, v in cols.items()])


@query("agg_run_length_on", "AGG-17", """
SELECT person, binding, ws AS window_start, CAST(max(r) AS DOUBLE) AS run_length_on FROM (
 SELECT person, binding, ws, g, sum(CASE WHEN num>0.5 THEN 1 ELSE 0 END) AS r FROM (
  SELECT *, sum(CASE WHEN num>0.5 THEN 0 ELSE 1 END) OVER (PARTITION BY person, binding, ws ORDER BY m ROWS UNBOUNDED PRECEDING) AS g FROM densewin WHERE num IS NOT NULL)
 GROUP BY ALL) GROUP BY ALL""")
def agg_run_length_on(spark, sf):
    return A.longest_on_run(transform_win(spark, sf), SERIES, SERIES)


@query("agg_state_dwell", "AGG-22", """
SELECT person, binding, ws AS window_start, round(avg(CAST(str='home' AS DOUBLE)),6) AS dwell FROM densewin WHERE role='person' GROUP BY ALL""")
def agg_state_dwell(spark, sf):
    return A.state_dwell(W.to_windows(roles_iv(spark, sf, "person")), SERIES, "home").withColumn("dwell", r6("dwell"))


@query("agg_state_one_hot", "AGG-23 AGG-24", """
SELECT person, binding, ws AS window_start, s AS last_state, CAST(s='playing' AS DOUBLE) AS is_playing, CAST(s='paused' AS DOUBLE) AS is_paused, CAST(s='idle' AS DOUBLE) AS is_idle
FROM (SELECT person, binding, ws, arg_max(str,m) AS s FROM densewin WHERE role='media' GROUP BY ALL)""")
def agg_state_one_hot(spark, sf):
    media = A.with_run_ids(A.with_positions(roles_iv(spark, sf, "media"), SERIES), SERIES)
    s = A.transform_stats(W.to_windows(media), SERIES)
    return A.one_hot_state(s, SERIES, ["playing", "paused", "idle"])


@query("agg_daily_baseline_deviation", "AGG-25", """
SELECT a.person, a.w AS window_start, round(a.v-avg(b.v),6) AS deviation FROM (SELECT person, minute-minute%30 AS w, avg(value) AS v FROM ev GROUP BY ALL) a
LEFT JOIN (SELECT person, minute-minute%30 AS w, avg(value) AS v FROM ev GROUP BY ALL) b ON a.person=b.person AND a.w%1440=b.w%1440 AND a.w//1440-b.w//1440 BETWEEN 1 AND 7
GROUP BY a.person, a.w, a.v""")
def agg_daily_baseline_deviation(spark, sf):
    v = T.events(spark, sf).groupBy("person", (F.col("minute") - F.col("minute") % 30).alias("window_start")).agg(F.avg("value").alias("value"))
    return A.baseline_deviation(v, ["person"], 7).select("person", "window_start", r6("deviation").alias("deviation"))


@query("agg_sequence_within", "AGG-26", """
SELECT person, minute//1440 AS day, CASE WHEN a IS NOT NULL AND b>=a AND c>=b AND b-a<=600 AND c-b<=600 THEN 1.0::DOUBLE ELSE 0.0 END AS fired FROM (
 SELECT person, minute//1440*1440 AS minute, min(minute) FILTER (WHERE event_type='click') AS a, min(minute) FILTER (WHERE event_type='purchase') AS b, min(minute) FILTER (WHERE event_type='error') AS c FROM ev GROUP BY ALL)""")
def agg_sequence_within(spark, sf):
    first = lambda t: F.min(F.when(F.col("event_type") == t, F.col("minute")))
    d = T.events(spark, sf).groupBy("person", F.floor(F.col("minute") / 1440).alias("day")).agg(
        first("click").alias("a"), first("purchase").alias("b"), first("error").alias("c"))
    fired = A.sequence_within({"a": F.col("a"), "b": F.col("b"), "c": F.col("c")}, 600)
    return d.select("person", "day", fired.alias("fired"))


DOM_SQL = """dom AS (SELECT person, minute, arg_min(room, (-n)*1000+rk) AS room FROM (SELECT person, minute, room, count(*) AS n, min(CASE binding WHEN 'click_presence' THEN 1 WHEN 'error_presence' THEN 2 WHEN 'signup_door' THEN 3 ELSE 4 END) AS rk FROM dchg {where} GROUP BY ALL) GROUP BY ALL)"""


@query("agg_room_transition_count", "AGG-27", "WITH " + DOM_SQL.format(where="WHERE room IN ('kitchen','living')") + """
SELECT person, ws AS window_start, CAST(count(*) FILTER (WHERE p<>room) AS DOUBLE) AS mob_room_switches FROM (SELECT *, lag(room) OVER (PARTITION BY person, ws ORDER BY minute) AS p FROM (SELECT *, minute-minute%30 AS ws FROM dom)) GROUP BY person, ws""")
def agg_room_transition_count(spark, sf):
    return A.room_transition_count(A.change_rows(iv_of(spark, sf)), ["person"], ["kitchen", "living"])


@query("agg_boolean_composites", "AGG-28", """
SELECT person, ws AS window_start, CAST(coalesce(b,0)>=0.5 AND coalesce(p,0)>=0.5 AS DOUBLE) AS both_on, CAST(coalesce(b,0)>0 AS DOUBLE)+CAST(coalesce(p,0)>0 AS DOUBLE) AS how_many, CAST(coalesce(b,0)<0.5 AND coalesce(p,0)<0.5 AS DOUBLE) AS none_on
FROM grid LEFT JOIN (SELECT person, ws, max(num) FILTER (WHERE role='bed') AS b, max(num/100) FILTER (WHERE role='power') AS p FROM densewin WHERE role IN ('bed','power') GROUP BY ALL) USING (person, ws)""")
def agg_boolean_composites(spark, sf):
    m = minutes(spark, sf)
    g = W.window_grid(W.data_bounds(m, ["person"]), ["person"])
    s = A.window_stats(W.to_windows(roles_iv(spark, sf, "bed", "power")), SERIES)
    agg = s.groupBy("person", "window_start").agg(
        F.max(F.when(F.col("role") == "bed", F.col("vmax"))).alias("b"), F.max(F.when(F.col("role") == "power", F.col("vmax") / 100)).alias("p"))
    cols = [F.col("b"), F.col("p")]
    return g.join(agg, ["person", "window_start"], "left").select(
        "person", "window_start", A.co_occurrence_and(cols).alias("both_on"), A.co_occurrence_count(cols).alias("how_many"), A.absence_and(cols).alias("none_on"))


SPEC = [
    {"name": "bed_hour", "transform": "window_mean", "inputs": ["click_bed"], "window_min": 60},
    {"name": "bed_on", "transform": "any_active", "inputs": ["click_bed"]},
    {"name": "light_run", "transform": "run_length_on", "inputs": ["view_light"]},
    {"name": "home_share", "transform": "state_dwell_fraction", "inputs": ["signup_person"], "params": {"state": "home"}},
    {"name": "onehot", "transform": "state_onehot", "inputs": ["view_media"]},
    {"name": "bed_and_home", "transform": "co_occurrence_and", "inputs": ["bed_on", "home_share"]},
]


@query("agg_spec_execution", "AGG-29", """
WITH h AS (SELECT person, we-30 AS ws, avg(num) AS v FROM (SELECT *, (m//30+1)*30+30*unnest(range(0,2)) AS we FROM dense WHERE binding='click_bed') WHERE we<=(fe//30)*30+30 GROUP BY ALL),
b AS (SELECT person, ws, max(CAST(num>0.5 AS DOUBLE)) AS v FROM densewin WHERE binding='click_bed' GROUP BY ALL),
r AS (SELECT person, ws, CAST(max(r) AS DOUBLE) AS v FROM (SELECT person, ws, g, sum(CASE WHEN num>0.5 THEN 1 ELSE 0 END) AS r FROM (
  SELECT *, sum(CASE WHEN num>0.5 THEN 0 ELSE 1 END) OVER (PARTITION BY person, ws ORDER BY m ROWS UNBOUNDED PRECEDING) AS g FROM densewin WHERE binding='view_light') GROUP BY ALL) GROUP BY ALL),
s AS (SELECT person, ws, avg(CAST(str='home' AS DOUBLE)) AS v FROM densewin WHERE binding='signup_person' GROUP BY ALL)
SELECT person, ws AS window_start, round(coalesce(h.v,0),6) AS bed_hour, coalesce(b.v,0) AS bed_on, coalesce(r.v,0) AS light_run, round(coalesce(s.v,0),6) AS home_share,
 CAST(coalesce(b.v,0)>=0.5 AND coalesce(s.v,0)>=0.5 AS DOUBLE) AS bed_and_home
FROM grid LEFT JOIN h USING (person, ws) LEFT JOIN b USING (person, ws) LEFT JOIN r USING (person, ws) LEFT JOIN s USING (person, ws)""")
def agg_spec_execution(spark, sf):
    g = W.window_grid(W.data_bounds(minutes(spark, sf), ["person"]), ["person"])
    feats, _ = A.build_spec(iv_of(spark, sf), SPEC, ["person"])
    out = g.join(feats, ["person", "window_start"], "left").fillna(0.0)
    return out.withColumns({"bed_hour": r6("bed_hour"), "home_share": r6("home_share")})


@query("agg_event_dynamics", "AGG-30", """
SELECT person, ws AS window_start, CAST(sum(n) AS DOUBLE) AS evt_count, CAST(count(*) AS DOUBLE) AS evt_active_sensors, round(max(n)/sum(n),6) AS evt_dominant_share
FROM (SELECT person, minute-minute%30 AS ws, binding, count(*) AS n FROM dchg GROUP BY ALL) GROUP BY person, ws""")
def agg_event_dynamics(spark, sf):
    return A.event_dynamics(A.change_rows(iv_of(spark, sf)), ["person"]).withColumn("evt_dominant_share", r6("evt_dominant_share"))


@query("agg_idle_minutes", "AGG-31", """
SELECT g.person, g.ws AS window_start, CAST(least(coalesce(least(g.ws+30, e.fe)-c.minute, 240),240) AS DOUBLE) AS evt_idle_minutes
FROM grid g JOIN (SELECT person, max(minute) AS fe FROM ev GROUP BY person) e USING (person) ASOF LEFT JOIN (SELECT DISTINCT person, minute FROM dchg) c ON g.person=c.person AND g.ws+30>=c.minute""")
def agg_idle_minutes(spark, sf):
    m = minutes(spark, sf)
    iv = W.intervals(m, ["person"], SERIES)
    g = W.window_grid(W.data_bounds(m, ["person"]), ["person"])
    fe = m.groupBy("person").agg(F.max("minute").alias("last_minute"))
    return A.idle_minutes(A.change_rows(iv), g, fe, ["person"])


@query("agg_mobility_stats", "AGG-32 FUN-03", """
SELECT person, ws AS window_start, CAST(count(*) AS DOUBLE) AS mob_rooms_active, round(max(n)/sum(n),6) AS mob_top_room_frac,
 round(CASE WHEN count(*)>1 THEN -sum(n/t*ln(n/t))/ln(count(*)) ELSE 0 END,6) AS mob_room_entropy
FROM (SELECT *, sum(n) OVER (PARTITION BY person, ws) AS t FROM (SELECT person, minute-minute%30 AS ws, room, count(*) AS n FROM dchg GROUP BY ALL)) GROUP BY person, ws""")
def agg_mobility_stats(spark, sf):
    got = A.mobility_stats(A.change_rows(iv_of(spark, sf)), ["person"]).drop("dominant_room")
    return got.withColumns({"mob_top_room_frac": r6("mob_top_room_frac"), "mob_room_entropy": r6("mob_room_entropy")})


@query("agg_room_switches", "AGG-33", "WITH " + DOM_SQL.format(where="") + """
SELECT person, ws AS window_start, CAST(count(*) FILTER (WHERE p<>room) AS DOUBLE) AS mob_room_switches FROM (SELECT *, lag(room) OVER (PARTITION BY person, ws ORDER BY minute) AS p FROM (SELECT *, minute-minute%30 AS ws FROM dom)) GROUP BY person, ws""")
def agg_room_switches(spark, sf):
    return A.room_switches(A.change_rows(iv_of(spark, sf)), ["person"])


FULL = [("click_bed", "bed"), ("purchase_power", "power"), ("signup_person", "person")]
COMPOSITES = [
    {"name": "in_bed_home", "ast": {"all": [{"feat": "click_bed_occupied", "op": "==", "value": 1}, {"feat": "signup_person_home_last", "op": "==", "value": 1}]}},
    {"name": "quiet", "ast": {"not": {"any": [{"feat": "in_bed_home", "op": ">", "value": 0}, {"feat": "purchase_power_on", "op": ">", "value": 0}]}}},
]


@query("agg_imputed_features", "AGG-34 AGG-35 AGG-36 PRD-02", """
WITH f AS (SELECT person, ws, b.mean AS bm, b.occ, p.mw, p.po, h.hl FROM grid
 LEFT JOIN (SELECT person, ws, avg(num) AS mean, CAST(max(num)>1.5 AS DOUBLE) AS occ FROM densewin WHERE binding='click_bed' GROUP BY ALL) b USING (person, ws)
 LEFT JOIN (SELECT person, ws, max(num) AS mw, CAST(max(num)>10 AS DOUBLE) AS po FROM densewin WHERE binding='purchase_power' GROUP BY ALL) p USING (person, ws)
 LEFT JOIN (SELECT person, ws, CAST(arg_max(str,m)='home' AS DOUBLE) AS hl FROM densewin WHERE binding='signup_person' GROUP BY ALL) h USING (person, ws)),
g AS (SELECT *, coalesce(occ,0)=1 AND coalesce(hl,0)=1 AS ibh, lag(bm) OVER (PARTITION BY person ORDER BY ws) AS lg FROM f)
SELECT person, ws AS window_start, round(coalesce(bm,-1),6) AS click_bed_mean, coalesce(occ,-1) AS click_bed_occupied, coalesce(mw,0) AS purchase_power_max_w, coalesce(hl,-1) AS signup_person_home_last,
 CAST(ibh AS DOUBLE) AS in_bed_home, CAST(NOT (ibh OR coalesce(po,0)>0) AS DOUBLE) AS quiet, round(coalesce(lg,bm,-1),6) AS click_bed_mean_lag1, CAST(bm IS NULL AS DOUBLE) AS click_bed_missing FROM g""")
def agg_imputed_features(spark, sf):
    m = minutes(spark, sf)
    g = W.window_grid(W.data_bounds(m, ["person"]), ["person"])
    iv = W.intervals(m, ["person"], SERIES).where(F.col("binding").isin([b for b, _ in FULL]))
    feats = A.build_features(iv, g, FULL, composites=COMPOSITES, lags=["click_bed_mean"])
    return feats.select("person", "window_start", r6("click_bed_mean").alias("click_bed_mean"), "click_bed_occupied", "purchase_power_max_w",
                        "signup_person_home_last", "in_bed_home", "quiet", r6("click_bed_mean_lag1").alias("click_bed_mean_lag1"), "click_bed_missing")


@query("agg_full_feature_build", "AGG-37 STR-01", """
WITH cnt AS (SELECT person, ws, CAST(sum(n) AS DOUBLE) AS c FROM (SELECT person, minute-minute%30 AS ws, count(*) AS n FROM dchg GROUP BY ALL) GROUP BY ALL),
fr AS (SELECT person, ws, avg(CAST(num>0 AS DOUBLE)) AS v FROM densewin WHERE binding='click_presence' GROUP BY ALL),
en AS (SELECT person, ws, arg_max(num,m)-arg_min(num,m) AS v FROM densewin WHERE binding='error_env' GROUP BY ALL),
st AS (SELECT person, ws, CASE WHEN count(*)>=2 THEN greatest(arg_max(num,m)-arg_min(num,m),0.0) END AS v FROM densewin WHERE binding='purchase_steps' GROUP BY ALL)
SELECT person, ws AS window_start, coalesce(cnt.c,0) AS evt_count, round(coalesce(fr.v,0),6) AS click_presence_frac, round(coalesce(en.v,0),6) AS error_env_delta, coalesce(st.v,0) AS purchase_steps_delta,
 CAST(fr.v IS NULL AS DOUBLE) AS click_presence_missing, CAST(st.v IS NULL AS DOUBLE) AS purchase_steps_missing,
 CAST(CASE WHEN (ws%1440)//60<5 OR (ws%1440)//60>=22 THEN 0 WHEN (ws%1440)//60<11 THEN 1 WHEN (ws%1440)//60<17 THEN 2 ELSE 3 END AS DOUBLE) AS time_bucket
FROM grid LEFT JOIN cnt USING (person, ws) LEFT JOIN fr USING (person, ws) LEFT JOIN en USING (person, ws) LEFT JOIN st USING (person, ws)""")
def agg_full_feature_build(spark, sf):
    f = feature_table(spark, sf)
    return f.select("person", "window_start", "evt_count", r6("click_presence_frac").alias("click_presence_frac"), r6("error_env_delta").alias("error_env_delta"),
                    "purchase_steps_delta", "click_presence_missing", "purchase_steps_missing", "time_bucket")


def feature_table(spark, sf, **kw):
    m = minutes(spark, sf)
    g = W.window_grid(W.data_bounds(m, ["person"]), ["person"])
    return A.build_features(W.intervals(m, ["person"], SERIES), g, binding_roles(), **kw)


