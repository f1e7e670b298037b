"""Source, sink and store queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cols import r6
from ..operators import readings as R
from ..sources import tables as T
from .catalog import query


def now_of(df, col="minute"):
    return df.agg(F.max(col)).scalar()


NOW = "(SELECT max(minute) FROM ev)"


@query("src_payload_to_reading", "SRC-02", """
SELECT event_id, entity_id, state, ts_us FROM (
 SELECT event_id, event_type||'.'||person AS entity_id, CAST(value AS VARCHAR) AS state, CASE WHEN event_id%10=0 THEN 0 ELSE epoch_us(date_trunc('second', ts)) END AS ts_us FROM ev)""")
def src_payload_to_reading(spark, sf):
    ev = T.events(spark, sf)
    stamp = F.when(F.pmod("event_id", F.lit(10)) != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    payload = F.to_json(F.struct(
        F.concat_ws(".", "event_type", "person").alias("entity_id"), F.col("value").cast("string").alias("state"), stamp.alias("last_updated")))
    got = R.parse_payload(ev.select("event_id", payload.alias("payload")), now=F.timestamp_seconds(F.lit(0)))
    return got.select("event_id", "entity_id", "state", F.unix_micros("ts").alias("ts_us"))


@query("src_gap_fill", "SRC-04", f"""
SELECT binding, person, minute, write_seq FROM reading WHERE minute >= {NOW}-360 AND write_seq%3=0""")
def src_gap_fill(spark, sf):
    rd = T.readings(spark, sf)
    stored = rd.where(F.pmod("write_seq", F.lit(3)) != 0)  # what the store kept through an outage
    got = R.missing_rows(rd, stored, now_of(rd), 6, on=("binding", "person", "ts"))
    return got.select("binding", "person", "minute", "write_seq")


@query("src_two_layout_import", "SRC-05", """
WITH m AS (SELECT 'merged' AS layout, person, minute, ts, value FROM ev WHERE event_type IN ('click','view')),
d AS (SELECT 'default' AS layout, person, minute, ts, value FROM ev WHERE event_type='error'),
f AS (SELECT person, CASE WHEN bool_or(layout='merged' AND c=mc) THEN 'merged' ELSE 'default' END AS pick FROM (
  SELECT person, layout, minute//(43200) AS c, min(minute//43200) OVER (PARTITION BY person) AS mc FROM (FROM m UNION ALL FROM d)) GROUP BY person)
SELECT person, minute, arg_max(value, ts) AS value, CAST(CASE layout WHEN 'merged' THEN 0 ELSE 1 END AS INTEGER) AS layout
FROM (FROM m UNION ALL FROM d) JOIN f USING (person) WHERE layout=pick GROUP BY person, minute, layout""")
def src_two_layout_import(spark, sf):
    ev = T.events(spark, sf)
    cols = ["person", "minute", "ts", "value"]
    merged = ev.where(F.col("event_type").isin("click", "view")).select(*cols)
    default = ev.where(F.col("event_type") == "error").select(*cols)
    return R.choose_layout(merged, default, ["person"])


@query("src_recorder_import_counts", "SRC-06", """
SELECT b.name, count(l.l_partkey) AS imported FROM bind b LEFT JOIN lineitem l ON l.l_partkey=b.binding_id GROUP BY b.name""")
def src_recorder_import_counts(spark, sf):
    b = T.bindings(spark, sf)
    li = T.load(spark, sf, "lineitem").select(F.col("l_partkey").alias("binding_id"))
    hist = li.groupBy("binding_id").agg(F.count(F.lit(1)).alias("n"))
    return b.join(hist, "binding_id", "left").select("name", F.coalesce("n", F.lit(0)).alias("imported"))


@query("src_earliest_time", "SRC-07", "SELECT min(minute) AS earliest FROM ev")
def src_earliest_time(spark, sf):
    return R.earliest_time(T.events(spark, sf))


@query("src_retention_floor", "SRC-08 SRC-27", f"""
SELECT person, count(*) FILTER (WHERE minute >= {NOW}-7*1440+60) AS importable, count(*) FILTER (WHERE minute//1440 >= {NOW}//1440-7) AS kept FROM ev GROUP BY person""")
def src_retention_floor(spark, sf):
    ev = T.events(spark, sf)
    now = now_of(ev)
    a = R.keep_since(ev, R.retention_floor(now, 7)).groupBy("person").agg(F.count("*").alias("importable"))
    b = R.apply_retention(ev, now, 7).groupBy("person").agg(F.count("*").alias("kept"))
    return b.join(a, "person", "left").select("person", F.coalesce("importable", F.lit(0)).alias("importable"), "kept")


@query("src_state_coercion", "SRC-09", """
SELECT role, state, num, str, count(*) AS n FROM (
 SELECT role, state, CASE WHEN state IS NULL OR state IN ('unknown','unavailable','') OR role IN ('person','media','alarm_time') THEN NULL
   WHEN lower(trim(state)) IN ('on','true','open','detected','home','playing','occupied') THEN 1.0
   WHEN lower(trim(state)) IN ('off','false','closed','clear','not_home','idle','empty') THEN 0.0 ELSE TRY_CAST(lower(trim(state)) AS DOUBLE) END AS num,
  CASE WHEN state IS NULL OR state IN ('unknown','unavailable','') OR role NOT IN ('person','media','alarm_time') THEN NULL ELSE state END AS str
 FROM (SELECT ['presence','bed','media','person','env','alarm_time'][event_id%6+1] AS role,
  CASE WHEN event_type='error' THEN CAST(k AS VARCHAR) ELSE ['On','off','playing','home','unknown','','not_home',' Open ','abc','unavailable','3.5','idle'][k%12+1] END AS state FROM ev))
GROUP BY ALL""")
def src_state_coercion(spark, sf):
    ev = T.events(spark, sf)
    role = T._pick(["presence", "bed", "media", "person", "env", "alarm_time"], F.pmod("event_id", F.lit(6)))
    words = ["On", "off", "playing", "home", "unknown", "", "not_home", " Open ", "abc", "unavailable", "3.5", "idle"]
    state = F.when(F.col("event_type") == "error", F.col("k").cast("string")).otherwise(T._pick(words, F.pmod("k", F.lit(12))))
    rows = ev.select(role.alias("role"), state.alias("state"))
    num, text = R.coerce_state(F.col("role"), F.col("state"))
    return rows.select("role", "state", num.alias("num"), text.alias("str")).groupBy("role", "state", "num", "str").agg(F.count("*").alias("n"))


@query("src_raw_append_dedupe", "SRC-10 SRC-01", """
SELECT person, binding, minute, arg_max(num, write_seq) AS num, arg_max(str, write_seq) AS str, count(*) AS n FROM reading GROUP BY ALL""")
def src_raw_append_dedupe(spark, sf):
    rd = T.readings(spark, sf)
    keys = ["person", "binding", "minute"]
    last = R.latest_write(rd.select(*keys, "write_seq", "num", "str"), keys, "write_seq")
    n = rd.groupBy(*keys).agg(F.count("*").alias("n"))
    return last.join(n, keys).select(*keys, "num", "str", "n")


@query("src_read_raw_minutes", "SRC-11 WIN-01", f"""
SELECT person, binding, minute, arg_max(num, ts) AS num, arg_max(str, ts) AS str FROM reading, (SELECT min(minute) AS s FROM ev)
WHERE minute >= s+10080-CASE WHEN role IN ('person','alarm_time') THEN 10080 ELSE 0 END AND minute < {NOW} GROUP BY person, binding, minute""")
def src_read_raw_minutes(spark, sf):
    rd = T.readings(spark, sf)
    start = rd.agg(F.min("minute") + 10080).scalar()
    return R.read_minutes(rd, ["person", "binding"], start, now_of(rd)).select("person", "binding", "minute", "num", "str")


@query("src_wide_minutes", "SRC-11", """
SELECT person, minute, max(CASE WHEN binding='view_media' THEN v END) AS view_media, max(CASE WHEN binding='signup_person' THEN v END) AS signup_person, max(CASE WHEN binding='purchase_alarm_time' THEN v END) AS purchase_alarm_time
FROM (SELECT person, minute, binding, arg_max(str, ts) AS v FROM reading WHERE str IS NOT NULL GROUP BY ALL) GROUP BY person, minute""")
def src_wide_minutes(spark, sf):
    rd = T.readings(spark, sf).where(F.col("str").isNotNull())
    m = R.read_minutes(rd, ["person", "binding"], F.lit(0), F.lit(10**9))
    return R.pivot_minutes(m, ["view_media", "signup_person", "purchase_alarm_time"], ["person"])


@query("src_feature_read_pivot", "SRC-12 SRC-13", """
SELECT person, w AS window_start, max(CASE WHEN event_type='click' THEN s END) AS click, max(CASE WHEN event_type='error' THEN s END) AS error, max(CASE WHEN event_type='view' THEN s END) AS "view",
 max(CASE WHEN event_type='purchase' THEN s END) AS purchase, max(CASE WHEN event_type='signup' THEN s END) AS signup
FROM (SELECT person, minute-minute%30 AS w, event_type, round(sum(value),6) AS s FROM ev GROUP BY ALL) GROUP BY person, w""")
def src_feature_read_pivot(spark, sf):
    ev = T.events(spark, sf)
    long = ev.groupBy("person", (F.col("minute") - F.col("minute") % 30).alias("window_start"), F.col("event_type").alias("feature")).agg(r6(F.sum("value")).alias("value"))
    return R.widen_features(long, ["person", "window_start"], ["click", "error", "view", "purchase", "signup"])


@query("src_last_feature_time", "SRC-14", """
SELECT person, event_type AS feature_set, max(minute-minute%30) AS last_window FROM ev GROUP BY ALL""")
def src_last_feature_time(spark, sf):
    ev = T.events(spark, sf)
    return R.last_feature_time(ev.select("person", F.col("event_type").alias("feature_set"), (F.col("minute") - F.col("minute") % 30).alias("window_start")))


@query("src_prediction_upsert", "SRC-15", """
SELECT person, w, arg_max(smoothed, event_id) AS smoothed, round(arg_max(a, event_id),6) AS p_cooking,
 arg_max_null(CASE WHEN a>=0.5 AND smoothed='cooking' THEN NULL WHEN a>=0.5 THEN 'cooking' ELSE 'movie,home' END, event_id) AS pred_set FROM
 (SELECT *, 1 FROM pred5) GROUP BY person, w""")
def src_prediction_upsert(spark, sf):
    p = T.prediction_rows(spark, sf)
    chosen = F.when(F.col("probs")["cooking"] >= 0.5, F.array(F.lit("cooking"))).otherwise(F.array(F.lit("movie"), F.lit("home")))
    kept = R.stored_set(chosen, F.col("smoothed"))
    # a struct keeps the NULL set of the winning row
    rows = p.select("person", "w", "event_id", "smoothed", F.col("probs")["cooking"].alias("p"), F.struct(F.array_join(kept, ",").alias("s")).alias("ps"))
    got = R.latest_write(rows, ["person", "w"], "event_id")
    return got.select("person", "w", "smoothed", r6("p").alias("p_cooking"), F.col("ps.s").alias("pred_set"))


@query("src_label_read", "SRC-16 SRC-17", """
SELECT person, label, source, gold, count(*) AS n_written, count(*) FILTER (WHERE inw) AS n_window FROM (
 SELECT person, label, coalesce(source,'ui') AS source, coalesce(gold,false) AS gold, window_min>=s AND window_min<s+14400 AS inw FROM labelev, (SELECT min(minute)+1440 AS s FROM ev)
 WHERE written_min>=s AND written_min<s+14400) GROUP BY ALL""")
def src_label_read(spark, sf):
    lab = T.label_events(spark, sf)
    start = T.events(spark, sf).agg(F.min("minute") + 1440).scalar()
    got = R.read_labels(lab, start, start + 14400)
    inw = (F.col("window_min") >= start) & (F.col("window_min") < start + 14400)
    return got.groupBy("person", "label", "source", "gold").agg(F.count("*").alias("n_written"), F.count_if(inw).alias("n_window"))


@query("src_prediction_read", "SRC-18", """
SELECT person, w, smoothed, coalesce(model,'') AS model, round(a,6) AS p_cooking FROM (
 SELECT *, row_number() OVER (PARTITION BY person, w ORDER BY (model IS NOT NULL) DESC, event_id DESC) AS rn FROM pred5) WHERE rn=1""")
def src_prediction_read(spark, sf):
    p = T.prediction_rows(spark, sf)
    got = R.read_predictions(p, ["person", "w"], "event_id")
    return R.newest_first(got, "w").select("person", "w", "smoothed", F.coalesce("model", F.lit("")).alias("model"), r6(F.col("probs")["cooking"]).alias("p_cooking"))


@query("src_series_counts", "SRC-19", f"""
SELECT s.person, s.binding, coalesce(c.n,0) AS n FROM (SELECT DISTINCT person, binding FROM reading) s LEFT JOIN
 (SELECT person, binding, count(*) AS n FROM reading WHERE minute > {NOW}-2*1440 GROUP BY ALL) c USING (person, binding)""")
def src_series_counts(spark, sf):
    rd = T.readings(spark, sf)
    series = rd.select("person", "binding").distinct()
    return R.series_counts(rd, series, ["person", "binding"], now_of(rd), 2)


@query("src_total_count", "SRC-20", f"SELECT count(*) AS n FROM reading WHERE minute > {NOW}-1440")
def src_total_count(spark, sf):
    rd = T.readings(spark, sf)
    return R.total_count(rd, now_of(rd))


@query("src_active_series", "SRC-21", f"SELECT DISTINCT person, binding FROM reading WHERE minute > {NOW}-120")
def src_active_series(spark, sf):
    rd = T.readings(spark, sf)
    return R.active_series(rd, ["person", "binding"], now_of(rd), 120)


@query("src_traces", "SRC-22", f"""
SELECT person, binding, row_number() OVER (PARTITION BY person, binding ORDER BY b)-1 AS idx, round(m,6) AS mean FROM (
 SELECT person, binding, epoch_us(ts)//(greatest(60, ((e-s)*60)//60)*1000000) AS b, avg(num) AS m FROM reading, (SELECT min(minute) AS s, max(minute) AS e FROM ev)
 WHERE num IS NOT NULL AND minute>=s AND minute<e GROUP BY ALL)""")
def src_traces(spark, sf):
    rd = T.readings(spark, sf)
    b = rd.agg(F.min("minute")).scalar()
    got = R.traces(rd, ["person", "binding"], b, now_of(rd), 60)
    return got.select("person", "binding", F.posexplode("trace").alias("idx", "mean")).select(
        "person", "binding", F.col("idx").cast("long").alias("idx"), r6("mean").alias("mean"))


@query("src_heartbeat_gaps", "SRC-23", """
SELECT job, minute, minute-p AS gap_min FROM (SELECT job, minute, lag(minute) OVER (PARTITION BY job ORDER BY minute) AS p FROM (SELECT DISTINCT event_type AS job, minute FROM ev)) WHERE minute-p > 2*60""")
def src_heartbeat_gaps(spark, sf):
    return R.heartbeat_gaps(T.events(spark, sf).select(F.col("event_type").alias("job"), "minute"), 60)


@query("src_purge_person", "SRC-24", """
SELECT 'raw' AS tbl, count(*) FILTER (WHERE person='p3') AS removed, count(*) FILTER (WHERE person<>'p3') AS kept FROM reading
UNION ALL SELECT 'bindings', count(*) FILTER (WHERE person_id='p3'), count(*) FILTER (WHERE person_id IS NULL OR person_id<>'p3') FROM bind""")
def src_purge_person(spark, sf):
    raw = R.purge_report(T.readings(spark, sf), "p3").withColumn("tbl", F.lit("raw"))
    return raw.unionByName(R.purge_report(T.bindings(spark, sf), "p3", "person_id").withColumn("tbl", F.lit("bindings")))


@query("src_orphaned_persons", "SRC-25", """
SELECT DISTINCT 'c'||o_custkey AS person FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal>0)""")
def src_orphaned_persons(spark, sf):
    data = T.load(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("person"))
    return R.orphaned_persons(data, T.persons(spark, sf).where("enabled"))


@query("src_relink_identity", "SRC-26", """
SELECT CASE WHEN person='p1' THEN 'p0' ELSE person END AS person, provenance, count(*) AS n FROM labelev GROUP BY ALL""")
def src_relink_identity(spark, sf):
    return R.relink(T.label_events(spark, sf), "p1", "p0").groupBy("person", "provenance").agg(F.count("*").alias("n"))


@query("src_source_profile", "SRC-28", f"""
SELECT person AS dataset, count(DISTINCT binding) AS series, count(*) FILTER (WHERE minute>{NOW}-1440) AS points_24h, min(minute) AS earliest FROM reading GROUP BY person""")
def src_source_profile(spark, sf):
    rd = T.readings(spark, sf).withColumn("dataset", F.col("person"))
    return R.source_profile(rd, "dataset", "binding", now_of(rd))


@query("src_latest_per_person", "SRC-29", """
SELECT person, w, smoothed, confidence FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY w DESC) AS rn FROM timeline) WHERE rn=1""")
def src_latest_per_person(spark, sf):
    return R.per_person_latest(T.timeline(spark, sf)).select("person", "w", "smoothed", "confidence")


@query("src_settings_table", "SRC-30 FUN-06", """
SELECT event_type AS key, CAST(json_extract(props,'$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL""")
def src_settings_table(spark, sf):
    s = T.load(spark, sf, "events").select(F.col("event_type").alias("key"), F.col("props").alias("value_json"))
    return R.parse_settings(s, "k long").groupBy("key", F.col("value.k").alias("k")).agg(F.count("*").alias("n"))
