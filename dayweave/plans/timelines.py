"""Timeline summary, run and smoothing queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.cols import map_text, r6
from ..operators import recipes as A
from ..operators import runs as Q
from ..operators import timeline as S
from ..operators.chains import viterbi_relabel
from ..sources import tables as T
from .catalog import query
from .windows_features import iv_of

P = ["person"]


def tl(spark, sf):
    return S.prepare(T.timeline(spark, sf))


def tl_now(rows):
    return rows.agg(F.max("w") + 30).scalar()


NOW = "(SELECT max(w)+30 FROM tl)"


@query("sum_time_budget", "SUM-01", "SELECT person, state, count(*)*30.0::DOUBLE AS minutes FROM tl GROUP BY ALL")
def sum_time_budget(spark, sf):
    return S.time_budget(tl(spark, sf), P)


@query("sum_day_totals", "SUM-02", """
SELECT person, date, coalesce(string_agg(state||'='||printf('%.1f', m), ',' ORDER BY state) FILTER (WHERE state<>'unknown'),'') AS totals, coalesce(sum(m) FILTER (WHERE state='unknown'),0) AS unknown_min,
 coalesce(sum(f) FILTER (WHERE state<>'unknown'),0) AS fact_min, coalesce(sum(m-f) FILTER (WHERE state<>'unknown'),0) AS inferred_min
FROM (SELECT person, date, state, count(*)*30.0::DOUBLE AS m, count(*) FILTER (WHERE basis='fact')*30.0::DOUBLE AS f FROM tl GROUP BY ALL) GROUP BY person, date""")
def sum_day_totals(spark, sf):
    d = S.day_totals(tl(spark, sf), P)
    return d.withColumn("totals", map_text("totals", 1))


@query("sum_coverage", "SUM-03 SUM-04", """
SELECT person, count(*)*30.0::DOUBLE AS total_min, count(*) FILTER (WHERE state<>'unknown')*30.0::DOUBLE AS classified_min, round(count(*) FILTER (WHERE state<>'unknown')/count(*),4) AS coverage,
 round(count(*) FILTER (WHERE state<>'unknown' AND basis='fact')/count(*) FILTER (WHERE state<>'unknown'),4) AS known_fraction FROM tl GROUP BY person""")
def sum_coverage(spark, sf):
    return S.coverage(tl(spark, sf), P)


@query("sum_rhythm_grid", "SUM-05", "SELECT person, dow, hour, state, count(*)*30.0::DOUBLE AS minutes FROM tl WHERE state<>'unknown' GROUP BY ALL")
def sum_rhythm_grid(spark, sf):
    return S.rhythm_grid(tl(spark, sf), P)


@query("sum_sleep_away_days", "SUM-06", "SELECT person, date, state, count(*)*30.0::DOUBLE AS minutes FROM tl WHERE state IN ('asleep','away') GROUP BY ALL")
def sum_sleep_away_days(spark, sf):
    return S.minutes_per_day(tl(spark, sf), P, ["asleep", "away"])


@query("sum_sessions", "SUM-07", """
SELECT person, state, count(*) AS episodes, round(avg("end"-start),1) AS mean_min, round(median("end"-start),1) AS median_min, CAST(max("end"-start) AS DOUBLE) AS longest_min, any_value(lw) AS last_w, any_value(lb) AS last_basis
FROM epi JOIN (SELECT person, state, max(w) AS lw, arg_max(basis, w) AS lb FROM tl GROUP BY ALL) USING (person, state) WHERE state<>'unknown' GROUP BY person, state""")
def sum_sessions(spark, sf):
    return S.sessions(tl(spark, sf), P)


@query("sum_regularity", "SUM-08", """
SELECT person, count(*) AS nights, CASE WHEN count(*)>=2 THEN CAST(round(avg(wk)) AS DOUBLE) END AS wake_avg_min, CASE WHEN count(*)>=2 THEN CAST(round(stddev_pop(wk)) AS DOUBLE) END AS wake_spread_min,
 CASE WHEN count(*)>=2 THEN CASE WHEN stddev_pop(wk)<=20 THEN 'very regular' WHEN stddev_pop(wk)<=45 THEN 'fairly regular' WHEN stddev_pop(wk)<=90 THEN 'varies' ELSE 'irregular' END END AS wake_band,
 CASE WHEN count(*)>=2 THEN CAST(round((avg(bd)+1080)%1440) AS DOUBLE) END AS bed_avg_min, CASE WHEN count(*)>=2 THEN CAST(round(stddev_pop(bd)) AS DOUBLE) END AS bed_spread_min,
 CASE WHEN count(*)>=2 THEN CASE WHEN stddev_pop(bd)<=20 THEN 'very regular' WHEN stddev_pop(bd)<=45 THEN 'fairly regular' WHEN stddev_pop(bd)<=90 THEN 'varies' ELSE 'irregular' END END AS bed_band
FROM (SELECT person, (start%1440-1080+1440)%1440 AS bd, "end"%1440 AS wk FROM epi WHERE state='asleep' AND "end"-start>=60) GROUP BY person""")
def sum_regularity(spark, sf):
    r = S.regularity(tl(spark, sf), P, min_sleep_min=60.0)
    # NULL below two nights, so the minutes travel as doubles
    return r.withColumns({c: F.col(c).cast("double") for c in ("wake_avg_min", "wake_spread_min", "bed_avg_min", "bed_spread_min")})


@query("sum_transitions", "SUM-09", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY n DESC, src, dst) AS rank FROM (SELECT person, src, state AS dst, count(*) AS n, round(count(*)/sum(count(*)) OVER (PARTITION BY person, src),4) AS prob FROM (
 SELECT person, state, w, lag(state) OVER o AS src, lag(w) OVER o AS pw FROM tl WINDOW o AS (PARTITION BY person ORDER BY w)) WHERE w-pw=30 AND src<>'unknown' AND state<>'unknown' AND src<>state GROUP BY person, src, state)) WHERE rank<=24""")
def sum_transitions(spark, sf):
    return S.transitions(tl(spark, sf), P)


CALL_SQL = """SELECT {keys}, basis_out AS basis, round(r,1) AS recent_avg_min, round(p,1) AS prior_avg_min, round(r-p,1) AS delta_min, round(pct,4) AS pct, dir AS direction FROM (
 SELECT *, CASE WHEN p=0 THEN 1.0 WHEN r=0 THEN -1.0 ELSE (r-p)/p END AS pct, CASE WHEN p=0 THEN 'new' WHEN r=0 THEN 'stopped' WHEN r>p THEN 'up' ELSE 'down' END AS dir FROM ({src}) WHERE NOT (r=0 AND p=0))
 WHERE (dir IN ('new','stopped') AND greatest(r,p)>=20) OR (abs(r-p)>=20 AND abs(pct)>=0.25)"""


@query("sum_period_trends", "SUM-10", "SELECT *, row_number() OVER (PARTITION BY person ORDER BY abs(delta_min) DESC, activity) AS rank FROM (" + CALL_SQL.format(keys="person, activity", src=f"""
 SELECT person, state AS activity, count(*) FILTER (WHERE w>={NOW}-10080)*30.0/7 AS r, count(*) FILTER (WHERE w<{NOW}-10080 AND w>={NOW}-20160)*30.0/7 AS p,
  CASE WHEN f>=0.8 THEN 'fact' WHEN f<=0.05 THEN 'inferred' ELSE 'mixed' END AS basis_out FROM (SELECT *, coalesce(count(*) FILTER (WHERE basis='fact' AND w>={NOW}-10080) OVER g / nullif(count(*) FILTER (WHERE w>={NOW}-10080) OVER g,0),0) AS f FROM tl WHERE state<>'unknown' WINDOW g AS (PARTITION BY person, state)) GROUP BY person, state, f""") + ") QUALIFY rank<=6")
def sum_period_trends(spark, sf):
    rows = tl(spark, sf)
    return S.trends(rows, P, tl_now(rows))


def counters(spark, sf):
    ev = T.events(spark, sf).where(F.col("event_type").isin("purchase", "error"))
    w = Window.partitionBy("person", "event_type", F.floor(F.col("minute") / 1440)).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return ev.select("person", F.when(F.col("event_type") == "purchase", "daily_steps").otherwise("distance_km").alias("signal"), "minute", "ts",
                     F.sum("k").over(w).cast("double").alias("value"))


def charger(spark, sf):
    ev = T.events(spark, sf).where("event_type = 'signup'")
    word = F.when(F.col("k") % 8 == 0, "Charging").when(F.col("k") % 4 == 0, "1.0").otherwise("off")
    return ev.select("person", "minute", word.alias("state"))


@query("sum_counter_deltas", "SUM-11 WIN-14", """
SELECT person, signal, bucket, CASE WHEN value < p-abs(p)*0.5 THEN greatest(value,0) ELSE greatest(value-p,0) END AS amount FROM (
 SELECT *, lag(value) OVER (PARTITION BY person, signal ORDER BY bucket) AS p FROM (SELECT person, signal, minute-minute%30 AS bucket, arg_max(value, ts) AS value FROM ctr GROUP BY ALL)) WHERE p IS NOT NULL""")
def sum_counter_deltas(spark, sf):
    return S.counter_deltas(counters(spark, sf), ["person", "signal"])


@query("sum_charging_windows", "SUM-12", "SELECT person, bucket FROM chg")
def sum_charging_windows(spark, sf):
    return S.charging_windows(charger(spark, sf), P)


@query("sum_body_summary", "SUM-13", f"""
SELECT person, any_value(signal) AS "primary", round(sum(amt),2) AS primary_total, wn*30 AS worn_min, cn*30 AS charging_min, greatest(sp-wn-cn,0)*30 AS absent_min, round(least(1.0,wn/sp),4) AS coverage,
 count(*) FILTER (WHERE amt>=100)*30 AS active_min, count(*) FILTER (WHERE amt<100)*30 AS sedentary_min
FROM (SELECT person, signal, bucket, amount AS amt FROM prim) JOIN (SELECT person, count(DISTINCT bucket) AS wn, min(bucket) AS w0 FROM worn GROUP BY person) USING (person)
JOIN (SELECT person, count(*) AS cn, min(bucket) AS c0 FROM chg GROUP BY person) USING (person), LATERAL (SELECT ({NOW}-least(w0,c0))//30 AS sp) GROUP BY person, wn, cn, sp""")
def sum_body_summary(spark, sf):
    return S.body_summary(counters(spark, sf), charger(spark, sf), P, tl_now(tl(spark, sf)))


@query("sum_body_days", "SUM-13", """
SELECT person, strftime(make_timestamp(bucket*60000000),'%Y-%m-%d') AS date, signal, round(sum(amount),2) AS total, count(*)*30 AS covered_min FROM worn GROUP BY ALL""")
def sum_body_days(spark, sf):
    return S.body_days(counters(spark, sf), charger(spark, sf), P)


@query("jon_body_by_activity", "JON-05", """
SELECT t.person, t.state, round(sum(p.amount),2) AS amount FROM tl t JOIN prim p ON p.person=t.person AND p.bucket=t.w WHERE t.state<>'unknown' GROUP BY ALL""")
def jon_body_by_activity(spark, sf):
    return S.body_by_activity(S.worn_deltas(counters(spark, sf), charger(spark, sf), P), tl(spark, sf), P)


@query("sum_active_trends", "SUM-14", "SELECT * EXCLUDE (basis) FROM (" + CALL_SQL.format(keys="person, activity", src=f"""
 SELECT person, CASE WHEN amount>=100 THEN 'active' ELSE 'sedentary' END AS activity, count(*) FILTER (WHERE bucket>={NOW}-10080)*30.0/7 AS r, count(*) FILTER (WHERE bucket<{NOW}-10080 AND bucket>={NOW}-20160)*30.0/7 AS p, 'inferred' AS basis_out FROM prim GROUP BY ALL""") + ")")
def sum_active_trends(spark, sf):
    return S.active_trends(counters(spark, sf), charger(spark, sf), P, tl_now(tl(spark, sf)))


@query("jon_household_pairs", "JON-04", """
SELECT a.home, a.person AS person_a, b.person AS person_b, a.state AS a, b.state AS b, count(*) AS n FROM tl a JOIN tl b ON a.home=b.home AND a.w=b.w AND a.person<>b.person WHERE a.state<>'unknown' AND b.state<>'unknown' GROUP BY ALL""")
def jon_household_pairs(spark, sf):
    return S.household_pairs(tl(spark, sf)).groupBy("home", "person_a", "person_b", "a", "b").agg(F.count("*").alias("n"))


@query("sum_household_cooccurrence", "SUM-15 SUM-16", """
WITH ok AS (SELECT 'p'||c_custkey AS person FROM customer WHERE c_custkey<8 AND c_acctbal>0),
pr AS (SELECT a.person AS person_a, b.person AS person_b, a.state AS a, b.state AS b, count(*) AS n FROM tl a JOIN tl b ON a.home=b.home AND a.w=b.w AND a.person<>b.person WHERE a.state<>'unknown' AND b.state<>'unknown' AND a.person IN (FROM ok) AND b.person IN (FROM ok) GROUP BY ALL)
SELECT person_a, person_b, a, b, n*30.0::DOUBLE AS minutes, round(n/t,4) AS frac, row_number() OVER (PARTITION BY person_a, person_b ORDER BY n DESC, a) AS rank FROM (
 SELECT *, sum(n) OVER (PARTITION BY person_a, person_b, a) AS t, row_number() OVER (PARTITION BY person_a, person_b, a ORDER BY n DESC, b) AS rn FROM pr) WHERE rn=1 AND t*30>=60 QUALIFY rank<=12""")
def sum_household_cooccurrence(spark, sf):
    c = T.load(spark, sf, "customer")
    consent = c.select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("person_id"), F.lit(True).alias("enabled"), (F.col("c_acctbal") > 0).alias("opted_in"))
    return S.cooccurrence(S.household_pairs(S.consenting(tl(spark, sf), consent)))


@query("sum_footprint", "SUM-17", """
SELECT person, round(avg(rooms) FILTER (WHERE ws>=n-10080),1) AS rooms, round(avg(ent) FILTER (WHERE ws>=n-10080),6) AS roaming, round(avg(switches) FILTER (WHERE ws>=n-10080),6) AS pacing,
 CASE WHEN avg(switches) FILTER (WHERE ws>=n-10080)<1 THEN 'calm' WHEN avg(switches) FILTER (WHERE ws>=n-10080)<4 THEN 'some moving about' ELSE 'lots of moving about' END AS pacing_label,
 CASE WHEN abs(avg(ent) FILTER (WHERE ws>=n-10080)-avg(ent) FILTER (WHERE ws<n-10080))>=0.12 THEN CASE WHEN avg(ent) FILTER (WHERE ws>=n-10080)>avg(ent) FILTER (WHERE ws<n-10080) THEN 'roaming more than last week' ELSE 'more settled than last week' END END AS trend,
 count(*) FILTER (WHERE ws>=n-10080) AS windows
FROM mobil, (SELECT max(w)+30 AS n FROM tl) WHERE ws>=n-20160 GROUP BY person HAVING count(*) FILTER (WHERE ws>=n-10080)>0""")
def sum_footprint(spark, sf):
    ch = A.change_rows(iv_of(spark, sf))
    feats = A.mobility_stats(ch, P).join(A.room_switches(ch, P), ["person", "window_start"], "left").fillna(0.0, subset=["mob_room_switches"])
    got = S.footprint(feats, P, tl_now(tl(spark, sf)))
    return got.withColumns({"roaming": r6("roaming"), "pacing": r6("pacing")})


@query("sum_hourly_autocorrelation", "SUM-18", """
SELECT a.person, count(*) AS hours, round(any_value(d.c),5) AS daily, round(any_value(e.c),5) AS weekly FROM hourly a JOIN (SELECT a.person, corr(a.x,b.x) AS c FROM hourly a JOIN hourly b ON a.person=b.person AND b.h=a.h+24 GROUP BY a.person) d USING (person)
 JOIN (SELECT a.person, corr(a.x,b.x) AS c FROM hourly a JOIN hourly b ON a.person=b.person AND b.h=a.h+168 GROUP BY a.person) e USING (person) GROUP BY a.person""")
def sum_hourly_autocorrelation(spark, sf):
    h = S.hourly_counts(tl(spark, sf), P, F.col("confidence"))
    got = S.autocorrelation(h, P, {"daily": 24, "weekly": 168})
    return got.withColumns({"daily": F.round("daily", 5), "weekly": F.round("weekly", 5)})


@query("sum_dominant_period", "SUM-19", """
WITH x AS (SELECT person, h-min(h) OVER g AS t, x-avg(x) OVER g AS v, count(*) OVER g AS n FROM hourly WINDOW g AS (PARTITION BY person)),
f AS (SELECT person, n, k, pow(sum(v*cos(2*pi()*k*t/n)),2)+pow(sum(v*sin(2*pi()*k*t/n)),2) AS pw FROM (SELECT *, unnest(range(2, n//2+1)) AS k FROM x) GROUP BY ALL)
SELECT person, n AS hours, round(n/arg_max(k,pw),4) AS period_h FROM f GROUP BY person, n""")
def sum_dominant_period(spark, sf):
    return S.dominant_period(S.hourly_counts(tl(spark, sf), P, F.col("confidence")), P)


DUR = "CASE WHEN {m}//60=0 THEN ({m}%60)||'m' WHEN {m}%60=0 THEN ({m}//60)||'h' ELSE ({m}//60)||'h'||({m}%60)||'m' END"


@query("sum_digest_facts", "SUM-37 FUN-07", f"""
SELECT person, mostly, slept, "out", coverage_pct FROM (SELECT person, string_agg(state||' '||{DUR.format(m='m')}, ', ' ORDER BY r) AS mostly FROM (SELECT person, state, CAST(count(*)*30 AS BIGINT) AS m, row_number() OVER (PARTITION BY person ORDER BY count(*) DESC, state) AS r FROM tl WHERE state<>'unknown' GROUP BY person, state) WHERE r<=3 GROUP BY person)
JOIN (SELECT person, {DUR.format(m='sl')} AS slept, {DUR.format(m='ou')} AS "out", pct AS coverage_pct FROM (SELECT person, CAST(round(count(*) FILTER (WHERE state='asleep')*30/7) AS BIGINT) AS sl, CAST(round(count(*) FILTER (WHERE state='away')*30/7) AS BIGINT) AS ou,
  CAST(round(round(count(*) FILTER (WHERE state<>'unknown')/count(*),4)*100) AS BIGINT) AS pct FROM tl GROUP BY person)) USING (person)""")
def sum_digest_facts(spark, sf):
    rows = tl(spark, sf)
    return S.digest(S.time_budget(rows, P), S.minutes_per_day(rows, P, ["asleep", "away"]), S.coverage(rows, P), P)


@query("sum_heat_map", "SUM-38", """
SELECT person, dow, block, dominant, minutes, round(0.25+0.75*minutes/max(minutes) OVER (PARTITION BY person),4) AS intensity FROM (
 SELECT person, dow, hour//4 AS block, arg_min(state, rn) AS dominant, sum(m) AS minutes FROM (SELECT *, row_number() OVER (PARTITION BY person, dow, hour//4 ORDER BY m DESC, state) AS rn FROM (
  SELECT person, dow, (hour//4)*4 AS hour, state, count(*)*30.0::DOUBLE AS m FROM tl WHERE state<>'unknown' GROUP BY ALL)) GROUP BY ALL)""")
def sum_heat_map(spark, sf):
    return S.heat_map(S.rhythm_grid(tl(spark, sf), P), P, 4)


@query("sum_week_mix", "SUM-38", """
SELECT person, state, round(count(*)/sum(count(*)) OVER (PARTITION BY person),4) AS share, round(count(*)*0.5/7,2) AS hours_per_day FROM tl WHERE state<>'unknown' GROUP BY person, state""")
def sum_week_mix(spark, sf):
    return S.week_mix(tl(spark, sf), P)


@query("sum_hour_majority", "SUM-43", """
SELECT person, date, hour, arg_min(state, rn) AS state FROM (SELECT person, date, hour, state, row_number() OVER (PARTITION BY person, date, hour ORDER BY count(*) DESC, state) AS rn FROM tl GROUP BY person, date, hour, state) GROUP BY ALL""")
def sum_hour_majority(spark, sf):
    return S.hour_majority(tl(spark, sf), P)


# --- runs -------------------------------------------------------------------------------------


@query("seq_episodes", "SEQ-01", """SELECT person, state, start, "end", windows FROM epi""")
def seq_episodes(spark, sf):
    return S.episodes(tl(spark, sf), P)


@query("seq_today_segments", "SEQ-02", """
SELECT person, state, basis, min(w) AS start, max(w)+30 AS "end", count(*) AS windows FROM (SELECT *, sum(nw) OVER (PARTITION BY person ORDER BY w) AS run FROM
 (SELECT *, CASE WHEN lag(w) OVER o + 30 = w AND lag(state) OVER o = state AND lag(basis) OVER o=basis THEN 0 ELSE 1 END AS nw FROM (SELECT * REPLACE (CASE WHEN state='unknown' THEN 'unknown' ELSE basis END AS basis) FROM tl WHERE date=(SELECT max(date) FROM tl)) WINDOW o AS (PARTITION BY person ORDER BY w))) GROUP BY person, run, state, basis""")
def seq_today_segments(spark, sf):
    rows = tl(spark, sf)
    return S.today_segments(rows, P, rows.agg(F.max("w")).scalar())


def preds5(spark, sf):
    p = T.prediction_rows(spark, sf)
    conf = (F.lit(20) + F.pmod("k", F.lit(80))).cast("double") / 100
    return p.groupBy("person", "w").agg(F.max_by(F.struct("smoothed", conf.alias("confidence")), "event_id").alias("r")).select("person", "w", "r.*")


@query("seq_label_runs", "SEQ-03 STR-07", 'SELECT person, label, start, "end", minutes, round(mean_conf,6) AS mean_conf, mid FROM runs5')
def seq_label_runs(spark, sf):
    return Q.label_runs(preds5(spark, sf), P).drop("run").withColumn("mean_conf", r6("mean_conf"))


HUMAN_SQL = "(SELECT person, window_min FROM labelev WHERE provenance='confirmed')"


def human_labels(spark, sf):
    return T.label_events(spark, sf).where("provenance = 'confirmed'").select("person", "window_min")


@query("jon_uncovered_runs", "JON-09", f"""
SELECT person, label, start, "end" FROM runs5 r WHERE NOT EXISTS (SELECT 1 FROM {HUMAN_SQL} l WHERE l.person=r.person AND l.window_min BETWEEN r.start AND r."end")""")
def jon_uncovered_runs(spark, sf):
    runs = Q.label_runs(preds5(spark, sf), P)
    return Q.uncovered(runs, human_labels(spark, sf), P).select("person", "label", "start", "end")


@query("seq_recap_picks", "SEQ-04", f"""
WITH s AS (SELECT *, (1-mean_conf)+0.15*(coalesce(CAST(lag(minutes) OVER o<35 AS INTEGER),0)+coalesce(CAST(lead(minutes) OVER o<35 AS INTEGER),0)) AS score FROM runs5 WINDOW o AS (PARTITION BY person ORDER BY start)),
e AS (SELECT * FROM s WHERE minutes>=15 AND NOT EXISTS (SELECT 1 FROM {HUMAN_SQL} l WHERE l.person=s.person AND l.window_min BETWEEN s.start AND s."end") AND (person, mid) NOT IN (SELECT person, minute-minute%5 FROM ev WHERE event_type='view' AND k<5)),
q AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY md5('recap|'||person||'|'||start), start)=1 AS probe FROM e)
SELECT person, label, start, "end", CAST(rk AS INTEGER) AS rank, CASE WHEN rk=1 THEN 'explore' ELSE 'uncertain' END AS reason FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY probe DESC, score DESC, start) AS rk FROM q) WHERE rk<=4""")
def seq_recap_picks(spark, sf):
    asked = T.events(spark, sf).where("event_type = 'view' and k < 5").select("person", (F.col("minute") - F.col("minute") % 5).alias("asked_min"))
    return Q.recap_picks(Q.label_runs(preds5(spark, sf), P), human_labels(spark, sf), asked.distinct(), P)


@query("seq_marker_flags", "SEQ-05", """
WITH mk AS (SELECT o_custkey%5 AS a, o_orderkey%5 AS b, min(o_orderkey) AS ord FROM orders GROUP BY ALL),
m AS (SELECT CASE WHEN a=0 THEN NULL ELSE ['any','cooking','movie','away','home'][a+1] END AS f, ['asleep','cooking','movie','away','home'][b+1] AS t, ord FROM mk)
SELECT person, start, prev_state, state, 'm'||min(ord) AS marker FROM (SELECT *, lag(state) OVER (PARTITION BY person ORDER BY start) AS prev_state FROM epi) e JOIN m ON m.t=e.state AND (m.f IS NULL OR m.f=e.prev_state) WHERE prev_state IS NOT NULL GROUP BY ALL""")
def seq_marker_flags(spark, sf):
    o = T.load(spark, sf, "orders")
    m = o.groupBy((F.col("o_custkey") % 5).alias("a"), (F.col("o_orderkey") % 5).alias("b")).agg(F.min("o_orderkey").alias("ord"))
    markers = m.select(F.when(F.col("a") != 0, T._pick(["any", "cooking", "movie", "away", "home"], F.col("a"))).alias("from_state"),
                       T._pick(["asleep", "cooking", "movie", "away", "home"], F.col("b")).alias("to_state"), F.concat(F.lit("m"), F.col("ord").cast("string")).alias("marker"), "ord")
    return Q.marker_flags(S.episodes(tl(spark, sf), P), markers, P)


PAIR_SQL = "pairs AS (SELECT person, a, state AS b, w FROM (SELECT person, state, w, lag(state) OVER o AS a, lag(w) OVER o AS pw FROM tl WINDOW o AS (PARTITION BY person ORDER BY w)) WHERE w-pw=30), st AS (SELECT DISTINCT person, state FROM tl), shape AS (SELECT x.person, x.state AS a, y.state AS b FROM st x JOIN st y USING (person))"


@query("seq_transition_matrix", "SEQ-06", f"""WITH {PAIR_SQL}
SELECT person, a, b, round((coalesce(n,0)+1)/sum(coalesce(n,0)+1) OVER (PARTITION BY person, a),6) AS p FROM shape LEFT JOIN (SELECT person, a, b, count(*) AS n FROM pairs GROUP BY ALL) USING (person, a, b)""")
def seq_transition_matrix(spark, sf):
    return Q.transition_matrix(tl(spark, sf), P).withColumn("p", r6("p"))


@query("seq_daypart_matrices", "SEQ-07", f"""WITH {PAIR_SQL}, c AS (SELECT person, coalesce(part,'all') AS part, a, b, count(*) AS n FROM (SELECT *, CASE WHEN h<5 OR h>=22 THEN '0' WHEN h<11 THEN '1' WHEN h<17 THEN '2' ELSE '3' END AS part FROM (SELECT *, (w//60)%24 AS h FROM pairs)) GROUP BY GROUPING SETS ((person, part, a, b), (person, a, b)))
SELECT person, part, a, b, round((coalesce(n,0)+1)/sum(coalesce(n,0)+1) OVER (PARTITION BY person, part, a),6) AS p FROM (SELECT *, unnest(['0','1','2','3','all']) AS part FROM shape) LEFT JOIN c USING (person, part, a, b)""")
def seq_daypart_matrices(spark, sf):
    return Q.daypart_matrices(tl(spark, sf), P).withColumn("p", r6("p"))


HIST_SQL = "hist AS (SELECT person, state, least(n,48) AS d, count(*) AS runs FROM (SELECT *, lead(start) OVER (PARTITION BY person ORDER BY start) AS ns FROM (SELECT person, state, start, \"end\", windows AS n FROM epi)) WHERE ns=\"end\" GROUP BY ALL), haz AS (SELECT person, state, d, (runs+1)/(sum(runs) OVER (PARTITION BY person, state ORDER BY d DESC)+2) AS hazard FROM hist QUALIFY sum(runs) OVER (PARTITION BY person, state)>=5)"


@query("seq_duration_histogram", "SEQ-08", f"WITH {HIST_SQL} SELECT person, state, d, runs FROM hist")
def seq_duration_histogram(spark, sf):
    return Q.duration_histogram(tl(spark, sf), P)


@query("seq_duration_hazard", "SEQ-09", f"WITH {HIST_SQL} SELECT person, state, d, round(hazard,6) AS hazard FROM haz")
def seq_duration_hazard(spark, sf):
    return Q.duration_hazard(Q.duration_histogram(tl(spark, sf), P), P).withColumn("hazard", r6("hazard"))


@query("seq_duration_adjusted", "SEQ-10", f"""WITH {PAIR_SQL}, {HIST_SQL},
m AS (SELECT person, a, b, (coalesce(n,0)+1)/sum(coalesce(n,0)+1) OVER (PARTITION BY person, a) AS p FROM shape LEFT JOIN (SELECT person, a, b, count(*) AS n FROM pairs GROUP BY ALL) USING (person, a, b)),
j AS (SELECT m.*, d, least(greatest(1-hazard,0.05),0.98) AS stay, sum(CASE WHEN a<>b THEN p ELSE 0 END) OVER (PARTITION BY m.person, a, d) AS off FROM m JOIN haz ON haz.person=m.person AND haz.state=m.a)
SELECT person, a, d, b, round(CASE WHEN off<=0 THEN p WHEN a=b THEN stay ELSE (1-stay)*p/off END,6) AS p FROM j""")
def seq_duration_adjusted(spark, sf):
    rows = tl(spark, sf)
    haz = Q.duration_hazard(Q.duration_histogram(rows, P), P)
    return Q.duration_adjusted(Q.transition_matrix(rows, P), haz, P).withColumn("p", r6("p"))


@query("seq_forward_filter", "SEQ-11", """
WITH mm AS (SELECT cls, avg(v) AS t FROM (SELECT unnest(['cooking','movie']) AS cls, unnest([a,b]) AS v FROM pred5) GROUP BY cls), t AS (SELECT (SELECT t FROM mm WHERE cls='cooking') AS tc, (SELECT t FROM mm WHERE cls='movie') AS tm),
u AS (SELECT event_id, a*(0.85*tc+0.05) AS x, b*(0.85*tm+0.05) AS y, c*(0.85/3+0.05) AS z FROM pred5, t)
SELECT event_id, round(x/(x+y+z),5) AS cooking, round(y/(x+y+z),5) AS movie, round(z/(x+y+z),5) AS home FROM u""")
def seq_forward_filter(spark, sf):
    p = T.prediction_rows(spark, sf)
    mean = p.agg(F.create_map(F.lit("cooking"), F.avg(F.col("probs")["cooking"]), F.lit("movie"), F.avg(F.col("probs")["movie"]))).scalar()
    with_prior = p.select("event_id", "probs", mean.alias("prior"))
    q = with_prior.select("event_id", Q.forward_filter(F.col("probs"), F.col("prior")).alias("q"))
    return q.select("event_id", *[F.round(F.col("q")[c], 5).alias(c) for c in ("cooking", "movie", "home")])


@query("seq_hysteresis", "SEQ-12 STR-06", """
WITH RECURSIVE s AS (SELECT person, w, predicted, confidence, row_number() OVER (PARTITION BY person ORDER BY w) AS i FROM tl),
r AS (SELECT person, i, w, predicted, confidence, predicted AS pub FROM s WHERE i=1 UNION ALL
 SELECT s.person, s.i, s.w, s.predicted, s.confidence, CASE WHEN s.predicted=r.pub OR s.confidence>=r.confidence+0.25 OR r.predicted=s.predicted THEN s.predicted ELSE r.pub END FROM r JOIN s ON s.person=r.person AND s.i=r.i+1)
SELECT person, w, predicted, pub AS published FROM r""")
def seq_hysteresis(spark, sf):
    return Q.hysteresis(tl(spark, sf), P).select("person", "w", "predicted", "published")


@query("seq_viterbi", "SEQ-13", f"""
WITH RECURSIVE {PAIR_SQL}, m AS (SELECT person, a, b, 0.85*(coalesce(n,0)+1)/sum(coalesce(n,0)+1) OVER (PARTITION BY person, a)+0.05 AS p FROM shape LEFT JOIN (SELECT person, a, b, count(*) AS n FROM pairs GROUP BY ALL) USING (person, a, b)),
cls AS (SELECT unnest(['cooking','movie','home']) AS c, unnest([1,2,3]) AS i),
t AS (SELECT q.person, list(ln(coalesce(p, 0.85/3+0.05)) ORDER BY x.i) FILTER (y.i=1) AS c1, list(ln(coalesce(p, 0.85/3+0.05)) ORDER BY x.i) FILTER (y.i=2) AS c2, list(ln(coalesce(p, 0.85/3+0.05)) ORDER BY x.i) FILTER (y.i=3) AS c3
 FROM (SELECT DISTINCT person FROM pred5) q, cls x, cls y LEFT JOIN m ON m.person=q.person AND m.a=x.c AND m.b=y.c GROUP BY q.person),
r AS (SELECT person, w-w%30 AS w, avg(a) AS e1, avg(b) AS e2, avg(c) AS e3 FROM pred5 GROUP BY ALL),
s AS (SELECT *, sum(nw) OVER (PARTITION BY person ORDER BY w) AS seg FROM (SELECT *, CASE WHEN lag(w) OVER (PARTITION BY person ORDER BY w)+30=w THEN 0 ELSE 1 END AS nw FROM r)),
n AS (SELECT person, seg, w, row_number() OVER (PARTITION BY person, seg ORDER BY w) AS i, count(*) OVER (PARTITION BY person, seg) AS len, [ln(greatest(e1,1e-9)), ln(greatest(e2,1e-9)), ln(greatest(e3,1e-9))] AS e FROM s),
f AS (SELECT person, seg, i, w, len, e AS s, [0,0,0]::BIGINT[] AS back FROM n WHERE i=1
 UNION ALL SELECT person, seg, i, w, len, [list_max(k1)+e[1], list_max(k2)+e[2], list_max(k3)+e[3]], [list_position(k1,list_max(k1)), list_position(k2,list_max(k2)), list_position(k3,list_max(k3))]::BIGINT[] FROM (
  SELECT n.*, [f.s[1]+c1[1],f.s[2]+c1[2],f.s[3]+c1[3]] AS k1, [f.s[1]+c2[1],f.s[2]+c2[2],f.s[3]+c2[3]] AS k2, [f.s[1]+c3[1],f.s[2]+c3[2],f.s[3]+c3[3]] AS k3 FROM f JOIN n ON n.person=f.person AND n.seg=f.seg AND n.i=f.i+1 JOIN t ON t.person=f.person)),
b AS (SELECT person, seg, i, w, CAST(list_position(s, list_max(s)) AS BIGINT) AS idx, back FROM f WHERE i=len
 UNION ALL SELECT f.person, f.seg, f.i, f.w, b.back[b.idx], f.back FROM b JOIN f ON f.person=b.person AND f.seg=b.seg AND f.i=b.i-1)
SELECT person, w, ['cooking','movie','home'][idx] AS label FROM b""")
def seq_viterbi(spark, sf):
    p = T.prediction_rows(spark, sf)
    slot = F.col("w") - F.col("w") % 30
    rows = p.groupBy("person", slot.alias("w")).agg(*[F.avg(F.col("probs")[c]).alias(f"p_{c}") for c in ("cooking", "movie", "home")])
    return viterbi_relabel(rows, Q.transition_matrix(tl(spark, sf), P), P, ["cooking", "movie", "home"])


@query("seq_published_run_length", "SEQ-14", """
SELECT person, w, state, row_number() OVER (PARTITION BY person, run ORDER BY w) AS run_len FROM (SELECT *, sum(nw) OVER (PARTITION BY person ORDER BY w) AS run FROM
 (SELECT *, CASE WHEN lag(w) OVER o + 30 = w AND lag(state) OVER o = state THEN 0 ELSE 1 END AS nw FROM tl WINDOW o AS (PARTITION BY person ORDER BY w)))""")
def seq_published_run_length(spark, sf):
    return Q.published_run_length(tl(spark, sf), P).select("person", "w", "state", "run_len")


def model_records(spark, sf):
    o = T.load(spark, sf, "orders")
    return o.select(F.concat(F.lit("p"), F.pmod("o_custkey", F.lit(8)).cast("string")).alias("person"), F.col("o_orderkey").alias("model_id"),
                    F.expr("unix_micros(cast(o_orderdate as timestamp)) div 60000000").alias("trained"), F.round(F.col("o_totalprice") / 600000, 3).alias("headline"),
                    (F.col("o_orderstatus") != "P").alias("promoted"), (F.col("o_orderkey") * 13 % 29).alias("confirmed"))


@query("seq_improvement_streak", "SEQ-15 SEQ-16", """
WITH r AS (SELECT *, row_number() OVER o AS i, max(headline) FILTER (WHERE promoted) OVER (PARTITION BY person ORDER BY trained, model_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best, lag(confirmed) OVER o AS pc FROM mrec WINDOW o AS (PARTITION BY person ORDER BY trained, model_id)),
q AS (SELECT person, max(i)-coalesce(max(i) FILTER (WHERE (promoted AND (best IS NULL OR headline>best+0.005)) OR confirmed-pc>=15),0) AS streak, max(trained) AS last_trained FROM r GROUP BY person)
SELECT person, streak, last_trained, CAST(CASE WHEN streak<3 THEN 1 WHEN streak<5 THEN 3 ELSE 7 END AS INTEGER) AS interval_days, (SELECT max(trained) FROM mrec)-last_trained >= (CASE WHEN streak<3 THEN 1 WHEN streak<5 THEN 3 ELSE 7 END)*1440-120 AS due FROM q""")
def seq_improvement_streak(spark, sf):
    rec = model_records(spark, sf)
    return Q.training_due(Q.improvement_streak(rec, P, burst=15), rec.agg(F.max("trained")).scalar())


@query("seq_room_graph", "SEQ-17", """
WITH e AS (SELECT DISTINCT person, least(p,room) AS x, greatest(p,room) AS y FROM (SELECT person, room, lag(room) OVER (PARTITION BY person ORDER BY minute) AS p FROM domroom) WHERE p<>room)
SELECT person, x AS src, y AS dst FROM e UNION ALL SELECT person, y, x FROM e""")
def seq_room_graph(spark, sf):
    return Q.room_edges(A.dominant_rooms(A.change_rows(iv_of(spark, sf)), P), P)


@query("seq_hop_distance", "SEQ-18", """
WITH RECURSIVE e AS (SELECT DISTINCT n_regionkey AS k, 'r'||(c_custkey%11) AS a, 'r'||((c_custkey+c_nationkey)%11) AS b FROM customer JOIN nation ON c_nationkey=n_nationkey),
g AS (SELECT k, a AS src, b AS dst FROM e WHERE a<>b UNION SELECT k, b, a FROM e WHERE a<>b), keys AS (SELECT DISTINCT k FROM g),
r AS (SELECT k, 'r0' AS room, 0 AS hops FROM keys UNION SELECT g.k, g.src, r.hops+1 FROM r JOIN g ON g.k=r.k AND g.dst=r.room WHERE r.hops<5)
SELECT CAST(k AS BIGINT) AS k, 'bed' AS anchor, room, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY ALL""")
def seq_hop_distance(spark, sf):
    c, n = T.load(spark, sf, "customer"), T.load(spark, sf, "nation")
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").cast("long").alias("k"), F.concat(F.lit("r"), (F.col("c_custkey") % 11).cast("string")).alias("a"),
        F.concat(F.lit("r"), ((F.col("c_custkey") + F.col("c_nationkey")) % 11).cast("string")).alias("b")).where("a <> b")
    edges = rows.select("k", F.col("a").alias("src"), F.col("b").alias("dst")).union(rows.select("k", "b", "a")).distinct()
    targets = edges.select("k").distinct().select("k", F.lit("bed").alias("anchor"), F.lit("r0").alias("room"))
    return Q.hop_distance(edges, targets, ["k"])


@query("seq_anchor_rooms", "SEQ-19", """
WITH b AS (SELECT *, binding_id%100 AS home FROM bind WHERE room IS NOT NULL), k AS (SELECT *, unnest(['bed','door']) AS anchor FROM b)
SELECT home, anchor, coalesce(arg_min(room, binding_id) FILTER (WHERE role=anchor), min(room) FILTER (WHERE (anchor='bed' AND regexp_matches(lower(room),'bed|bedroom|slaap')) OR (anchor='door' AND regexp_matches(lower(room),'\\bhall\\b|hallway|entr|entree|foyer|porch|voordeur')))) AS room
FROM k GROUP BY home, anchor HAVING room IS NOT NULL""".replace("\\\\b", "\\b"))
def seq_anchor_rooms(spark, sf):
    b = T.bindings(spark, sf).withColumn("home", F.col("binding_id") % 100)
    return Q.anchor_rooms(b, ["home"])


@query("seq_drift_trend", "SEQ-20", """
SELECT person, string_agg(printf('%.3f', headline), ',' ORDER BY mid) AS trend FROM (SELECT person, model_id AS mid, headline, row_number() OVER (PARTITION BY person ORDER BY model_id DESC) AS r FROM mrec) WHERE r<=10 GROUP BY person""")
def seq_drift_trend(spark, sf):
    h = model_records(spark, sf).select("person", F.col("model_id").alias("at"), F.col("headline").alias("psi"))
    got = Q.drift_trend(h, P)
    return got.select("person", F.array_join(F.transform("trend", lambda v: F.format_string("%.3f", v)), ",").alias("trend"))




def fires_moves_events(spark, sf):
    """Marker fires: click events with a low second field."""
    return T.events(spark, sf).where("event_type = 'click' and k < 40").select("person", F.col("minute").alias("fire"))
