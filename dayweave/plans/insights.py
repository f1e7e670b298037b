"""Profiles, coverage, capability, advisories, cards, sets, gates and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cols import r6
from ..operators import insight as I
from ..operators import joins as J
from ..operators import metadata as M
from ..operators import scoring as C
from ..operators import stats as X
from ..operators import topk as K
from ..functions import lexicon as L
from ..sources import tables as T
from .catalog import query, view
from .metadata import sql_case
from .statistics import sp, wil
from .timelines import P, fires_moves_events, model_records, tl, tl_now

NOW = "(SELECT max(minute) FROM ev)"


def now_min(spark, sf):
    return T.events(spark, sf).agg(F.max("minute")).scalar()


# --- label and time joins ---------------------------------------------------------------------------


@query("jon_label_merge", "JON-01", """
WITH b AS (SELECT person, window_min-window_min%30 AS w, coalesce(activity,label) AS l, provenance, gold, row_number() OVER (PARTITION BY person, window_min-window_min%30 ORDER BY CASE provenance WHEN 'bootstrap' THEN 0 WHEN 'llm' THEN 1 WHEN 'discovered' THEN 2 ELSE 3 END DESC, arrival DESC) AS rn FROM labelev)
SELECT t.person, t.w, coalesce(l, state) AS label, coalesce(provenance,'bootstrap') AS provenance, coalesce(gold,false) AS gold FROM tl t LEFT JOIN b ON b.person=t.person AND b.w=t.w AND rn=1""")
def jon_label_merge(spark, sf):
    rows = tl(spark, sf).select("person", "w", F.col("state").alias("label"))
    return J.merge_labels(rows, T.label_events(spark, sf), P)


@query("jon_confirmed_exclusion", "JON-02", "SELECT person, w, state FROM tl WHERE (person, w) NOT IN (SELECT person, window_min-window_min%30 FROM labelev WHERE provenance='confirmed')")
def jon_confirmed_exclusion(spark, sf):
    lab = T.label_events(spark, sf).where("provenance = 'confirmed'").select("person", (F.col("window_min") - F.col("window_min") % 30).alias("w"))
    return J.without(tl(spark, sf).select("person", "w", "state"), lab, ["person", "w"])


@query("jon_unpredicted_windows", "JON-03", "SELECT person, ws AS w FROM grid WHERE (person, ws) NOT IN (SELECT person, w FROM tl)")
def jon_unpredicted_windows(spark, sf):
    from ..operators.windows import data_bounds, window_grid

    g = window_grid(data_bounds(T.events(spark, sf), P), P).withColumnRenamed("window_start", "w")
    return J.without(g, T.timeline(spark, sf), ["person", "w"])


@query("jon_before_after", "JON-06", """
WITH a AS (SELECT DISTINCT person, minute-minute%30 AS w FROM ev WHERE event_type='error' AND k<20)
SELECT x.person, x.w, x.state AS before, y.state AS after FROM (SELECT a.person, a.w, t.state FROM a ASOF LEFT JOIN tl t ON t.person=a.person AND t.w<a.w) x JOIN (SELECT a.person, a.w, t.state FROM a ASOF LEFT JOIN tl t ON t.person=a.person AND t.w>a.w+30) y USING (person, w)""")
def jon_before_after(spark, sf):
    asks = T.events(spark, sf).where("event_type = 'error' and k < 20").select("person", (F.col("minute") - F.col("minute") % 30).alias("w")).distinct()
    return J.around(asks, tl(spark, sf).select("person", "w", "state"), P)


@query("jon_nearest_window", "JON-07", """
WITH a AS (SELECT DISTINCT person, minute AS ask FROM ev WHERE event_type='view' AND k<30)
SELECT a.person, a.ask, arg_min(t.w, abs(t.w-ask)*1000000000+t.w) AS w, arg_min(t.state, abs(t.w-ask)*1000000000+t.w) AS state FROM a JOIN tl t ON t.person=a.person AND t.w BETWEEN a.ask-40 AND a.ask+40 GROUP BY ALL""")
def jon_nearest_window(spark, sf):
    asks = T.events(spark, sf).where("event_type = 'view' and k < 30").select("person", F.col("minute").alias("ask")).distinct()
    return J.nearest(asks, tl(spark, sf).select("person", "w", "state"), P)


@query("jon_lead_lookup", "JON-10", """
SELECT person, w, (person, w-60) IN (SELECT person, minute-minute%30 FROM ev WHERE event_type='click' AND k<40) AS fired FROM tl""")
def jon_lead_lookup(spark, sf):
    return J.fired_before(tl(spark, sf).select("person", "w"), fires_moves_events(spark, sf), P, F.lit(60))


@query("jon_confused_pairs", "JON-21", """
WITH c AS (SELECT person, y, predicted, count(*) AS n FROM sp GROUP BY ALL), s AS (SELECT person, y, sum(n) AS s FROM c GROUP BY ALL)
SELECT a.person, a.y AS a, b.y AS b, round((coalesce(ab.n,0)+coalesce(ba.n,0))/(a.s+b.s),3) AS rate FROM s a JOIN s b ON a.person=b.person AND a.y<b.y LEFT JOIN c ab ON ab.person=a.person AND ab.y=a.y AND ab.predicted=b.y LEFT JOIN c ba ON ba.person=a.person AND ba.y=b.y AND ba.predicted=a.y WHERE (coalesce(ab.n,0)+coalesce(ba.n,0))/(a.s+b.s)>=0.15""")
def jon_confused_pairs(spark, sf):
    return J.confused_pairs(X.confusion(sp(spark, sf), P), P)


@query("jon_flow_state", "JON-23", """
SELECT p.person, coalesce(w.n,0) AS windows, coalesce(l.n,0) AS labels, coalesce(l.c,0) AS confirmed, coalesce(t.n,0) AS predictions, t.m AS model, coalesce((SELECT max(w)+30 FROM tl)-w.lw>60,true) AS stalled FROM (SELECT DISTINCT person FROM ev) p
LEFT JOIN (SELECT person, count(*) AS n, max(w) AS lw FROM tl GROUP BY person) w USING (person) LEFT JOIN (SELECT person, count(*) AS n, count(*) FILTER (WHERE provenance='confirmed') AS c FROM labelev GROUP BY person) l USING (person) LEFT JOIN (SELECT person, count(*) AS n, arg_max(model_version, w) AS m FROM tl GROUP BY person) t USING (person)""")
def jon_flow_state(spark, sf):
    rows = T.timeline(spark, sf)
    return J.flow_state(T.events(spark, sf).select("person").distinct(), rows, T.label_events(spark, sf), rows, tl_now(tl(spark, sf)))


# --- profiles -----------------------------------------------------------------------------------------


view("hist", """SELECT person, event_type AS entity, minute, epoch_us(ts)/1000000.0::DOUBLE AS sec, CASE event_type WHEN 'click' THEN CAST(CAST(value>30 AS INT) AS VARCHAR) WHEN 'view' THEN ['playing','paused','idle'][k%3+1] WHEN 'signup' THEN CAST(k%10 AS VARCHAR) WHEN 'purchase' THEN 'tag'||k ELSE CAST(value AS VARCHAR) END AS state FROM ev""")
KIND_SQL = "CASE WHEN num>=0.95 THEN CASE WHEN bin THEN 'boolean' WHEN whole AND dv<=12 THEN 'numeric_discrete' ELSE 'numeric_continuous' END WHEN dv<=12 THEN 'enum' ELSE 'string' END"
view("kinds", f"SELECT person, entity, n AS samples, dv AS distinct_values, {KIND_SQL} AS value_type FROM (SELECT person, entity, count(*) AS n, count(DISTINCT state) AS dv, avg(CAST(TRY_CAST(state AS DOUBLE) IS NOT NULL AS INT)) AS num, coalesce(bool_and(TRY_CAST(state AS DOUBLE) IN (0,1)),false) AS bin, coalesce(bool_and(TRY_CAST(state AS DOUBLE)=round(TRY_CAST(state AS DOUBLE))),false) AS whole FROM hist GROUP BY ALL)")


def history(spark, sf):
    ev = T.events(spark, sf)
    k, v = F.col("k"), F.col("value")
    state = (
        F.when(F.col("event_type") == "click", (v > 30).cast("int").cast("string")).when(F.col("event_type") == "view", T._pick(["playing", "paused", "idle"], k % 3))
        .when(F.col("event_type") == "signup", (k % 10).cast("string")).when(F.col("event_type") == "purchase", F.concat(F.lit("tag"), k.cast("string"))).otherwise(v.cast("string")))
    return ev.select("person", F.col("event_type").alias("entity"), "minute", "ts", (F.unix_micros("ts") / 1000000.0).alias("sec"), state.alias("state"))


@query("sum_value_types", "SUM-21", "SELECT person, entity, samples, distinct_values, value_type FROM kinds")
def sum_value_types(spark, sf):
    return I.value_types(history(spark, sf), ["person", "entity"])


PROFILE_SQL = """
WITH h AS (SELECT *, lag(sec) OVER o AS ps, lag(state) OVER o AS pst, TRY_CAST(state AS DOUBLE) AS num FROM hist WINDOW o AS (PARTITION BY person, entity ORDER BY sec)), e AS (SELECT max(sec)+7200 AS e FROM hist),
a AS (SELECT person, entity, round(count(*) FILTER (WHERE state<>pst)/30,3) AS changes_per_day, round(median(sec-ps),1) AS median_gap_s, max(sec-ps) AS lg, min(sec) AS f, max(sec) AS l, round(min(num),4) AS vmin, round(max(num),4) AS vmax, round(quantile_cont(num,0.05),4) AS p05, round(median(num),4) AS median, round(quantile_cont(num,0.95),4) AS p95, round(coalesce(avg(CAST(num>=TRY_CAST(pst AS DOUBLE) AS INT)),1),4) AS rising_share FROM h GROUP BY ALL)
SELECT person, entity, value_type, distinct_values, changes_per_day, median_gap_s, round(greatest(lg,e-l)/3600,2) AS longest_gap_h, CASE WHEN distinct_values<=1 THEN 1 ELSE round(least(greatest(lg,e-l)/greatest(l-f,e-f),1),4) END AS flatline_frac, round((e-l)/3600,2) AS age_h, vmin, p05, median, p95, vmax, rising_share FROM a JOIN kinds USING (person, entity), e"""


def profile(spark, sf):
    h = history(spark, sf)
    return I.entity_profile(h, ["person", "entity"], h.agg(F.max("sec") + 7200).scalar(), 30)


@query("sum_entity_profile", "SUM-20", PROFILE_SQL)
def sum_entity_profile(spark, sf):
    return profile(spark, sf)


@query("sum_reliability_verdict", "SUM-22", f"""
SELECT person, entity, CASE WHEN distinct_values<=1 OR flatline_frac=1 THEN 'unusable' WHEN changes_per_day<1.5 OR flatline_frac>=0.9 OR longest_gap_h>=72 THEN 'suspect' ELSE 'ok' END AS verdict FROM (SELECT * REPLACE (changes_per_day/4 AS changes_per_day) FROM ({PROFILE_SQL}))""".replace("<1.5", "<0.5"))
def sum_reliability_verdict(spark, sf):
    p = profile(spark, sf)
    v = I.reliability_verdict({"value_type": F.col("value_type"), "distinct": F.col("distinct_values"), "flat": F.col("flatline_frac"), "changes": F.col("changes_per_day") / 4, "gap_h": F.col("longest_gap_h")})
    return p.select("person", "entity", v["verdict"].alias("verdict"))


@query("sum_entity_catalog", "SUM-23", """
SELECT person, entity, string_agg(state, ',' ORDER BY sec) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY person, entity ORDER BY sec DESC) AS r FROM hist) WHERE r<=5 GROUP BY ALL""")
def sum_entity_catalog(spark, sf):
    h = history(spark, sf).withColumn("id", F.concat_ws("|", "person", "entity"))
    meta = h.select("id", "person", "entity").distinct()
    return I.catalog(meta, h.select("id", "ts", "state"), "id", True).select("person", "entity", F.array_join("samples", ",").alias("samples"))


@query("sum_sensor_health", "SUM-24", f"""
WITH w AS (SELECT * FROM reading WHERE minute>{NOW}-168*60), b AS (SELECT person, binding, minute//168 AS b, avg(num) AS m FROM w WHERE num IS NOT NULL GROUP BY ALL),
t AS (SELECT person, binding, count(*) AS points, sum(CASE WHEN mx>mn THEN (m-mn)/(mx-mn) ELSE 0.5 END) AS ss FROM (SELECT *, min(m) OVER (PARTITION BY person, binding) AS mn, max(m) OVER (PARTITION BY person, binding) AS mx FROM b) GROUP BY ALL),
a AS (SELECT person, binding, count(*) AS n, max(minute) AS l, coalesce(max(num)>min(num),false) OR coalesce(min(str)<>max(str),false) AS mv FROM w GROUP BY ALL)
SELECT s.person, s.binding, CASE WHEN a.n IS NULL THEN 'no_data' WHEN mv THEN 'alive' ELSE 'constant' END AS status, round(coalesce(a.n,0)/7.0,2) AS obs_per_day, coalesce(l>{NOW}-15,false) AS recent, coalesce(points,0) AS points, round(coalesce(ss,0),6) AS spark_sum FROM (SELECT DISTINCT person, binding FROM reading) s LEFT JOIN a USING (person, binding) LEFT JOIN t USING (person, binding)""")
def sum_sensor_health(spark, sf):
    rd = T.readings(spark, sf)
    return I.sensor_health(rd.select("person", "binding").distinct(), rd, ["person", "binding"], now_min(spark, sf))


@query("sum_class_balance", "SUM-25", f"SELECT person, label, count(*) AS n FROM labelev WHERE window_min>{NOW}-10080 GROUP BY ALL")
def sum_class_balance(spark, sf):
    return I.class_balance(T.label_events(spark, sf), P, now_min(spark, sf))


@query("sum_presence_coverage", "SUM-26", f"""
SELECT p.person, coalesce(c.ok,false) AS covered FROM (SELECT DISTINCT person FROM ev) p LEFT JOIN (SELECT person, bool_or(true) AS ok FROM reading WHERE role='person' AND minute>{NOW}-360 GROUP BY person) c USING (person)""")
def sum_presence_coverage(spark, sf):
    rd = T.readings(spark, sf)
    live = rd.where(F.col("minute") > now_min(spark, sf) - 360).groupBy("person", "role").agg(F.lit("alive").alias("status"))
    return I.presence_coverage(rd.select("person").distinct(), live)


TIER_B = f"greatest(1,least(3,coalesce(tier_option, {sql_case(L.ROLE_TIER, 'role')})))"


@query("sum_methodology", "SUM-27", f"""
SELECT room, sensors, direct, behavioral, ambient, roles, row_number() OVER (ORDER BY direct, sensors, room)=1 AS weakest FROM (SELECT room, count(*) AS sensors, count(*) FILTER (WHERE {TIER_B}=1) AS direct, count(*) FILTER (WHERE {TIER_B}=2) AS behavioral, count(*) FILTER (WHERE {TIER_B}=3) AS ambient, count(DISTINCT role) AS roles FROM bind WHERE enabled AND room IS NOT NULL GROUP BY room)""")
def sum_methodology(spark, sf):
    return I.methodology(T.bindings(spark, sf), M.binding_tier(F.col("role"), F.col("tier_option")))


@query("sum_room_roles", "SUM-28", "SELECT room, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM bind WHERE enabled AND room IS NOT NULL GROUP BY room")
def sum_room_roles(spark, sf):
    return I.room_roles(T.bindings(spark, sf)).select("room", F.array_join("roles", ",").alias("roles"))


@query("sum_blind_spots", "SUM-29", """
WITH pr AS (SELECT least(y,predicted) AS a, greatest(y,predicted) AS b, count(*) AS n FROM sp WHERE y<>predicted GROUP BY ALL), su AS (SELECT y, count(*) AS s FROM sp GROUP BY y),
ar AS (SELECT * FROM (VALUES ('F','Kitchen'),('O','kitchen'),('P','Attic')) t(activity, room)), rr AS (SELECT room, list_distinct(list(role)) AS roles FROM bind WHERE enabled AND room IS NOT NULL AND role NOT IN ('presence','power') GROUP BY room),
am AS (SELECT y AS activity, round(avg(p_P)*1.6,3) AS share FROM sp GROUP BY y),
g AS (SELECT 'confused_pair' AS kind, round(least(1.0, round(n/(x.s+z.s),3)*1.5),3) AS severity, ra.room, a||'+'||b AS activities FROM pr JOIN su x ON x.y=a JOIN su z ON z.y=b JOIN ar ra ON ra.activity=a WHERE n/(x.s+z.s)>=0.15
 UNION ALL SELECT 'weak_evidence', round(least(1.0,share),3), room, activity FROM am JOIN ar USING (activity) WHERE share>=0.5 UNION ALL SELECT 'ghost_room', 0.6, room, '' FROM (SELECT DISTINCT room FROM ar) WHERE room NOT IN (SELECT room FROM rr))
SELECT kind, severity, room, activities, CASE WHEN kind='ghost_room' OR roles IS NULL OR NOT list_contains(roles,'presence') THEN 'presence' WHEN NOT list_contains(roles,'power') THEN 'power' WHEN NOT list_contains(roles,'door') THEN 'door' WHEN NOT list_contains(roles,'env') THEN 'env' END AS suggested_role FROM g LEFT JOIN rr USING (room)""")
def sum_blind_spots(spark, sf):
    rows = sp(spark, sf)
    pairs = J.confused_pairs(X.confusion(rows, []), [])
    where = F.create_map(F.lit("F"), F.lit("Kitchen"), F.lit("O"), F.lit("kitchen"), F.lit("P"), F.lit("Attic"))
    acts = rows.select(F.col("y").alias("activity")).distinct().withColumn("room", where[F.col("activity")])
    share = rows.groupBy(F.col("y").alias("activity")).agg(F.round(F.avg("p_P") * 1.6, 3).alias("share"))
    rooms = I.room_roles(T.bindings(spark, sf).where("role not in ('presence', 'power')"))
    return I.blind_spots(pairs, acts, share, rooms, acts.select("room"))


def top_partner(rows):
    from pyspark.sql import functions as F

    pairs = J.confused_pairs(X.confusion(rows, P), P, 0.0)
    both = pairs.select("person", F.col("a").alias("class"), F.col("b").alias("partner"), "rate").union(pairs.select("person", "b", "a", "rate"))
    return both.groupBy("person", "class").agg(F.max("rate").alias("rate"), F.min_by("partner", F.struct((-F.col("rate")).alias("neg"), "partner")).alias("partner"))


@query("sum_capability", "SUM-30", """
WITH c AS (SELECT person, y, predicted, count(*) AS n FROM sp GROUP BY ALL), s AS (SELECT person, y AS class, sum(n) AS su, coalesce(sum(n) FILTER (WHERE y=predicted),0) AS tp FROM c GROUP BY ALL), d AS (SELECT person, predicted AS class, sum(n) AS sd FROM c GROUP BY ALL),
f AS (SELECT person, class, su, round(CASE WHEN tp>0 THEN 2*tp/(su+sd) ELSE 0 END,4) AS f1 FROM s LEFT JOIN d USING (person, class)),
pr AS (SELECT x.person, x.class, z.class AS partner, round((coalesce(ab.n,0)+coalesce(ba.n,0))/(x.su+z.su),3) AS rate FROM s x JOIN s z ON x.person=z.person AND x.class<>z.class LEFT JOIN c ab ON ab.person=x.person AND ab.y=x.class AND ab.predicted=z.class LEFT JOIN c ba ON ba.person=x.person AND ba.y=z.class AND ba.predicted=x.class),
t AS (SELECT person, class, arg_min(partner, rn) AS partner, max(rate) AS rate FROM (SELECT *, row_number() OVER (PARTITION BY person, class ORDER BY rate DESC, partner) AS rn FROM pr) GROUP BY ALL),
g AS (SELECT person, count(*) FILTER (WHERE provenance='confirmed' AND gold) AS ng FROM sp GROUP BY person)
SELECT person, class, f1, CAST(su AS BIGINT) AS support, CASE WHEN su<10 OR ng<30 THEN 'learning' WHEN f1>=0.7 AND rate<=0.4 THEN 'reliable' WHEN rate>0.4 THEN 'unreliable' WHEN f1<0.5 THEN 'unreliable' ELSE 'learning' END AS tier, CASE WHEN rate>0.4 THEN partner END AS confused_with FROM f JOIN t USING (person, class) JOIN g USING (person)""")
def sum_capability(spark, sf):
    rows = sp(spark, sf)
    models = rows.groupBy("person").agg(F.count_if((F.col("provenance") == "confirmed") & F.col("gold")).alias("n_gold")).withColumns({"validated": F.lit(False), "beats_flat": F.lit(True)})
    return I.capability(X.class_report(X.confusion(rows, P), P), top_partner(rows), models, P)


def insight_rows(spark, sf):
    rows = sp(spark, sf)
    acc = X.accuracy_by_provenance(rows, P).where("basis = 'gold'").select("person", F.col("n").alias("n_gold"), F.col("accuracy").alias("accuracy_gold"))
    flat = X.accuracy_by_provenance(rows, P).where("basis = 'bootstrap'").select("person", F.col("accuracy").alias("flat_accuracy"))
    drift = T.label_events(spark, sf).groupBy("person").agg((F.count("*") % 2).alias("drifted"))
    slices = rows.groupBy("person", F.col("y").alias("activity"), F.col("provenance").alias("daypart")).agg(F.count("*").alias("n"), F.round(F.avg("correct"), 4).alias("accuracy"))
    return I.model_insight(acc, X.calibration(rows, T.CLASSES, P).select("person", "ece"), flat, drift, slices, P)


INSIGHT_SQL = """
a AS (SELECT person, count(*) AS n_gold, round(avg(correct),4) AS ag FROM sp WHERE provenance='confirmed' AND gold GROUP BY person), f AS (SELECT person, round(avg(correct),4) AS fa FROM sp WHERE provenance<>'confirmed' GROUP BY person), d AS (SELECT person, count(*)%2 AS dr FROM labelev GROUP BY person),
e AS (SELECT person, round(sum(CASE WHEN bin>=1 THEN abs(sa-sc) ELSE 0 END)/sum(n),4) AS ece FROM (SELECT person, least(ceil(conf*10),10) AS bin, count(*) AS n, sum(conf) AS sc, sum(correct) AS sa FROM sp GROUP BY ALL) GROUP BY person),
w AS (SELECT person, y, provenance, round(avg(correct),4) AS acc, row_number() OVER (PARTITION BY person ORDER BY round(avg(correct),4), y, provenance) AS rn FROM sp GROUP BY person, y, provenance HAVING count(*)>=5),
ins AS (SELECT person, n_gold, CASE WHEN n_gold>=30 THEN ag END AS accuracy_gold, ece, ece<=0.1 AS trustworthy, ag>=fa AS beats_flat, dr AS drifted, y AS weak_activity, provenance AS weak_daypart, acc AS weak_accuracy FROM a LEFT JOIN e USING (person) LEFT JOIN f USING (person) LEFT JOIN d USING (person) LEFT JOIN (SELECT * FROM w WHERE rn=1) USING (person))"""


@query("sum_model_insight", "SUM-31", f"WITH {INSIGHT_SQL} SELECT * FROM ins")
def sum_model_insight(spark, sf):
    return insight_rows(spark, sf)


@query("sum_advisory_scan", "SUM-32", f"WITH {INSIGHT_SQL} SELECT person, kind, CASE WHEN kind='low_accuracy' THEN 'warn' ELSE 'info' END AS severity FROM (SELECT person, CASE WHEN accuracy_gold<0.6 THEN 'low_accuracy' WHEN drifted>0 THEN 'drift' WHEN ece>0.15 THEN 'confidence_off' WHEN NOT beats_flat THEN 'no_gain' END AS kind FROM ins) WHERE kind IS NOT NULL")
def sum_advisory_scan(spark, sf):
    return I.advisory_scan(insight_rows(spark, sf)).select("person", "kind", "severity")


@query("sum_advisory_state", "SUM-33", """
WITH o AS (SELECT 'n'||s_nationkey AS kind, min(s_suppkey) AS at, 'count '||count(*) AS detail FROM supplier WHERE s_acctbal>3000 GROUP BY s_nationkey), n AS (SELECT 'n'||s_nationkey AS kind, max(s_suppkey) AS at, 'count '||count(*) AS detail FROM supplier WHERE s_acctbal>5000 GROUP BY s_nationkey), z AS (SELECT 'n'||n_nationkey AS kind FROM nation WHERE n_regionkey>=2)
SELECT kind, CASE WHEN n.kind IS NOT NULL THEN 'warn' ELSE 'info' END AS severity, coalesce(n.detail,o.detail) AS detail, coalesce(o.at,n.at) AS at, coalesce(n.detail<>o.detail,false) AS reopened FROM n FULL JOIN o USING (kind) WHERE kind NOT IN (FROM z) OR coalesce(n.detail<>o.detail,false)""")
def sum_advisory_state(spark, sf):
    s, n = T.load(spark, sf, "supplier"), T.load(spark, sf, "nation")
    kind = F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("kind")
    detail = F.concat(F.lit("count "), F.count("*").cast("string")).alias("detail")
    old = s.where("s_acctbal > 3000").groupBy(kind).agg(F.lit("info").alias("severity"), detail, F.min("s_suppkey").alias("at"))
    new = s.where("s_acctbal > 5000").groupBy(kind).agg(F.lit("warn").alias("severity"), detail, F.max("s_suppkey").alias("at"))
    snooze = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("kind"), F.col("n_regionkey").alias("until"))
    return I.upsert_advisories(old, new, snooze, F.lit(1))


@query("sum_event_log", "SUM-34", "SELECT event_id AS id, minute AS at, event_type FROM ev ORDER BY minute DESC, event_id DESC LIMIT 120")
def sum_event_log(spark, sf):
    return I.event_log(T.events(spark, sf).select(F.col("event_id").alias("id"), F.col("minute").alias("at"), "event_type"))


@query("sum_active_incidents", "SUM-35", f"SELECT person, max(minute) AS at, CASE WHEN max(value)>150 THEN 'critical' WHEN max(value)>100 THEN 'warn' ELSE 'info' END AS severity FROM ev WHERE event_type='error' GROUP BY person HAVING {NOW}-max(minute)<=180")
def sum_active_incidents(spark, sf):
    e = T.events(spark, sf).where("event_type = 'error'").groupBy("person").agg(F.max("minute").alias("at"), F.when(F.max("value") > 150, "critical").when(F.max("value") > 100, "warn").otherwise("info").alias("severity"))
    return I.active_incidents(e, now_min(spark, sf), 180)


@query("sum_milestones", "SUM-36", f"""
SELECT person AS key, name FROM (SELECT person, unnest(['busy','first_pattern']) AS name, unnest([count(*) FILTER (WHERE minute>{NOW}-1440)>20, count(*) FILTER (WHERE k=42)>0]) AS reached FROM ev GROUP BY person) WHERE reached AND NOT (person IN ('p1','p2') AND name='busy')""")
def sum_milestones(spark, sf):
    ev = T.events(spark, sf)
    now = now_min(spark, sf)
    a = ev.groupBy("person").agg((F.count_if(F.col("minute") > now - 1440) > 20).alias("busy"), (F.count_if(F.col("k") == 42) > 0).alias("first_pattern"))
    counts = X.unpivot(a, ["person"], ["busy", "first_pattern"], "name", "reached").withColumnRenamed("person", "key")
    fired = ev.select(F.col("person").alias("key"), F.lit("busy").alias("name")).where("key in ('p1', 'p2')").distinct()
    return I.milestones(counts, fired)


@query("sum_hour_histogram", "SUM-40 SUM-41", """
SELECT person, state, string_agg(n, ',' ORDER BY h) AS hist, count(*) FILTER (WHERE n>0)>=0 AND sum(n)>=3 AND (max(n)/sum(n)>=0.4) AND false AS marker FROM (SELECT p.person, p.state, h, count(t.w) AS n FROM (SELECT DISTINCT person, state FROM tl) p, (SELECT unnest(range(24)) AS h) LEFT JOIN tl t ON t.person=p.person AND t.state=p.state AND t.hour=h GROUP BY ALL) GROUP BY person, state""")
def sum_hour_histogram(spark, sf):
    rows = tl(spark, sf)
    h = I.hour_histogram(rows, ["person", "state"], F.col("hour"))
    return h.select("person", "state", F.array_join(F.transform("hist", lambda v: v.cast("string")), ",").alias("hist"), I.looks_like_marker(F.col("hist"), I.hist_total(F.col("hist"))).alias("marker"))


@query("sum_marker_like", "SUM-41", """
SELECT user_id, n>=3 AND n<=8 AND (m1/n>=0.4 OR (m1+m2)/n>=0.6) AS marker FROM (SELECT user_id, CAST(sum(c) AS BIGINT) AS n, max(c) AS m1, coalesce(max(c) FILTER (WHERE rn=2),0) AS m2 FROM (SELECT user_id, count(*) AS c, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, hour(ts)) AS rn FROM events WHERE value>100 GROUP BY user_id, hour(ts)) GROUP BY user_id)""")
def sum_marker_like(spark, sf):
    ev = T.load(spark, sf, "events").where("value > 100")
    h = I.hour_histogram(ev, ["user_id"], F.hour("ts"))
    return h.select("user_id", I.looks_like_marker(F.col("hist"), I.hist_total(F.col("hist"))).alias("marker"))


@query("sum_evidence_when", "SUM-39", """
WITH h AS (SELECT person, state, hour, count(*) AS n FROM tl GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY person, state ORDER BY n DESC, hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, sum(n) OVER (PARTITION BY person, state) AS t, row_number() OVER (PARTITION BY person, state ORDER BY n DESC, hour) AS rn FROM h)
SELECT person, state, CAST(min(hour) AS INTEGER) AS lo, CAST(max(hour) AS INTEGER) AS hi, CAST(max(hour) FILTER (WHERE rn=1) AS INTEGER) AS peak, CASE WHEN max(hour) FILTER (WHERE rn=1) BETWEEN 5 AND 10 THEN 'morning' WHEN max(hour) FILTER (WHERE rn=1) BETWEEN 11 AND 16 THEN 'afternoon' WHEN max(hour) FILTER (WHERE rn=1) BETWEEN 17 AND 21 THEN 'evening' ELSE 'night' END AS part FROM r WHERE coalesce(b,0)/t<0.7 GROUP BY ALL""")
def sum_evidence_when(spark, sf):
    h = I.hour_histogram(tl(spark, sf), ["person", "state"], F.col("hour"))
    return h.withColumn("s", I.peak_span(F.col("hist"))).select("person", "state", "s.lo", "s.hi", "s.peak", "s.part")


@query("sum_evidence_cadence", "SUM-39", """
SELECT person, state, round(avg(CAST(dow<5 AS INT)),2) AS weekday_frac, CASE WHEN avg(CAST(dow<5 AS INT))>=0.75 THEN 'mostly on weekdays' WHEN avg(CAST(dow<5 AS INT))<=0.25 THEN 'mostly at weekends' ELSE 'any day of the week' END AS phrase FROM tl GROUP BY ALL""")
def sum_evidence_cadence(spark, sf):
    return I.cadence(tl(spark, sf), ["person", "state"], F.col("dow"))


@query("sum_evidence_examples", "SUM-39", """
SELECT person, state, w FROM (SELECT person, state, w, row_number() OVER o -1 AS r, count(*) OVER (PARTITION BY person, state) AS n FROM tl WINDOW o AS (PARTITION BY person, state ORDER BY w)) WHERE n<=4 OR r IN (0, CAST(round((n-1)/3) AS BIGINT), CAST(round(2*(n-1)/3) AS BIGINT), n-1)""")
def sum_evidence_examples(spark, sf):
    return I.spread_examples(tl(spark, sf).select("person", "state", "w"), ["person", "state"])


@query("sum_evidence_rooms", "SUM-39", """
SELECT * FROM (SELECT device_id, room, round(sum(abs(price-1000)),6) AS weight, CAST(row_number() OVER (PARTITION BY device_id ORDER BY sum(abs(price-1000)) DESC, room) AS INTEGER) AS rank FROM bind WHERE room IS NOT NULL GROUP BY device_id, room) WHERE rank<=3""")
def sum_evidence_rooms(spark, sf):
    b = T.bindings(spark, sf).select("device_id", "room", (F.col("price") - 1000).alias("z"))
    return I.rooms_by_weight(b, ["device_id"]).withColumn("weight", r6("weight"))


@query("sum_journey", "SUM-42", f"SELECT CAST(ceil(({NOW}-min(minute))/1440) AS BIGINT) AS days, count(*) FILTER (WHERE minute>{NOW}-1440) AS events_24h, (SELECT count(*) FROM bind WHERE enabled) AS sensors FROM ev")
def sum_journey(spark, sf):
    return I.journey(T.events(spark, sf), T.bindings(spark, sf), now_min(spark, sf))


@query("sum_group_caption", "SUM-44", """
WITH r AS (SELECT device_id, room, count(*) AS n, row_number() OVER (PARTITION BY device_id ORDER BY count(*) DESC, room) AS rn FROM bind WHERE room IS NOT NULL GROUP BY device_id, room), o AS (SELECT device_id, role, row_number() OVER (PARTITION BY device_id ORDER BY count(*) DESC, role) AS rn FROM bind GROUP BY device_id, role), t AS (SELECT device_id, count(*) AS t FROM bind GROUP BY device_id)
SELECT t.device_id, CASE WHEN r.n/t.t>=0.6 THEN r.room ELSE o.role END AS caption FROM t LEFT JOIN r ON r.device_id=t.device_id AND r.rn=1 LEFT JOIN o ON o.device_id=t.device_id AND o.rn=1""")
def sum_group_caption(spark, sf):
    return I.group_caption(T.bindings(spark, sf), ["device_id"])


# --- top-k and sets -------------------------------------------------------------------------------------


@query("top_explanation", "TOP-02 FUN-04", """
SELECT l_orderkey, l_linenumber, array_to_string(list_transform(list_sort([{'n':-abs(l_quantity-25),'f':'quantity'},{'n':-abs(l_discount*400-20),'f':'discount'},{'n':-abs(30-l_tax*900),'f':'tax'},{'n':-abs(l_extendedprice/5000-10),'f':'price'}])[1:3], lambda e: e.f), ',') AS top FROM lineitem""")
def top_explanation(spark, sf):
    li = T.load(spark, sf, "lineitem")
    s = lambda n, c: F.struct(F.lit(n).alias("feature"), c.alias("weight"))
    contrib = F.array(s("quantity", F.col("l_quantity") - 25), s("discount", F.col("l_discount") * 400 - 20), s("tax", 30 - F.col("l_tax") * 900), s("price", F.col("l_extendedprice") / 5000 - 10))
    return li.select("l_orderkey", "l_linenumber", F.array_join(F.transform(K.top_explanation(contrib), lambda e: e["feature"]), ",").alias("top"))


@query("top_classes", "TOP-03 FUN-05", """
SELECT event_id, string_agg(c, ',' ORDER BY p DESC, c) AS classes FROM (SELECT event_id, unnest(['cooking','movie','home']) AS c, unnest([a,b,c]) AS p, FROM pred5) GROUP BY event_id""")
def top_classes(spark, sf):
    return T.prediction_rows(spark, sf).select("event_id", F.array_join(F.transform(K.top_classes(F.col("probs")), lambda e: e["k"]), ",").alias("classes"))


FLAG_SQL = """t AS (SELECT person, avg(p_F) FILTER (WHERE y='F') AS tf, avg(p_O) FILTER (WHERE y='O') AS t_o, avg(p_P) FILTER (WHERE y='P') AS tp FROM sp GROUP BY person),
c AS (SELECT s.person, row_id, y, provenance, CASE y WHEN 'F' THEN p_F WHEN 'O' THEN p_O ELSE p_P END AS own, greatest(CASE WHEN y<>'F' AND p_F>=tf THEN p_F ELSE -1 END, CASE WHEN y<>'O' AND p_O>=t_o THEN p_O ELSE -1 END, CASE WHEN y<>'P' AND p_P>=tp THEN p_P ELSE -1 END) AS bp,
 p_F>=tf AND y<>'F' AS cf, p_O>=t_o AND y<>'O' AS c_o, p_F, p_O, p_P FROM sp s JOIN t USING (person)),
fl AS (SELECT person, row_id, y AS given, CASE WHEN cf AND p_F=bp THEN 'F' WHEN c_o AND p_O=bp THEN 'O' ELSE 'P' END AS suggested, round(own,4) AS self_conf, round(bp,4) AS suggested_p, provenance FROM c WHERE bp>own)"""


@query("ml_confident_flags", "ML-20", f"WITH {FLAG_SQL} SELECT * EXCLUDE (provenance) FROM fl")
def ml_confident_flags(spark, sf):
    return C.confident_flags(sp(spark, sf), T.CLASSES, P)


@query("top_flag_cap", "TOP-04", f"""WITH {FLAG_SQL} SELECT person, row_id, self_conf, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY self_conf, row_id) AS rank FROM fl) JOIN (SELECT person, count(*) AS n FROM sp GROUP BY person) USING (person) WHERE rank<=greatest(1,ceil(n*0.1))""")
def top_flag_cap(spark, sf):
    rows = sp(spark, sf)
    return K.cap_flags(C.confident_flags(rows, T.CLASSES, P), rows.groupBy("person").agg(F.count("*").alias("n_rows")), P).select("person", "row_id", "self_conf", "rank")


@query("top_confusions", "TOP-05", "SELECT y, predicted, count(*) AS n FROM sp WHERE y<>predicted GROUP BY ALL HAVING count(*)>=5 ORDER BY n DESC, y, predicted LIMIT 3")
def top_confusions_q(spark, sf):
    from .statistics import top_confusions

    return top_confusions(X.confusion(sp(spark, sf), []))


@query("top_suspects_to_ask", "TOP-06", f"""WITH {FLAG_SQL} SELECT person, row_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY self_conf, row_id) AS rank FROM fl WHERE provenance='confirmed' AND row_id%5<>0) WHERE rank<=2""")
def top_suspects_to_ask(spark, sf):
    rows = sp(spark, sf)
    ledger = C.confident_flags(rows, T.CLASSES, P).join(rows.select("row_id", "provenance"), "row_id").withColumn("asked", F.col("row_id") % 5 == 0)
    return K.suspects_to_ask(ledger, P).select("person", "row_id", "rank")


@query("top_option_ranking", "TOP-07", """
WITH o AS (SELECT event_id, list_filter(list_concat(list(c ORDER BY p DESC, c), ['away','nap','read']), lambda x: x<>'movie') AS ord, any_value(smoothed) AS s FROM (SELECT event_id, smoothed, unnest(['cooking','movie','home']) AS c, unnest([a,b,c]) AS p FROM pred5) GROUP BY event_id)
SELECT event_id, array_to_string(CASE WHEN len(r)>3 THEN r[1:2] ELSE r END, ',') AS options, len(r)>3 AS more FROM (SELECT event_id, list_filter(ord, lambda x: x<>s AND x<>'nap') AS r FROM o)""")
def top_option_ranking(spark, sf):
    p = T.prediction_rows(spark, sf)
    enabled = F.array(*map(F.lit, ["home", "read", "away", "cooking", "nap"]))
    batch, more = K.next_options(F.col("ord"), F.array(F.col("smoothed"), F.lit("nap")))
    return p.withColumn("ord", K.option_order(F.col("probs"), enabled)).select("event_id", F.array_join(batch, ",").alias("options"), more.alias("more"))


@query("set_card_merge", "SET-01", """
WITH c AS (SELECT DISTINCT person, CASE state WHEN 'movie' THEN 'cooking' ELSE state END AS card, w, hour FROM tl),
n AS (SELECT person, card, hour, count(*) AS n FROM c GROUP BY ALL), k AS (SELECT person, card, count(*) AS windows FROM c GROUP BY ALL)
SELECT k.person, k.card, any_value(windows) AS windows, string_agg(coalesce(n,0), ',' ORDER BY h) AS hist FROM (SELECT *, unnest(range(24)) AS h FROM k) k LEFT JOIN n ON n.person=k.person AND n.card=k.card AND n.hour=h GROUP BY k.person, k.card""")
def set_card_merge(spark, sf):
    members = tl(spark, sf).select("person", F.col("state").alias("card"), "w", "hour")
    merged = K.merge_cards(members, spark.createDataFrame([("movie", "cooking")], "card string, into string"), ["person"])
    hist = I.hour_histogram(merged, ["person", "card"], F.col("hour"))
    size = merged.groupBy("person", "card").agg(F.count("*").alias("windows"))
    return size.join(hist, ["person", "card"]).select("person", "card", "windows", F.array_join(F.transform("hist", lambda v: v.cast("string")), ",").alias("hist"))


view("card", """SELECT s_suppkey AS card, list_distinct(['f'||(s_suppkey%7), 'f'||(s_nationkey%7), 'f'||((s_suppkey//7)%7), 'f'||((s_suppkey+s_nationkey*3)%7)]) AS f FROM supplier""")


def cards(spark, sf):
    s = T.load(spark, sf, "supplier")
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    name = lambda c: F.concat(F.lit("f"), c.cast("string"))
    return s.select(k.alias("card"), F.array_distinct(F.array(name(k % 7), name(n % 7), name(F.floor(k / 7) % 7), name((k + n * 3) % 7))).alias("features"))


@query("set_signature_overlap", "SET-02", "SELECT a.card AS a, b.card AS b, CAST(len(list_intersect(a.f,b.f)) AS INTEGER) AS shared FROM card a JOIN card b ON a.card<>b.card AND b.card%4=0 WHERE len(list_intersect(a.f,b.f))>=3")
def set_signature_overlap(spark, sf):
    c = cards(spark, sf)
    return K.signature_overlaps(c, c.where("card % 4 = 0"), "card", 3)


@query("jon_signature_contrast", "JON-22", "SELECT card, CAST(max(shared) AS INTEGER) AS shared, arg_min(b, -shared*1000000+b) AS \"like\" FROM (SELECT a.card, b.card AS b, len(list_intersect(a.f,b.f)) AS shared FROM card a JOIN card b ON a.card<>b.card AND b.card%4=0) WHERE shared>=2 GROUP BY card")
def jon_signature_contrast(spark, sf):
    c = cards(spark, sf)
    return J.contrast(c, c.where("card % 4 = 0"))


@query("set_new_devices", "SET-03", "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity>=50 AND l_discount>=0.1)")
def set_new_devices(spark, sf):
    return T.load(spark, sf, "supplier").select("s_suppkey").exceptAll(T.load(spark, sf, "lineitem").where("l_quantity >= 50 and l_discount >= 0.1").select(F.col("l_suppkey").alias("s_suppkey")).distinct())


@query("set_spec_merge", "SET-05", """
WITH x AS (SELECT p_brand AS name, max(p_size) AS window_min FROM part WHERE p_size>25 AND p_type='PROMO' GROUP BY p_brand), y AS (SELECT p_brand AS name, min(p_size) AS window_min FROM part GROUP BY p_brand)
SELECT coalesce(x.name,y.name) AS name, coalesce(x.window_min,y.window_min) AS window_min, CASE WHEN x.name IS NULL THEN 'new' ELSE 'existing' END AS origin FROM x FULL JOIN y USING (name) WHERE coalesce(x.name,y.name) NOT IN (SELECT p_brand FROM part WHERE p_partkey%40=0)""")
def set_spec_merge(spark, sf):
    p = T.load(spark, sf, "part")
    old = p.where("p_size > 25 and p_type = 'PROMO'").groupBy(F.col("p_brand").alias("name")).agg(F.max("p_size").alias("window_min"))
    new = p.groupBy(F.col("p_brand").alias("name")).agg(F.min("p_size").alias("window_min"))
    return K.merge_specs(old, new, p.where("p_partkey % 40 = 0").select(F.col("p_brand").alias("name")).distinct(), ["name"])


@query("fun_text_tokens", "FUN-01", """
SELECT lang, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens, max(title) AS top_title FROM (SELECT lang, len(list_distinct(list_filter(regexp_split_to_array(lower(text),'[^a-z0-9]+'), lambda x: x<>''))) AS n, trim(regexp_replace(lower(source),'[^a-z0-9]+','_','g')) AS title FROM documents) GROUP BY lang""")
def fun_text_tokens(spark, sf):
    from ..functions.cols import slugify, tokens

    d = T.load(spark, sf, "documents")
    return d.select("lang", F.size(tokens(F.col("text"))).alias("n"), slugify(F.col("source")).alias("title")).groupBy("lang").agg(
        F.count("*").alias("docs"), F.sum("n").cast("long").alias("tokens"), F.max("title").alias("top_title"))


# --- weights, folds and gates -----------------------------------------------------------------------------


@query("ml_class_balance_weights", "ML-07", """
WITH c AS (SELECT person, y, count(*) AS nc FROM sp GROUP BY ALL), r AS (SELECT *, least(8.0, sum(nc) OVER g/(count(*) OVER g*nc)) AS raw FROM c WINDOW g AS (PARTITION BY person)), w AS (SELECT person, y, raw/(sum(raw*nc) OVER (PARTITION BY person)/sum(nc) OVER (PARTITION BY person)) AS w FROM r)
SELECT row_id, round(w,6) AS w_balance FROM sp JOIN w USING (person, y)""")
def ml_class_balance_weights(spark, sf):
    return C.class_balance_weights(sp(spark, sf), P).select("row_id", r6("w_balance").alias("w_balance"))


@query("ml_training_weights", "ML-08 ML-09 ML-10", f"""WITH {FLAG_SQL}
SELECT s.row_id, round(pow(0.5, (e-minute)/1440.0/21.0)*CASE WHEN fl.row_id IS NOT NULL THEN 0.3 ELSE 1 END*CASE WHEN predicted=y THEN 1.25 ELSE 1 END,6) AS weight FROM sp s LEFT JOIN fl ON fl.row_id=s.row_id, (SELECT max(minute) AS e FROM sp)""")
def ml_training_weights(spark, sf):
    rows = sp(spark, sf)
    w = C.suspect_weights(rows, C.confident_flags(rows, T.CLASSES, P), ["row_id"])
    w = C.champion_weights(w, rows.select("row_id", F.col("predicted").alias("champion")), ["row_id"])
    end = rows.agg(F.max("minute")).scalar()
    age = (F.col("_end") - F.col("minute")) / 1440.0
    return w.withColumn("_end", end).select("row_id", r6(C.recency_weight(age) * F.col("w_suspect") * F.col("w_champion")).alias("weight"))


@query("ml_rolling_folds", "ML-11", """
WITH e AS (SELECT max(minute) AS e FROM sp), f AS (SELECT person, minute, unnest([1,2,3]) AS fold FROM sp), g AS (SELECT person, fold, e-(3-fold)*432000 AS val_end, e-(4-fold)*432000 AS val_start, minute FROM f, e)
SELECT person, CAST(fold AS INTEGER) AS fold, val_start, val_end, count(*) FILTER (WHERE minute<val_start) AS n_train, count(*) FILTER (WHERE minute>=val_start AND minute<val_end) AS n_val, fold=max(fold) OVER (PARTITION BY person) AS ship FROM g GROUP BY person, fold, val_start, val_end HAVING count(*) FILTER (WHERE minute<val_start)>=10 AND count(*) FILTER (WHERE minute>=val_start AND minute<val_end)>=5""")
def ml_rolling_folds(spark, sf):
    rows = sp(spark, sf)
    return C.rolling_folds(rows.withColumn("_e", rows.agg(F.max("minute")).scalar()).select("person", "minute"), P, rows.agg(F.max("minute")).scalar(), val_days=300)


@query("ml_strike_candidates", "ML-17", """
WITH RECURSIVE r AS (SELECT l_linestatus AS node, epoch_us(l_shipdate)//60000000//43200*43200 AS mt, 'f'||(l_suppkey%10) AS feature, avg(CASE WHEN l_suppkey%10<3 THEN 0 ELSE l_discount END) AS imp FROM lineitem GROUP BY ALL), t AS (SELECT DISTINCT node, mt FROM r), tk AS (SELECT node, mt, row_number() OVER (PARTITION BY node ORDER BY mt DESC) AS k FROM t)
SELECT node, feature, count(*) FILTER (WHERE imp<=1e-6) AS flags, count(*) AS seen FROM r JOIN tk USING (node, mt) WHERE k<=4 GROUP BY ALL HAVING count(*) FILTER (WHERE imp<=1e-6)>=3 AND count(*)>=3""")
def ml_strike_candidates(spark, sf):
    li = T.load(spark, sf, "lineitem")
    m = F.expr("unix_micros(cast(l_shipdate as timestamp)) div 60000000")
    imp = F.when(F.col("l_suppkey") % 10 < 3, 0.0).otherwise(F.col("l_discount"))
    rounds = li.groupBy(F.col("l_linestatus").alias("node"), (m - m % 43200).alias("at"), F.concat(F.lit("f"), (F.col("l_suppkey") % 10).cast("string")).alias("feature")).agg(F.avg(imp).alias("importance"))
    return C.strike_candidates(rounds, ["node"])


@query("ml_conformal_threshold", "ML-21 ML-22", """
WITH h AS (SELECT person, count(*) FILTER (WHERE provenance='confirmed' OR gold) AS h FROM sp GROUP BY person), r AS (SELECT s.*, CASE WHEN h>=50 THEN 'human' ELSE 'all' END AS basis, CASE y WHEN 'F' THEN p_F WHEN 'O' THEN p_O ELSE p_P END AS pt FROM sp s JOIN h USING (person) WHERE h<50 OR provenance='confirmed' OR gold),
o AS (SELECT person, basis, pt, round(1-pt,9) AS sc, row_number() OVER (PARTITION BY person ORDER BY 1-pt)-1 AS i, count(*) OVER (PARTITION BY person) AS n FROM r),
k AS (SELECT person, basis, n, sc AS qhat FROM o WHERE i=ceil(round((n-1)*least(1.0,ceil((n+1)*0.9)/n),9)))
SELECT person, basis, round(qhat,4) AS qhat, n AS n_cal, round(avg((p_F>=1-qhat-1e-12)::INT+(p_O>=1-qhat-1e-12)::INT+(p_P>=1-qhat-1e-12)::INT),2) AS avg_set_size, round(avg((pt>=1-qhat-1e-12)::INT),4) AS coverage FROM r JOIN k USING (person, basis) GROUP BY person, basis, qhat, n""")
def ml_conformal_threshold(spark, sf):
    rows = C.calibration_rows(sp(spark, sf), P)
    return C.conformal_threshold(rows, T.CLASSES, ["person", "basis"])


@query("ml_prediction_set", "ML-23", """
SELECT event_id, coalesce(string_agg(c, ',' ORDER BY p DESC, c) FILTER (WHERE p>=1-0.6::DOUBLE-1e-12::DOUBLE),'') AS pred_set FROM (SELECT event_id, unnest(['cooking','movie','home']) AS c, unnest([a,b,c]) AS p FROM pred5) GROUP BY event_id""")
def ml_prediction_set(spark, sf):
    return T.prediction_rows(spark, sf).select("event_id", F.array_join(C.prediction_set(F.col("probs"), F.lit(0.6)), ",").alias("pred_set"))


LO = wil("round({a}*{n})", "{n}")[0]


def lo_sql(a, n):
    return LO.format(a=a, n=n)


@query("ml_promotion_gate", "ML-24 ML-25", f"""
WITH m AS (SELECT o_orderkey AS id, o_custkey AS key, (o_orderkey*7)%60 AS n_gold, round(((o_orderkey*13)%100)/100,2) AS ag, (o_orderkey*11)%80 AS nc, round(((o_orderkey*17)%100)/100,2) AS ac, round(((o_orderkey*19)%100)/100,2) AS ab, round(((o_orderkey*23)%50)/100,2) AS churn FROM orders),
c AS (SELECT o_custkey AS key, max(o_orderkey) AS nid, CASE WHEN count(*)>1 THEN min(o_orderkey) END AS cid FROM orders GROUP BY o_custkey),
j AS (SELECT c.key, n.*, c.cid, u.n_gold AS cg, u.ag AS cag, u.nc AS cnc, u.ac AS cac, u.ab AS cab FROM c JOIN m n ON n.id=c.nid LEFT JOIN m u ON u.id=c.cid),
l AS (SELECT *, {lo_sql('ag','n_gold')} AS ng_lo, {lo_sql('cag','cg')} AS cg_lo, {lo_sql('ac','nc')} AS nc_lo, {lo_sql('cac','cnc')} AS cc_lo FROM j),
h AS (SELECT *, CASE WHEN cid IS NULL THEN true WHEN n_gold>0 AND cg>0 THEN ng_lo>=cg_lo-0.02 WHEN nc>0 AND cnc>0 THEN nc_lo>=cc_lo-0.02 ELSE coalesce(ab>=cab-0.02,true) END AS holds,
 CASE WHEN cid IS NULL OR churn<=0.25 THEN true WHEN n_gold>0 AND cg>0 THEN cg_lo<0.05 OR ng_lo>=cg_lo+0.02 WHEN nc>0 AND cnc>0 THEN cc_lo<0.05 OR nc_lo>=cc_lo+0.02 ELSE false END AS allowed,
 CASE WHEN cid IS NULL THEN 'first' WHEN n_gold>0 AND cg>0 THEN 'real-world' WHEN nc>0 AND cnc>0 THEN 'confirmed' ELSE 'bootstrap' END AS b0 FROM l)
SELECT id AS new_id, CASE WHEN holds AND NOT allowed THEN 'churn' ELSE b0 END AS basis, holds AND allowed AS promoted FROM h""")
def ml_promotion_gate(spark, sf):
    o = T.load(spark, sf, "orders")
    k = F.col("o_orderkey")
    m = o.select(k.alias("id"), ((k * 7) % 60).alias("n_gold"), F.round(((k * 13) % 100) / 100, 2).alias("accuracy_gold"), ((k * 11) % 80).alias("n_confirmed"), F.round(((k * 17) % 100) / 100, 2).alias("accuracy_confirmed"),
                 F.round(((k * 19) % 100) / 100, 2).alias("accuracy_bootstrap"), F.round(((k * 23) % 50) / 100, 2).alias("churn"))
    c = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("new_id"), F.when(F.count("*") > 1, F.min("o_orderkey")).alias("cur_id"))
    new = m.select(F.col("id").alias("new_id"), "churn", *[F.col(x).alias(f"new_{x}") for x in m.columns if x not in ("id", "churn")])
    cur = m.select(F.col("id").alias("cur_id"), *[F.col(x).alias(f"cur_{x}") for x in m.columns if x not in ("id", "churn")])
    return C.promotion(c.join(new, "new_id").join(cur, "cur_id", "left")).select("new_id", "basis", "promoted")


@query("ml_churn_metrics", "ML-25", """
SELECT person, count(*) AS n, round(avg((predicted<>ch)::INT),4) AS churn, round(avg((predicted=y AND ch<>y)::INT),4) AS nfr, round(avg((predicted<>y AND ch=y)::INT),4) AS pfr FROM (SELECT *, ['F','O','P'][row_id%3+1] AS ch FROM sp) GROUP BY person""")
def ml_churn_metrics(spark, sf):
    rows = sp(spark, sf).select("person", "y", F.col("predicted").alias("champion"), T._pick(["F", "O", "P"], F.col("row_id") % 3).alias("challenger"))
    return C.churn_metrics(rows, P)


@query("ml_rollback", "ML-26 ML-27", """
SELECT person, max(model_id) FILTER (WHERE NOT promoted) AS model_id, CASE WHEN arg_max(confirmed, model_id) FILTER (WHERE NOT promoted)>=30 THEN 'validated' ELSE 'provisional' END AS status FROM (SELECT * REPLACE (confirmed*2 AS confirmed) FROM mrec) GROUP BY person""")
def ml_rollback(spark, sf):
    rec = model_records(spark, sf)
    prev = C.rollback(rec, P)
    return prev.join(rec.select("model_id", "confirmed"), "model_id").select("person", "model_id", C.validation_status(F.col("confirmed") * 2).alias("status"))


@query("ml_earned_gates", "ML-39", """
SELECT 'c'||p.ord AS person, 'f'||f.part_id AS fact_id, CASE WHEN f.part_id%3=0 THEN 'away' ELSE 'asleep' END AS gate FROM (SELECT *, ord%100 AS home FROM member) p JOIN (SELECT *, part_id%100 AS home FROM entity) f USING (home) WHERE f.part_id%7<>0 AND f.part_id%3<>0 AND f.price>950 AND (f.part_id%2=0 OR 'c'||f.part_id='c'||p.ord)""")
def ml_earned_gates(spark, sf):
    e = T.entities(spark, sf)
    k = F.col("part_id")
    fid = F.concat(F.lit("f"), k.cast("string")).alias("fact_id")
    facts = e.select(fid, F.when(k % 3 == 0, "away").otherwise("asleep").alias("gate"), F.when(k % 2 == 1, F.concat(F.lit("c"), k.cast("string"))).alias("person_id"), (k % 100).alias("home"), (k % 7 != 0).alias("enabled"))
    verd = e.select(fid, F.when(F.col("price") > 950, "fact").otherwise("suspect").alias("decision"))
    return C.earned_gates(facts, verd, T.persons(spark, sf).withColumn("home", F.col("ord") % 100))


# --- scoring ----------------------------------------------------------------------------------------------


@query("ml_rules_only", "ML-35", "SELECT person, w, CASE WHEN state='cooking' THEN 0.55::DOUBLE ELSE round(0.45/4,6) END AS cooking, CASE WHEN state='home' THEN 0.55::DOUBLE ELSE round(0.45/4,6) END AS home FROM tl")
def ml_rules_only(spark, sf):
    m = tl(spark, sf).select("person", "w", C.rules_only(F.col("state"), ["cooking", "movie", "away", "home", "asleep"]).alias("m"))
    return m.select("person", "w", r6(F.col("m")["cooking"]).alias("cooking"), r6(F.col("m")["home"]).alias("home"))


@query("ml_presence_gate", "ML-37", """
SELECT event_id, round(CASE WHEN k<20 THEN 1 WHEN k<70 THEN 0 ELSE c END,6) AS away, round(CASE WHEN k<20 THEN 0 WHEN k<70 AND a+b>0 THEN a/(a+b) ELSE a END,6) AS cooking FROM pred5""")
def ml_presence_gate(spark, sf):
    p = T.prediction_rows(spark, sf)
    renamed = F.map_from_arrays(F.transform(F.map_keys("probs"), lambda x: F.when(x == "home", "away").otherwise(x)), F.map_values("probs"))
    state = C.presence_state([F.when(F.col("k") < 20, 0.0).when(F.col("k") < 70, 1.0).otherwise(-1.0)])
    g = p.withColumns({"probs": renamed, "state": state}).select("event_id", C.presence_gate(F.col("probs"), F.col("state")).alias("g"))
    return g.select("event_id", r6(F.col("g")["away"]).alias("away"), r6(F.col("g")["cooking"]).alias("cooking"))


@query("ml_fact_first_resolution", "ML-38 FUN-05", """
SELECT event_id, CASE WHEN k<5 THEN 'movie' WHEN k<20 THEN 'away' WHEN cf>=0.6 THEN tp WHEN k%2=0 THEN 'cooking' ELSE 'unknown' END AS predicted, CASE WHEN k<20 THEN 1 WHEN cf>=0.6 THEN round(cf,4) WHEN k%2=0 THEN 0.55 ELSE 0 END::DOUBLE AS confidence, CASE WHEN k<5 THEN 'override' WHEN k<20 THEN 'fact' WHEN cf>=0.6 THEN 'model' WHEN k%2=0 THEN 'rule' ELSE 'unknown' END AS basis
FROM (SELECT event_id, k, greatest(a,b)/(a+b) AS cf, CASE WHEN a>=b THEN 'cooking' ELSE 'movie' END AS tp FROM (SELECT event_id, k, a, CASE WHEN a+b=0 THEN 1e-12 ELSE b END AS b FROM pred5))""")
def ml_fact_first_resolution(spark, sf):
    p = T.prediction_rows(spark, sf)
    k = F.col("k")
    r = C.resolve(F.when(k < 5, "movie"), F.when(k < 20, "away"), F.col("probs"), F.array(F.lit("home")), F.when(k % 2 == 0, "cooking"))
    return p.select("event_id", r.alias("r")).select("event_id", "r.predicted", "r.confidence", "r.basis")


@query("ml_evidence_cap_abstain", "ML-41 ML-42", """
SELECT person, w, CASE WHEN w%7=0 OR c<0.4 THEN 'unknown' ELSE state END AS state, c AS confidence FROM (SELECT person, w, state, CASE WHEN w%5=0 AND hour<12 AND confidence>0.7 THEN 0.7 ELSE confidence END AS c FROM tl)""")
def ml_evidence_cap_abstain(spark, sf):
    rows = tl(spark, sf)
    direct = F.when((F.col("w") % 5 == 0) & (F.col("hour") < 12), 0.1).otherwise(0.6)
    c = C.weak_evidence_cap(F.col("confidence"), direct)
    sets = F.when(F.col("w") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x")))
    return rows.withColumn("confidence", c).select("person", "w", C.abstain(F.col("state"), F.col("confidence"), sets).alias("state"), "confidence")


@query("ml_override_pin", "ML-43", f"""
SELECT t.person, t.w, coalesce(o.a, t.smoothed) AS smoothed, CASE WHEN o.a IS NOT NULL THEN 1 ELSE confidence END AS confidence, CASE WHEN o.a IS NOT NULL THEN 'override' ELSE model_version END AS model_version, coalesce({NOW}-o.s<=60,false) AS labels FROM tl t LEFT JOIN (SELECT person, minute-minute%30 AS w, arg_max(CASE WHEN value>50 THEN 'movie' ELSE 'home' END, ts) AS a, max(minute) AS s FROM ev WHERE event_type='signup' AND k>80 GROUP BY ALL) o USING (person, w)""")
def ml_override_pin(spark, sf):
    o = T.events(spark, sf).where("event_type = 'signup' and k > 80").groupBy("person", (F.col("minute") - F.col("minute") % 30).alias("w")).agg(
        F.max_by(F.when(F.col("value") > 50, "movie").otherwise("home"), "ts").alias("activity"), F.max("minute").alias("set_at"))
    return C.pin_overrides(T.timeline(spark, sf), o, ["person", "w"], now_min(spark, sf)).select("person", "w", "smoothed", "confidence", "model_version", "labels")


@query("ml_card_labels", "ML-33", "SELECT person, state AS card_id, w AS window_min, 'hobby' AS label, 'discovered' AS provenance FROM tl")
def ml_card_labels(spark, sf):
    return C.card_labels(tl(spark, sf).select("person", F.col("state").alias("card_id"), F.col("w").alias("window_min")), F.lit("hobby"))


view("ranges", "SELECT person, minute AS s, minute+k*5 AS e, CASE WHEN value>50 THEN 'reading' ELSE 'working' END AS slug FROM ev WHERE event_type='purchase'")


def label_ranges(spark, sf):
    return T.events(spark, sf).where("event_type = 'purchase'").select("person", F.col("minute").alias("start"), (F.col("minute") + F.col("k") * 5).alias("end"), F.when(F.col("value") > 50, "reading").otherwise("working").alias("slug"))


@query("ml_bulk_labels", "ML-34", "SELECT person, slug, unnest(range(CAST(ceil(s/30.0)*30 AS BIGINT), e-30+1, 30)) AS window_min, 'confirmed' AS provenance FROM ranges")
def ml_bulk_labels(spark, sf):
    return C.bulk_labels(label_ranges(spark, sf))


@query("ml_bulk_overwrite", "ML-34", """
WITH b AS (SELECT person, w, max(slug) AS slug FROM (SELECT person, slug, unnest(range(CAST(ceil(s/30.0)*30 AS BIGINT), e-30+1, 30)) AS w FROM ranges) GROUP BY ALL)
SELECT person, w, coalesce(slug, smoothed) AS smoothed, CASE WHEN slug IS NOT NULL THEN 1 ELSE confidence END AS confidence FROM tl LEFT JOIN b USING (person, w)""")
def ml_bulk_overwrite(spark, sf):
    return C.overwrite_range(T.timeline(spark, sf).select("person", "w", "smoothed", "confidence"), C.bulk_labels(label_ranges(spark, sf)))


ASK_SQL = """cand AS (SELECT *, CASE WHEN ex AND NOT un THEN 'explore' ELSE 'uncertain' END AS reason FROM (SELECT person, w, predicted, confidence, confidence<0.75 OR ABS(m)<0.25 AS un, CAST('0x'||substr(md5('ask|'||person||'|'||w),1,8) AS BIGINT)/4294967296.0<0.07 AS ex FROM (SELECT *, confidence-round(1-confidence,9) AS m FROM timeline)) WHERE un OR ex)"""


def ask_rows(spark, sf):
    t = T.timeline(spark, sf)
    rest = F.round(1 - F.col("confidence"), 9)
    return t.withColumn("probs", F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(F.col("confidence"), rest)))


@query("ml_asking_candidates", "ML-45", f"WITH {ASK_SQL} SELECT person, w, reason FROM cand")
def ml_asking_candidates(spark, sf):
    return C.asking_candidates(ask_rows(spark, sf), "ask").select("person", "w", "reason")


@query("ml_asking_policy", "ML-45", f"""WITH RECURSIVE {ASK_SQL},
s AS (SELECT person, w, predicted, reason, (w-1320)//1440 AS d, row_number() OVER (PARTITION BY person, (w-1320)//1440 ORDER BY w, predicted) AS i FROM cand WHERE (w//60)%24>=8 AND (w//60)%24<22),
r AS (SELECT person, d, i, w, predicted, reason, true AS ok, 1 AS used, w AS lw, predicted AS lp FROM s WHERE i=1
 UNION ALL SELECT person, d, i, w, predicted, reason, ok, CASE WHEN ok THEN used+1 ELSE used END, CASE WHEN ok THEN w ELSE lw END, CASE WHEN ok THEN predicted ELSE lp END FROM (SELECT s.person, s.d, s.i, s.w, s.predicted, s.reason, r.used, r.lw, r.lp, r.used<6 AND s.w-r.lw>=30 AND (r.lp<>s.predicted OR s.w-r.lw>=90) AS ok FROM r JOIN s ON s.person=r.person AND s.d=r.d AND s.i=r.i+1))
SELECT person, w, predicted, reason FROM r WHERE ok""")
def ml_asking_policy(spark, sf):
    return C.apply_asking_limits(C.asking_candidates(ask_rows(spark, sf), "ask"))


@query("ml_question_expiry", "ML-46", f"SELECT event_id, CASE WHEN k%2=0 AND {NOW}-minute>720 THEN 'expired' WHEN k%2=0 THEN 'open' ELSE 'answered' END AS status FROM ev WHERE event_type='view'")
def ml_question_expiry(spark, sf):
    qs = T.events(spark, sf).where("event_type = 'view'").select("event_id", F.col("minute").alias("created"), F.when(F.col("k") % 2 == 0, "open").otherwise("answered").alias("status"))
    return C.expire_questions(qs, now_min(spark, sf)).select("event_id", "status")


@query("ml_answer_labels", "ML-47", """
SELECT event_id AS question_id, person, minute-minute%30 AS window_min, CASE WHEN value>50 THEN 'movie' ELSE 'home' END AS label, 'confirmed' AS provenance, k%10=0 AS gold FROM ev WHERE event_type='view' AND k%2=1 OR event_type='view' AND k%10=0""")
def ml_answer_labels(spark, sf):
    ev = T.events(spark, sf).where("event_type = 'view'")
    qs = ev.select(F.col("event_id").alias("question_id"), "person", (F.col("minute") - F.col("minute") % 30).alias("window_min"), F.when(F.col("k") % 10 == 0, "explore").otherwise("uncertain").alias("reason"))
    ans = ev.where("k % 2 = 1 or k % 10 = 0").select(F.col("event_id").alias("question_id"), F.when(F.col("value") > 50, "movie").otherwise("home").alias("answer"))
    return C.answer_labels(ans, qs)


