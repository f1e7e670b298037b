"""Statistics, drift, reliability, co-activation and marker queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.cols import r6
from ..functions.ranks import quantiles
from ..operators import stats as X
from ..sources import tables as T
from .catalog import query
from .timelines import P, tl
from .windows_features import SERIES, feature_table, minutes


def sp(spark, sf):
    return X.with_prediction(T.scored_labels(spark, sf), T.CLASSES)


WIL = "CASE WHEN {n}=0 THEN {z} ELSE {f}({z}, ({k}/{n}+1.96*1.96/(2*{n}) {s} 1.96*sqrt({k}/{n}*(1-{k}/{n})/{n}+1.96*1.96/(4.0*{n}*{n})))/(1+1.96*1.96/{n})) END"


def wil(k, n):
    return WIL.format(k=k, n=n, z="0.0", f="greatest", s="-"), WIL.format(k=k, n=n, z="1.0", f="least", s="+")


_LO, _HI = wil("k", "n")


@query("sta_wilson", "STA-01", f"""
SELECT user_id, round({_LO},6) AS low, round({_HI},6) AS high FROM (SELECT user_id, count(*) AS n, CAST(count(*) FILTER (WHERE value>50) AS DOUBLE) AS k FROM events GROUP BY user_id)""")
def sta_wilson(spark, sf):
    ev = T.load(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("k"))
    lo, hi = X.wilson(F.col("k"), F.col("n"))
    return ev.select("user_id", r6(lo).alias("low"), r6(hi).alias("high"))


def drift_long(spark, sf):
    # the side of a line is found once, not for each of its four values
    side = F.when(F.col("l_shipdate") < F.lit("1998-06-01").cast("timestamp_ntz"), "expected").otherwise("actual")
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return X.unpivot(T.load(spark, sf, "lineitem").select(side.alias("side"), *columns), ["side"], columns)


PSI_SQL = """WITH q AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1]))) AS e FROM lilong WHERE side='expected' GROUP BY feature),
b AS (SELECT feature, side, CASE WHEN value=e[-1] THEN len(e)-1 WHEN value<e[-1] AND value>=e[1] THEN len(list_filter(e, lambda x: x<=value)) END AS bin FROM lilong JOIN q USING (feature) WHERE len(e)>=3),
c AS (SELECT feature, bin, count(*) FILTER (WHERE side='expected') AS ce, count(*) FILTER (WHERE side='actual') AS ca FROM b WHERE bin IS NOT NULL GROUP BY ALL),
t AS (SELECT feature, count(*) FILTER (WHERE side='expected') AS ne, count(*) FILTER (WHERE side='actual') AS na FROM lilong GROUP BY feature),
s AS (SELECT feature, unnest(range(1, len(e))) AS bin FROM q),
p AS (SELECT feature, ne, na, greatest(coalesce(ce,0)/ne,1e-6) AS pe, greatest(coalesce(ca,0)/na,1e-6) AS pa FROM s LEFT JOIN c USING (feature, bin) JOIN t USING (feature))
SELECT feature, {out}, ne AS n_expected, na AS n_actual FROM p GROUP BY feature, ne, na"""


@query("sta_psi", "STA-02", PSI_SQL.format(out="round(sum((pa-pe)*ln(pa/pe)),6) AS psi"))
def sta_psi(spark, sf):
    return X.psi(drift_long(spark, sf), ["feature"]).withColumn("psi", r6("psi"))


@query("sta_drift_report", "STA-03", PSI_SQL.format(out="round(sum((pa-pe)*ln(pa/pe)),4) AS psi, round(sum((pa-pe)*ln(pa/pe)),4)>0.2 AS drifted, round(sum((pa-pe)*ln(pa/pe)),4)>0.5 AS severe"))
def sta_drift_report(spark, sf):
    return X.drift_report(drift_long(spark, sf), ["feature"])


@query("sta_exact_quantiles", "STA-02", """
SELECT l_returnflag, round(quantile_cont(l_extendedprice,0.05),6) AS p05, round(quantile_cont(l_extendedprice,0.5),6) AS p50, round(quantile_cont(l_extendedprice,0.95),6) AS p95 FROM lineitem GROUP BY 1""")
def sta_exact_quantiles(spark, sf):
    q = quantiles(T.load(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    return q.select("l_returnflag", *[r6(c).alias(c) for c in ("p05", "p50", "p95")])


@query("sta_calibration", "STA-04", """
SELECT person, round(sum(sq)/sum(n),4) AS brier, round(sum(CASE WHEN bin>=1 THEN abs(sa-sc) ELSE 0 END)/sum(n),4) AS ece, CAST(sum(n) AS BIGINT) AS n_check FROM (
 SELECT person, least(ceil(conf*10),10) AS bin, count(*) AS n, sum(conf) AS sc, sum(correct) AS sa, sum(pow(p_F-(y='F')::INT,2)+pow(p_O-(y='O')::INT,2)+pow(p_P-(y='P')::INT,2)) AS sq FROM sp GROUP BY ALL) GROUP BY person""")
def sta_calibration(spark, sf):
    return X.calibration(sp(spark, sf), T.CLASSES, P)


@query("sta_class_report", "STA-05", """
WITH c AS (SELECT person, y, predicted, count(*) AS n FROM sp GROUP BY ALL), t AS (SELECT person, y AS class, sum(n) AS su, sum(n) FILTER (WHERE y=predicted) AS tp FROM c GROUP BY ALL), s AS (SELECT person, predicted AS class, sum(n) AS sd FROM c GROUP BY ALL)
SELECT person, class, round(coalesce(tp,0)/coalesce(sd,1),4) AS precision, round(coalesce(tp,0)/su,4) AS recall, round(CASE WHEN coalesce(tp,0)>0 THEN 2*tp/(su+sd) ELSE 0 END,4) AS f1, CAST(su AS BIGINT) AS support FROM t LEFT JOIN s USING (person, class)""")
def sta_class_report(spark, sf):
    return X.class_report(X.confusion(sp(spark, sf), P), P)


@query("sta_confusion_matrix", "STA-06", "SELECT person, y, predicted, count(*) AS n FROM sp GROUP BY ALL")
def sta_confusion_matrix(spark, sf):
    return X.confusion(sp(spark, sf), P)


@query("sta_auc", "STA-07", """
SELECT person, class, round((sum(rk) FILTER (WHERE pos)-count(*) FILTER (WHERE pos)*(count(*) FILTER (WHERE pos)+1)/2)/(count(*) FILTER (WHERE pos)*count(*) FILTER (WHERE NOT pos)),6) AS auc FROM (
 SELECT person, class, y=class AS pos, rank() OVER (PARTITION BY person, class ORDER BY score)+(count(*) OVER (PARTITION BY person, class, score)-1)/2 AS rk FROM (SELECT person, y, unnest(['F','O','P']) AS class, unnest([p_F,p_O,p_P]) AS score FROM sp)) GROUP BY ALL""")
def sta_auc(spark, sf):
    return X.auc_one_vs_rest(sp(spark, sf), T.CLASSES, P).withColumn("auc", r6("auc"))


@query("sta_accuracy_by_provenance", "STA-08", f"""
SELECT person, basis, n, round(k/n,4) AS accuracy, round({_LO},4) AS ci_low, round({_HI},4) AS ci_high FROM (SELECT person, basis, count(*) AS n, sum(correct) AS k FROM (
 SELECT *, 'confirmed' AS basis FROM sp WHERE provenance='confirmed' UNION ALL SELECT *, 'gold' FROM sp WHERE provenance='confirmed' AND gold UNION ALL SELECT *, 'bootstrap' FROM sp WHERE provenance<>'confirmed') GROUP BY ALL)""")
def sta_accuracy_by_provenance(spark, sf):
    return X.accuracy_by_provenance(sp(spark, sf), P)


@query("sta_coverage_curve", "STA-09", """
SELECT person, t/10.0::DOUBLE AS t, round(count(*) FILTER (WHERE conf>=t/10.0::DOUBLE)/count(*),4) AS coverage, round(avg(correct) FILTER (WHERE conf>=t/10.0::DOUBLE),4) AS precision FROM (SELECT *, unnest(range(0,10)) AS t FROM sp) GROUP BY ALL""")
def sta_coverage_curve(spark, sf):
    return X.coverage_curve(sp(spark, sf), P)


@query("sta_slice_accuracy", "STA-10", """
SELECT person, y AS activity, CASE WHEN h<5 OR h>=22 THEN 0 WHEN h<11 THEN 1 WHEN h<17 THEN 2 ELSE 3 END::BIGINT AS daypart, count(*) AS n, round(avg(correct),4) AS accuracy FROM (SELECT *, (row_id*7)%24 AS h FROM sp) GROUP BY ALL""")
def sta_slice_accuracy(spark, sf):
    rows = sp(spark, sf)
    midnight = F.col("minute") - F.pmod("minute", F.lit(1440))
    return X.slice_accuracy(rows.withColumn("minute", midnight + F.pmod(F.col("row_id") * 7, F.lit(24)) * 60), P)


D_SQL = "CASE WHEN a.n<2 OR b.n<2 THEN 0 WHEN sqrt(((a.n-1)*a.v+(b.n-1)*b.v)/(a.n+b.n-2))=0 THEN CASE WHEN a.m=b.m THEN 0 ELSE 10 END ELSE least(abs(a.m-b.m)/sqrt(((a.n-1)*a.v+(b.n-1)*b.v)/(a.n+b.n-2)),10) END"


@query("sta_cohens_d", "STA-11", f"""
WITH m AS (SELECT l_shipmode, feature, l_returnflag AS y, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM (UNPIVOT (SELECT l_linestatus AS l_shipmode, l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE value) GROUP BY ALL)
SELECT a.l_shipmode AS linestatus, a.feature, a.y AS a, b.y AS b, round({D_SQL},6) AS d FROM m a JOIN m b ON a.l_shipmode=b.l_shipmode AND a.feature=b.feature AND a.y<b.y""")
def sta_cohens_d(spark, sf):
    li = T.load(spark, sf, "lineitem").select(F.col("l_linestatus").alias("linestatus"), F.col("l_returnflag").alias("y"), "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    long = X.unpivot(li, ["linestatus", "y"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    m = X.class_moments(long, ["linestatus", "feature"], "y")
    a = m.select("linestatus", "feature", F.col("y").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("n", "mean", "var")])
    b = m.select("linestatus", "feature", F.col("y").alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("n", "mean", "var")])
    col = lambda s: {c: F.col(f"{s}_{c}") for c in ("n", "mean", "var")}
    j = a.join(b, ["linestatus", "feature"]).where("a < b")
    return j.select("linestatus", "feature", "a", "b", r6(X.cohens_d(col("a"), col("b"))).alias("d"))


@query("sta_discriminative_stats", "STA-12 TOP-05", f"""
WITH pr AS (SELECT y, predicted FROM sp WHERE y<>predicted GROUP BY ALL HAVING count(*)>=5 ORDER BY count(*) DESC, y, predicted LIMIT 3),
m AS (SELECT feature, y, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM (UNPIVOT (SELECT y, p_F, p_O, p_P, amount FROM sp) ON p_F, p_O, p_P, amount INTO NAME feature VALUE value) GROUP BY ALL)
SELECT a, b, feature, d, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY a, b ORDER BY d DESC, feature) AS INTEGER) AS rank FROM (SELECT pr.y AS a, pr.predicted AS b, a.feature, round({D_SQL},3) AS d FROM pr JOIN m a ON a.y=pr.y JOIN m b ON b.y=pr.predicted AND b.feature=a.feature)) WHERE rank<=5""")
def sta_discriminative_stats(spark, sf):
    rows = sp(spark, sf)
    pairs = top_confusions(X.confusion(rows, [])).select(F.col("y").alias("a"), F.col("predicted").alias("b"))
    long = X.unpivot(rows.select("y", "p_F", "p_O", "p_P", "amount"), ["y"], ["p_F", "p_O", "p_P", "amount"])
    return X.discriminative_stats(long, pairs)


def top_confusions(cells, k=3, min_count=5):
    """TOP-05: the largest off-diagonal cells."""
    off = cells.where((F.col("y") != F.col("predicted")) & (F.col("n") >= min_count))
    return off.orderBy(F.col("n").desc(), "y", "predicted").limit(k)


# --- reliability ------------------------------------------------------------------------------


def fact_rows(spark, sf):
    rows = tl(spark, sf)
    truth = T.label_events(spark, sf).where("provenance = 'confirmed'").groupBy(
        "person", (F.col("window_min") - F.col("window_min") % 30).alias("w")).agg(F.max((F.col("label") == "home").cast("double")).alias("truth"))
    fact = F.when(F.col("state") != "unknown", (F.col("state") == "asleep").cast("double"))
    return rows.join(truth, ["person", "w"], "left").select(
        "person", "w", fact.alias("fact"), ((F.col("basis") == "rule") & F.col("hour").between(8, 21)).alias("contradiction"), "truth")


PL_SQL = """kn AS (SELECT person, w, fact>0 AS o FROM factrows WHERE fact IS NOT NULL), st AS (SELECT *, w-lag(w) OVER x AS gap, o<>lag(o) OVER x AS flip, (w//60)%24>=22 OR (w//60)%24<8 AS night FROM kn WINDOW x AS (PARTITION BY person ORDER BY w)),
rn AS (SELECT *, sum(CASE WHEN flip THEN 1 ELSE 0 END) OVER (PARTITION BY person ORDER BY w) AS run FROM st),
ba AS (SELECT person, greatest(coalesce(median(gap),1),1) AS freq, max(w)-min(w) AS span, count(*) FILTER (WHERE flip) AS flips, count(*) FILTER (WHERE o) AS ast, count(*) FILTER (WHERE o AND night) AS nig, count(*) AS kno FROM rn GROUP BY person),
bl AS (SELECT person, median(len) AS block FROM (SELECT person, run, count(*) AS len FROM rn WHERE o GROUP BY ALL) GROUP BY person),
mi AS (SELECT person, avg(CAST(fact IS NULL AS INT)) AS miss FROM factrows GROUP BY person),
j AS (SELECT *, coalesce(flips/greatest(span/1440,freq/1440),0) AS fpd, coalesce(block*freq,0) AS bm, coalesce(nig/nullif(ast,0),0) AS nf, ast=0 OR ast=kno AS stuck FROM mi LEFT JOIN ba USING (person) LEFT JOIN bl USING (person)),
pl AS (SELECT person, round(CASE WHEN stuck THEN 0 ELSE (1-miss+1+CASE WHEN fpd<=8 THEN 1 ELSE greatest(0,1-(fpd-8)/24) END+least(1,bm/180)+least(1,nf/0.6))/5 END,3) AS plausibility, round(miss,3) AS missing_frac, stuck, round(fpd,1) AS flips_per_day, round(bm,1) AS median_block_min, round(nf,3) AS night_frac, span/1440 AS obs FROM j),
co AS (SELECT person, round(1-coalesce(c/nullif(n,0),0),3) AS corroboration, round(coalesce(c/nullif(n,0),0),3) AS contradiction_rate, n AS n_asserted FROM (SELECT person, count(*) FILTER (WHERE coalesce(fact,0)>0) AS n, count(*) FILTER (WHERE coalesce(fact,0)>0 AND contradiction) AS c FROM factrows GROUP BY person)),
ag AS (SELECT person, round(coalesce(2*tp/nullif(2*tp+fp+fn,0),0),3) AS agreement, round(coalesce(tp/nullif(tp+fp,0),0),3) AS precision, round(coalesce(tp/nullif(tp+fn,0),0),3) AS recall, n FROM (SELECT person, count(*) FILTER (WHERE coalesce(fact,0)>0 AND truth>0) AS tp, count(*) FILTER (WHERE coalesce(fact,0)>0 AND truth<=0) AS fp, count(*) FILTER (WHERE coalesce(fact,0)<=0 AND truth>0) AS fn, count(*) AS n FROM factrows WHERE truth IS NOT NULL GROUP BY person)),
vd AS (SELECT person, sc AS score, CASE WHEN obs<5 THEN 'feature' WHEN sc>=0.8 THEN 'fact' WHEN sc>=0.45 THEN 'feature' ELSE 'suspect' END AS decision FROM (SELECT person, obs, round(CASE WHEN agreement IS NOT NULL THEN 0.5*agreement+0.3*corroboration+0.2*plausibility ELSE 0.6*plausibility+0.4*corroboration END,3) AS sc FROM pl JOIN co USING (person) LEFT JOIN ag USING (person)))"""


@query("sta_plausibility", "STA-13", f"WITH {PL_SQL} SELECT person, plausibility, missing_frac, stuck, flips_per_day, median_block_min, night_frac FROM pl")
def sta_plausibility(spark, sf):
    return X.plausibility(fact_rows(spark, sf), P, X.SLEEP).drop("observation_days")


@query("sta_corroboration", "STA-14", f"WITH {PL_SQL} SELECT * FROM co")
def sta_corroboration(spark, sf):
    return X.corroboration(fact_rows(spark, sf), P)


@query("sta_label_agreement", "STA-15", f"WITH {PL_SQL} SELECT * FROM ag")
def sta_label_agreement(spark, sf):
    return X.label_agreement(fact_rows(spark, sf), P)


def verdicts(spark, sf):
    rows = fact_rows(spark, sf)
    parts = X.plausibility(rows, P, X.SLEEP).join(X.corroboration(rows, P), P, "left").join(X.label_agreement(rows, P), P, "left")
    return X.verdict(parts, X.SLEEP)


@query("sta_reliability_verdict", "STA-16", f"WITH {PL_SQL} SELECT * FROM vd")
def sta_reliability_verdict(spark, sf):
    return verdicts(spark, sf).select("person", "score", "decision")


@query("sta_awake_evidence", "STA-17", """
SELECT person, ws AS window_start, coalesce(o.v>0.3,false) OR coalesce(f.v>0.5,false) OR coalesce(f2.v>0.3,false) OR coalesce(s.v,0)>60 OR mv.v IS NOT NULL OR ((ws%1440)//60 BETWEEN 5 AND 21 AND NOT (coalesce(b.v,0)>0 AND coalesce(s.v,0)<=60)) AS awake FROM grid
LEFT JOIN (SELECT person, ws, greatest(avg(CAST(num>0 AS DOUBLE)), CAST(arg_max(num,m)>0 AS DOUBLE)) AS v FROM densewin WHERE role='light' GROUP BY ALL) o USING (person, ws)
LEFT JOIN (SELECT person, ws, max(CAST(str IN ('playing','paused') AS DOUBLE)) AS v FROM densewin WHERE role='media' GROUP BY ALL) f USING (person, ws)
LEFT JOIN (SELECT person, ws, CAST(arg_max(num,m)>0 AS DOUBLE) AS v FROM densewin WHERE role='focus' GROUP BY ALL) f2 USING (person, ws)
LEFT JOIN (SELECT person, ws, CASE WHEN count(*)>=2 THEN greatest(arg_max(num,m)-arg_min(num,m),0) END AS v FROM densewin WHERE role='steps' GROUP BY ALL) s USING (person, ws)
LEFT JOIN (SELECT person, ws, CASE WHEN count(*)>=2 THEN arg_max(num,m)-arg_min(num,m) END AS v FROM densewin WHERE role='battery' GROUP BY ALL) b USING (person, ws)
LEFT JOIN (SELECT DISTINCT person, minute-minute%30 AS ws, 1 AS v FROM dchg) mv USING (person, ws)""")
def sta_awake_evidence(spark, sf):
    f = feature_table(spark, sf)
    return f.select("person", "window_start", X.awake_evidence(f.columns).alias("awake"))


@query("sta_verdict_job", "STA-18", f"""WITH {PL_SQL}, pv AS (SELECT person, CASE WHEN max(k)%2=0 THEN 'fact' ELSE 'suspect' END AS previous FROM ev WHERE event_type='error' GROUP BY person)
SELECT person, score, decision, previous, CASE WHEN previous='fact' AND decision<>'fact' THEN 'demoted' WHEN previous<>'fact' AND decision='fact' THEN 'promoted' END AS event FROM vd LEFT JOIN pv USING (person)""")
def sta_verdict_job(spark, sf):
    old = T.events(spark, sf).where("event_type = 'error'").groupBy("person").agg(F.when(F.max("k") % 2 == 0, "fact").otherwise("suspect").alias("decision"))
    return X.verdict_changes(verdicts(spark, sf), old, P).select("person", "score", "decision", "previous", "event")


# --- sensors ------------------------------------------------------------------------------------


def sensor_changes(spark, sf):
    m = minutes(spark, sf)
    ch = X.value_changes(m, SERIES).select(F.col("person").alias("home"), F.col("binding").alias("sensor"), "minute")
    frame = m.groupBy(F.col("person").alias("home")).agg(F.min("minute").alias("first"), F.max("minute").alias("last"))
    return ch, frame


@query("sta_co_activation", "STA-21", "SELECT home, a, b, round(r,6) AS r FROM coact")
def sta_co_activation(spark, sf):
    return X.co_activation(*sensor_changes(spark, sf)).withColumn("r", r6("r"))


# the nearest two groups of a home are merged one by one; sums of r over the pairs of two groups
LINKAGE_SQL = """
WITH RECURSIVE c AS MATERIALIZED (SELECT * FROM coact), big AS (SELECT home FROM (SELECT home, a AS s FROM c UNION SELECT home, b FROM c) GROUP BY home HAVING count(*)>=4),
st AS (SELECT home, sensor, sensor AS lead, 0 AS i FROM (SELECT home, a AS sensor FROM c UNION SELECT home, b FROM c) JOIN big USING (home)
 UNION ALL SELECT s.home, s.sensor, CASE WHEN s.lead=m.hi THEN m.lo ELSE s.lead END, s.i+1 FROM st s JOIN (
  SELECT home, arg_min(lo, struct_pack(d := d, lo := lo, hi := hi)) AS lo, arg_min(hi, struct_pack(d := d, lo := lo, hi := hi)) AS hi FROM (
   SELECT home, lo, hi, 1-s/(x.n*y.n) AS d FROM (
    SELECT c.home, least(p.lead, q.lead) AS lo, greatest(p.lead, q.lead) AS hi, sum(r) AS s FROM c JOIN st p ON p.home=c.home AND p.sensor=c.a JOIN st q ON q.home=c.home AND q.sensor=c.b WHERE p.lead<>q.lead AND r<>0 GROUP BY ALL)
   JOIN (SELECT home, lead, count(*) AS n FROM st GROUP BY ALL) x USING (home) JOIN (SELECT home, lead, count(*) AS n FROM st GROUP BY ALL) y USING (home) WHERE x.lead=lo AND y.lead=hi) WHERE d<0.97 GROUP BY home) m USING (home)),
f AS (SELECT home, sensor, arg_max(lead, i) AS lead FROM st GROUP BY ALL)
SELECT home, sensor, dense_rank() OVER (PARTITION BY home ORDER BY lead)-1 AS group_id FROM f"""


@query("sta_sensor_groups", "STA-22", LINKAGE_SQL)
def sta_sensor_groups(spark, sf):
    return X.sensor_groups(X.co_activation(*sensor_changes(spark, sf)), threshold=0.97)


@query("sta_lead_lag_edges", "STA-23 JON-11 TOP-08", "SELECT *, CAST(row_number() OVER (PARTITION BY home ORDER BY strength DESC, from_sensor, to_sensor) AS INTEGER) AS rank FROM ledges WHERE strength>=0.02")
def sta_lead_lag_edges(spark, sf):
    return X.lead_lag(*sensor_changes(spark, sf), min_strength=0.0195)


@query("sta_marker_suggestions", "STA-24", """
WITH b AS (SELECT DISTINCT binding AS name, role FROM reading), a AS (SELECT DISTINCT smoothed AS slug FROM timeline), ex AS (SELECT DISTINCT binding AS from_sensor, 'asleep' AS to_state FROM reading WHERE role='env')
SELECT home, from_sensor, to_sensor, CASE role WHEN 'bed' THEN 'asleep' ELSE 'away' END AS to_state, lag_min, strength FROM ledges JOIN b ON b.name=to_sensor AND role IN ('bed','person') WHERE strength>=0.02 AND CASE role WHEN 'bed' THEN 'asleep' ELSE 'away' END IN (FROM a) AND (from_sensor, CASE role WHEN 'bed' THEN 'asleep' ELSE 'away' END) NOT IN (FROM ex)""")
def sta_marker_suggestions(spark, sf):
    edges = X.lead_lag(*sensor_changes(spark, sf), min_strength=0.0195)
    b = T.readings(spark, sf).select(F.col("binding").alias("name"), "role").distinct()
    acts = T.timeline(spark, sf).select(F.col("smoothed").alias("slug")).distinct()
    existing = b.where("role = 'env'").select(F.col("name").alias("from_sensor"), F.lit("asleep").alias("to_state"))
    return X.suggest_markers(edges, b, acts, existing, 0.02).select("home", "from_sensor", "to_sensor", "to_state", "lag_min", "strength")


def fires_moves(spark, sf):
    fires = T.events(spark, sf).where("event_type = 'click' and k < 40").select("person", F.col("minute").alias("fire")).distinct()
    w = Window.partitionBy("person").orderBy("w")
    rows = tl(spark, sf).withColumn("p", F.lag("state").over(w))
    return fires, rows.where("state = 'asleep' and p <> 'asleep'").select("person", F.col("w").alias("move"))


@query("jon_fires_transitions", "JON-08", """
SELECT f.person, fire, arg_min(move, abs(move-fire)*1000000000+move) AS move FROM fires f JOIN moves m ON m.person=f.person AND m.move BETWEEN f.fire-15 AND f.fire+90 GROUP BY ALL""")
def jon_fires_transitions(spark, sf):
    return X.match_fires(*fires_moves(spark, sf), P)


@query("sta_marker_timing", "STA-25", """
WITH b AS (SELECT f.person, fire, arg_min(move, abs(move-fire)*1000000000+move) AS move FROM fires f JOIN moves m ON m.person=f.person AND m.move BETWEEN f.fire-15 AND f.fire+90 GROUP BY ALL),
g AS (SELECT person, median(move-fire) AS med, stddev_pop(move-fire) AS sd, count(*) AS hits FROM b GROUP BY person), nf AS (SELECT person, count(*) AS n_fires FROM fires GROUP BY person), nm AS (SELECT person, count(*) AS n_transitions FROM moves GROUP BY person),
mm AS (SELECT person, count(*) AS mt FROM moves m WHERE EXISTS (SELECT 1 FROM fires f WHERE f.person=m.person AND f.fire BETWEEN m.move-90 AND m.move+15) GROUP BY person),
r AS (SELECT person, n_fires, n_transitions, CAST(coalesce(round(med/30),0)*30 AS BIGINT) AS lead_min, round(CASE WHEN hits>1 THEN sd ELSE 0 END,1) AS spread_min, round(coalesce(hits,0)/n_fires,3) AS precision, round(coalesce(mt,0)/n_transitions,3) AS recall FROM nf JOIN nm USING (person) LEFT JOIN g USING (person) LEFT JOIN mm USING (person))
SELECT *, round(precision*CASE WHEN spread_min<=30 THEN 1 ELSE greatest(0.3,1-(spread_min-30)/90) END,3) AS strength FROM r""")
def sta_marker_timing(spark, sf):
    return X.marker_timing(*fires_moves(spark, sf), P)


@query("sta_marker_fired", "STA-26", """
SELECT person, ws AS window_start, coalesce(a.v,false) AS door_fired, coalesce(b.v,false) AS light_fired FROM grid LEFT JOIN (SELECT person, ws, max(num)>0 AS v FROM densewin WHERE role='door' GROUP BY ALL) a USING (person, ws)
LEFT JOIN (SELECT person, ws, avg(CAST(num>0 AS DOUBLE))>0.3 OR arg_max(num,m)>0 AS v FROM densewin WHERE role='light' GROUP BY ALL) b USING (person, ws)""")
def sta_marker_fired(spark, sf):
    f = feature_table(spark, sf)
    return f.select("person", "window_start", X.marker_fired(f.columns, "signup_door").alias("door_fired"), X.marker_fired(f.columns, "view_light").alias("light_fired"))


@query("sta_marker_prior", "STA-27", """
WITH u AS (SELECT event_id, k%101/100.0 AS st, smoothed, CASE WHEN event_id%2=0 THEN 'cooking' END AS fs, a, b, c FROM pred5),
v AS (SELECT *, (fs IS NULL OR fs=smoothed) AND st>0 AS ap FROM u),
x AS (SELECT *, CASE WHEN ap AND smoothed='cooking' THEN a*(1-0.7*st) ELSE a END AS a2, CASE WHEN ap THEN b*(1+5*st)+1e-6 ELSE b END AS b2, CASE WHEN ap AND smoothed='home' THEN c*(1-0.7*st) ELSE c END AS c2 FROM v)
SELECT event_id, round(CASE WHEN ap THEN a2/(a2+b2+c2) ELSE a END,5) AS cooking, round(CASE WHEN ap THEN b2/(a2+b2+c2) ELSE b END,5) AS movie FROM x""")
def sta_marker_prior(spark, sf):
    p = T.prediction_rows(spark, sf)
    q = p.select("event_id", X.marker_prior(F.col("probs"), F.col("smoothed"), F.when(F.col("event_id") % 2 == 0, "cooking"), F.lit("movie"), (F.col("k") % 101) / 100.0).alias("q"))
    return q.select("event_id", *[F.round(F.col("q")[c], 5).alias(c) for c in ("cooking", "movie")])


