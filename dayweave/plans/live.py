"""Streaming queries: each drains the event table as a file stream into a written table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.chains import model_texts
from ..session import ensure_checkpoint_dir, materialise, prepare, scratch_path
from ..sources import tables as T
from ..streaming import alarms, corrections
from ..streaming import live as S
from ..streaming.filtering import stream_filter
from .catalog import query
from .learning import CHAIN_SQL, chain_rows, chain_tables

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def stream(spark, sf):
    prepare(spark)
    S.use_rocksdb(spark)
    return T.as_events(S.file_source(spark, f"{sf}/event[s].parquet", EVENT_SCHEMA))


def reading_stream(spark, sf):
    return T.as_readings(stream(spark, sf))


WM6 = "(SELECT max(ts) - INTERVAL 6 HOUR FROM ev)"


@query("str_sliding_windows", "STR-01", f"""
SELECT person, binding, epoch_us(ws)//60000000/1.0 AS window_start, count(*) AS n, round(sum(num),6) AS total, max(num) AS vmax, arg_max(num, ts) AS last FROM (
 SELECT *, time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE*unnest(range(6)) AS ws FROM reading) WHERE ws + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 6 HOUR FROM reading) GROUP BY ALL""")
def str_sliding_windows(spark, sf):
    got = S.run_available(S.sliding_stats(reading_stream(spark, sf), ["person", "binding"]))
    return got.withColumn("total", F.round("total", 6))


@query("str_deduplicated", "STR-08 SRC-01", "SELECT DISTINCT person, binding, minute FROM reading")
def str_deduplicated(spark, sf):
    rows = reading_stream(spark, sf)
    again = rows.unionByName(reading_stream(spark, sf))  # every row delivered twice
    return S.run_available(S.deduplicate(again, ["person", "binding", "minute"]).select("person", "binding", "minute"))


@query("str_fan_out", "STR-09", """
SELECT r.write_seq, r.binding, m.member FROM (SELECT *, CASE WHEN role='person' THEN person END AS pid FROM reading) r JOIN (SELECT DISTINCT home, person AS member FROM ev) m USING (home) WHERE pid IS NULL OR pid=m.member""")
def str_fan_out(spark, sf):
    rows = reading_stream(spark, sf).withColumn("person_id", F.when(F.col("role") == "person", F.col("person")))
    members = T.events(spark, sf).select("home", F.col("person").alias("member")).distinct()
    return S.run_available(S.fan_out(rows, members).select("write_seq", "binding", "member"))


@query("str_sessions", "STR-07", f"""
SELECT person, event_type, count(*) AS rows, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM (SELECT *, sum(nw) OVER (PARTITION BY person, event_type ORDER BY ts) AS run FROM (
 SELECT *, CASE WHEN epoch_us(ts)-lag(epoch_us(ts)) OVER (PARTITION BY person, event_type ORDER BY ts) < 600000000 THEN 0 ELSE 1 END AS nw FROM ev)) GROUP BY person, event_type, run HAVING max(ts)+INTERVAL 10 MINUTE <= {WM6}""")
def str_sessions(spark, sf):
    got = S.run_available(S.sessions(stream(spark, sf), ["person", "event_type"]))
    return got.select("person", "event_type", "rows", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))


@query("str_intervals", "STR-02", """
SELECT person, binding, minute AS from_min, least(minute+keep, nx) AS to_min, num, str FROM (SELECT *, lead(minute) OVER (PARTITION BY person, binding ORDER BY minute) AS nx,
 1+CASE role WHEN 'presence' THEN 5 WHEN 'bed' THEN 10 WHEN 'power' THEN 10 WHEN 'light' THEN 240 WHEN 'media' THEN 5 WHEN 'env' THEN 120 WHEN 'person' THEN 10080 WHEN 'focus' THEN 10
 WHEN 'alarm_time' THEN 10080 WHEN 'door' THEN 0 WHEN 'steps' THEN 30 WHEN 'battery' THEN 120 ELSE 30 END AS keep FROM minutely), (SELECT epoch_us(max(ts) - INTERVAL 10 MINUTE)//60000000 AS wm FROM reading)
WHERE minute < wm AND (nx < wm OR minute+keep <= wm) AND least(minute+keep, nx) IS NOT NULL""")
def str_intervals(spark, sf):
    return S.run_available(S.stream_intervals(reading_stream(spark, sf))).drop("role")


SMOOTH_SQL = """
WITH RECURSIVE e AS (SELECT person, minute AS w, arg_max(event_type, ts) AS t, arg_max(k, ts) AS k FROM ev GROUP BY person, minute), s AS (SELECT person, w, CASE t WHEN 'click' THEN 'cooking' WHEN 'view' THEN 'movie' WHEN 'signup' THEN 'away' WHEN 'purchase' THEN 'home' ELSE 'unknown' END AS predicted, CAST(20+k%80 AS DOUBLE)/100 AS confidence, row_number() OVER (PARTITION BY person ORDER BY w) AS i FROM e WHERE w < (SELECT epoch_us(max(ts) - INTERVAL 10 MINUTE)//60000000 FROM ev)),
r AS (SELECT person, i, w, predicted, confidence, predicted AS pub, true AS chg FROM s WHERE i=1 UNION ALL
 SELECT person, i, w, predicted, confidence, np, np<>pub FROM (SELECT s.*, r.pub, CASE WHEN s.confidence>=r.confidence+0.25 OR r.predicted=s.predicted THEN s.predicted ELSE r.pub END AS np FROM r JOIN s ON s.person=r.person AND s.i=r.i+1))"""


def minute_labels(spark, sf):
    """Batch copy of the label stream with one row per person and minute, replayed as a stream."""
    ev = T.events(spark, sf)
    states = F.create_map(*[F.lit(x) for kv in T.STATE_OF_TYPE.items() for x in kv])
    row = F.struct(states[F.col("event_type")].alias("predicted"), ((F.lit(20) + F.col("k") % 80) / 100.0).alias("confidence"))
    one = ev.groupBy("person", F.col("minute").alias("w")).agg(F.max_by(row, "ts").alias("r"), F.max("ts").alias("ts")).select("person", "ts", "w", "r.*")
    import uuid

    path = f"{ensure_checkpoint_dir(spark)}/labels-{uuid.uuid4().hex}"
    one.write.parquet(path)
    S.use_rocksdb(spark)
    return S.file_source(spark, path, one.schema)


@query("str_smoothing", "STR-06", SMOOTH_SQL + " SELECT person, w, predicted, pub AS published FROM r")
def str_smoothing(spark, sf):
    return S.run_available(S.stream_smoothing(minute_labels(spark, sf))).drop("run_len")


@query("str_change_only", "STR-05", SMOOTH_SQL + " SELECT person, w, predicted, pub AS published FROM r WHERE chg")
def str_change_only(spark, sf):
    return S.run_available(S.stream_smoothing(minute_labels(spark, sf), changes_only=True)).drop("run_len")


def raw_store(spark, sf):
    import uuid

    path = f"{ensure_checkpoint_dir(spark)}/raw-{uuid.uuid4().hex}"
    S.run_available(reading_stream(spark, sf), sink=S.raw_writer(path))
    return spark.read.parquet(path)


@query("str_raw_writer", "SRC-03 SRC-10", "SELECT strftime(ts, '%Y-%m-%d') AS date, binding, count(*) AS n FROM reading GROUP BY ALL")
def str_raw_writer(spark, sf):
    return raw_store(spark, sf).groupBy(F.col("date").cast("string").alias("date"), "binding").agg(F.count("*").alias("n"))


@query("str_incremental_features", "WIN-08 SRC-14", """
SELECT person, binding, min(minute) AS first_minute, count(*) AS n FROM reading, (SELECT person AS p, max(minute-minute%30)+5-180 AS fl FROM reading WHERE role='door' GROUP BY person) WHERE p=person AND minute>=fl GROUP BY ALL""")
def str_incremental_features(spark, sf):
    from ..operators.windows import since_high_water

    raw = raw_store(spark, sf)
    done = raw.where("role = 'door'").select("person", (F.col("minute") - F.col("minute") % 30).alias("window_start"))
    got = since_high_water(raw, done, ["person"], raw.agg(F.max("minute")).scalar())
    return got.groupBy("person", "binding").agg(F.min("minute").alias("first_minute"), F.count("*").alias("n"))


@query("str_live_sink", "SRC-29 STR-03", "SELECT person, max(minute) AS w FROM ev GROUP BY person")
def str_live_sink(spark, sf):
    import uuid

    path = f"{ensure_checkpoint_dir(spark)}/live-{uuid.uuid4().hex}"
    rows = stream(spark, sf).select("person", F.col("minute").alias("w"))
    S.run_available(rows, sink=S.state_sink(path))
    return S.current_state(spark, path)


@query("str_live_scoring", "STR-04", """
WITH n AS (SELECT event_type, minute%1440//60 AS hour, count(*) AS n FROM ev GROUP BY ALL),
c AS (SELECT event_type, sum(n) AS total FROM n GROUP BY ALL), a AS (SELECT sum(n) AS everything FROM n),
s AS (SELECT hour, event_type, (total/everything)*((n+1.0)/(total+24)) AS score FROM n JOIN c USING (event_type), a),
m AS (SELECT hour, arg_min(event_type, struct_pack(s := -score, e := event_type)) AS state, round(max(score)/sum(score),6) AS confidence FROM s GROUP BY hour),
l AS (SELECT person, max(epoch_us(ts)) AS us FROM ev GROUP BY person)
SELECT person, us AS w, state, confidence FROM l JOIN m ON m.hour=us//3600000000%24""")
def str_live_scoring(spark, sf):
    import uuid

    # naive Bayes over the hour of day, fitted on the history and looked up by the current row's hour
    n = T.events(spark, sf).groupBy("event_type", F.floor(F.col("minute") % 1440 / 60).alias("hour")).agg(F.count("*").alias("n"))
    total = n.groupBy("event_type").agg(F.sum("n").alias("total"))
    joint = n.join(total, "event_type").withColumn("score", F.col("total") / n.agg(F.sum("n")).scalar() * ((F.col("n") + 1.0) / (F.col("total") + 24)))
    model = materialise(joint.groupBy("hour").agg(F.min_by("event_type", F.struct((-F.col("score")).alias("s"), F.col("event_type").alias("e"))).alias("state"), F.round(F.max("score") / F.sum("score"), 6).alias("confidence")), "hour-model")

    def score(df):
        return df.withColumn("hour", F.floor(F.col("w") / 3_600_000_000) % 24).join(model, "hour").select("person", "w", "state", "confidence")

    path = f"{ensure_checkpoint_dir(spark)}/score-{uuid.uuid4().hex}"
    rows = stream(spark, sf).select("person", F.unix_micros("ts").alias("w"))
    S.run_available(rows, sink=S.scorer(score, path))
    return S.current_state(spark, path)


@query("str_heartbeat", "STR-10", """
WITH m AS (SELECT DISTINCT person, minute FROM ev WHERE minute < (SELECT epoch_us(max(ts) - INTERVAL 10 MINUTE)//60000000 FROM ev)), g AS (SELECT person, minute, lag(minute) OVER (PARTITION BY person ORDER BY minute) AS p FROM m)
SELECT person AS source, unnest(['silent','recovered']) AS status, unnest([p+180, minute]) AS minute FROM g WHERE minute-p>180
UNION ALL SELECT person, 'silent', max(minute)+180 FROM m GROUP BY person HAVING (SELECT epoch_us(max(ts) - INTERVAL 10 MINUTE)//60000000 FROM ev)-max(minute)>180""")
def str_heartbeat(spark, sf):
    return S.run_available(S.heartbeat_monitor(stream(spark, sf), "person", 180))


# --- clocks, corrections and the forward filter in state ----------------------------------------------


@query("str_silence_alarm", "STR-10", "SELECT DISTINCT person AS source, 'silent' AS status FROM ev")
def str_silence_alarm(spark, sf):
    """All rows arrive at once and nothing after them: every source falls silent by the clock alone."""
    people = T.events(spark, sf).select("person").distinct().count()
    log = alarms.run_until(alarms.silence_alarm(stream(spark, sf), "person", quiet_s=3, renew_s=None), lambda df: df.count() >= people)
    return log.select("source", "status")


@query("str_debounce", "STR-03", """
WITH RECURSIVE e AS (SELECT person, epoch_us(ts)//1000 AS ms, count(*) AS c FROM ev GROUP BY ALL), wm AS (SELECT max(ms)-600000 AS w FROM e),
f AS (SELECT person, ms, min(ms) OVER (PARTITION BY person ORDER BY ms RANGE BETWEEN 1800000 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx,
 sum(c) OVER (PARTITION BY person ORDER BY ms RANGE BETWEEN CURRENT ROW AND 1799999 FOLLOWING) AS n FROM e, wm WHERE ms < w),
b AS (SELECT f.person, f.ms, nx, n FROM f JOIN (SELECT person, min(ms) AS ms FROM f GROUP BY person) USING (person, ms) UNION ALL SELECT f.person, f.ms, f.nx, f.n FROM b JOIN f ON f.person=b.person AND f.ms=b.nx)
SELECT person, ms+1800000 AS at_ms, 'burst' AS reason, CAST(n AS BIGINT) AS n FROM b, wm WHERE ms+1800000<=w
UNION ALL SELECT person, ms+1800000+21600000*unnest(range(1, (least(coalesce(nx, w), w)-ms-1800000)//21600000+1)), 'tick', 0 FROM b, wm WHERE ms+1800000<=w""")
def str_debounce(spark, sf):
    return S.run_available(alarms.debounce(stream(spark, sf), wait_s=1800, tick_s=21_600, late="10 minutes"))


# the last write of every (person, binding, ts): a correction doubles each fifth number
LAST_SQL = """w AS (SELECT person, binding, ts, num, str, write_seq FROM reading UNION ALL SELECT person, binding, ts, num*2, str, write_seq+1000000000 FROM reading WHERE write_seq%5=0),
l AS (SELECT person, binding, ts, arg_max(struct_pack(num := num, str := str), write_seq) AS r FROM w GROUP BY ALL)"""


def corrected_stream(spark, sf):
    """Readings, then corrections of some of them, then a part of both once more: three deliveries, one micro-batch each."""
    rows = T.readings(spark, sf).select("person", "binding", "ts", "num", "str", "write_seq")
    later = rows.where("write_seq % 5 = 0").withColumns({"num": F.col("num") * 2, "write_seq": F.col("write_seq") + 1_000_000_000})
    path, files = scratch_path(spark, "deliveries"), spark.sparkContext.defaultParallelism
    for i, part in enumerate((rows, later, rows.where("write_seq % 3 = 0").unionByName(later.where("write_seq % 2 = 0")))):
        # as many files each, so that one micro-batch is one delivery, written and read by many tasks
        part.repartition(files, "write_seq").write.parquet(f"{path}/{i}")
    S.use_rocksdb(spark)
    return S.file_source(spark, f"{path}/*", rows.schema, files_per_trigger=files)


@query("str_corrected_readings", "STR-08", f"WITH {LAST_SQL} SELECT person, binding, epoch_us(ts) AS us, r.num AS num, r.str AS str FROM l")
def str_corrected_readings(spark, sf):
    return corrections.folded(S.run_available(corrections.corrected_readings(corrected_stream(spark, sf), keep="3650 days")))


@query("str_corrected_windows", "STR-08 STR-01", f"""
WITH {LAST_SQL} SELECT person, binding, epoch_us(ts)//60000000//30*30 AS window_start, count(*) AS n, round(sum(r.num),6) AS total, max(r.num) AS vmax, arg_max(r.num, ts) AS last FROM l GROUP BY ALL""")
def str_corrected_windows(spark, sf):
    path = scratch_path(spark, "corrected")
    S.run_available(corrections.corrected_windows(corrected_stream(spark, sf), keep="3650 days"), sink=alarms.log_sink(path))
    got = corrections.newest(spark.read.parquet(path), ["person", "binding", "window_start"], ["batch_id"])
    return got.select("person", "binding", "window_start", "n", F.round("total", 6).alias("total"), "vmax", "last")


def flat_windows(rows):
    """Windows of the scoring chain as a stream delivers them."""
    return rows.select("person", F.timestamp_seconds(F.col("w") * 60).alias("ts"), "w", "part", "gate", F.to_json("probs").alias("probs"), F.to_json("fired").alias("fired"))


@query("str_forward_filter", "STR-06 SEQ-10 SEQ-11", CHAIN_SQL[: CHAIN_SQL.index("f AS (SELECT ch.person")].rstrip().rstrip(",") + """
SELECT person, w, coarse, round(CASE coarse WHEN 'cooking' THEN pc WHEN 'home' THEN ph WHEN 'movie' THEN pm ELSE 1 END, 6) AS confidence FROM ch WHERE w < (SELECT max(w)-10 FROM x)""")
def str_forward_filter(spark, sf):
    models = materialise(model_texts(*chain_tables(spark, sf)), "models")
    windows, path = flat_windows(chain_rows(spark, sf)), scratch_path(spark, "windows")
    windows.write.parquet(path)
    S.use_rocksdb(spark)
    got = S.run_available(stream_filter(S.file_source(spark, path, windows.schema), models))
    return got.select("person", "w", "coarse", F.round("coarse_confidence", 6).alias("confidence"))
