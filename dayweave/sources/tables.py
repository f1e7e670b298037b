"""Star-schema tables read as sensor data: readings, timelines, bindings, entities, activities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare

PERSONS = 8  # people the users of the event table are folded into
WINDOW_MIN = 30


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with UTC timestamp, epoch minute, person and home."""
    raw = load(spark, sf_dir, "events")
    return as_events(raw)


def as_events(raw: DataFrame) -> DataFrame:
    person = F.pmod("user_id", F.lit(PERSONS))
    return raw.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.expr("unix_micros(cast(ts as timestamp)) div 60000000").alias("minute"),
        F.concat(F.lit("p"), person.cast("string")).alias("person"),
        F.concat(F.lit("h"), F.floor(person / 2).cast("string")).alias("home"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def _series() -> dict[str, list[tuple[str, str | None, Column | None, Column | None]]]:
    v, k = F.col("value"), F.col("k")
    none_s, none_n = F.lit(None).cast("string"), F.lit(None).cast("double")
    num = lambda c: c.cast("double")
    return {
        "click": [("presence", "kitchen", num(v > 30), none_s), ("bed", "bedroom", num(k / 50.0), none_s)],
        "view": [
            ("presence", "living", num(v > 40), none_s),
            ("media", "living", none_n, F.when(v > 60, "playing").when(v > 20, "paused").otherwise("idle")),
            ("light", "living", num(k > 50), none_s),
        ],
        "signup": [
            ("door", "hall", num(v > 30), none_s),
            ("person", None, none_n, F.when(k >= 40, "home").otherwise("not_home")),
            ("focus", None, num(k % 2), none_s),
        ],
        "purchase": [
            ("power", "kitchen", num(v), none_s),
            ("steps", None, num(k * 100), none_s),
            ("alarm_time", None, none_n, F.format_string("%02d:%02d", F.pmod(k, F.lit(24)), F.pmod(F.col("event_id"), F.lit(60)))),
        ],
        "error": [
            ("presence", "bedroom", num(v > 25), none_s),
            ("env", "living", num(v), none_s),
            ("battery", None, num(k), none_s),
            ("custom", "bedroom", num(v + k), none_s),
        ],
    }


def as_readings(ev: DataFrame) -> DataFrame:
    """Long raw table: one row per (person, binding, ts); exactly one of num and str set."""
    per_type = F
    for event_type, series in _series().items():
        rows = F.array(
            *[
                F.struct(
                    F.lit(f"{event_type}_{role}").alias("binding"),
                    F.lit(role).alias("role"),
                    F.lit(room).cast("string").alias("room"),
                    n.alias("num"),
                    s.alias("str"),
                )
                for role, room, n, s in series
            ]
        )
        per_type = per_type.when(F.col("event_type") == event_type, rows)
    return ev.select("home", "person", "ts", "minute", "event_id", F.explode(per_type).alias("r")).select(
        "home", "person", "ts", "minute", F.col("event_id").alias("write_seq"), "r.*"
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_readings(events(spark, sf_dir))


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prediction row per person and half hour that saw an event."""
    ev = events(spark, sf_dir).withColumn("w", F.col("minute") - F.pmod("minute", F.lit(WINDOW_MIN)))
    per_type = ev.groupBy("home", "person", "w", "event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.struct("ts", "event_type")).alias("last"),
        F.max("k").alias("mk"),
        F.sum("k").alias("sk"),
        F.min("event_id").alias("fid"),
    )
    states = F.create_map(*[F.lit(x) for kv in STATE_OF_TYPE.items() for x in kv])
    per_win = per_type.groupBy("home", "person", "w").agg(
        F.min_by("event_type", F.struct((-F.col("n")).alias("n"), "event_type")).alias("top"),
        F.max("last").alias("last"),
        F.max("mk").alias("mk"),
        F.sum("sk").alias("sk"),
        F.min("fid").alias("fid"),
    )
    tod = F.pmod("w", F.lit(1440))
    night = ((tod < 420) | (tod >= 1380)) & (F.col("mk") >= 20)
    return per_win.select(
        "home",
        "person",
        "w",
        states[F.col("last.event_type")].alias("predicted"),
        F.when(night, "asleep").otherwise(states[F.col("top")]).alias("smoothed"),
        F.element_at(F.array(*[F.lit(x) for x in VERSIONS]), (F.pmod("fid", F.lit(3)) + 1).cast("int")).alias("model_version"),
        (F.lit(20) + F.pmod("sk", F.lit(80))).cast("double").alias("_c"),
    ).withColumn("confidence", F.col("_c") / 100.0).drop("_c")


# Activity shown by each event type, and model versions.
STATE_OF_TYPE = {"click": "cooking", "view": "movie", "signup": "away", "purchase": "home", "error": "unknown"}
VERSIONS = ["fact:presence", "rules-only", "rf-3"]


def label_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human, rule and model labels: signup and purchase events."""
    ev = events(spark, sf_dir).where(F.col("event_type").isin("signup", "purchase"))
    prov = F.element_at(
        F.array(*[F.lit(x) for x in ["bootstrap", "llm", "discovered", "confirmed"]]),
        (F.pmod("event_id", F.lit(4)) + 1).cast("int"),
    )
    return ev.select(
        "person",
        F.col("minute").alias("window_min"),
        (F.col("minute") + F.col("k")).alias("written_min"),
        F.when(F.col("event_type") == "signup", "away").otherwise("home").alias("label"),
        F.when(F.col("k") % 3 == 0, F.lit("cooking")).alias("activity"),
        prov.alias("provenance"),
        F.when(F.pmod("event_id", F.lit(2)) == 0, F.lit("ui")).alias("source"),
        (F.pmod("event_id", F.lit(7)) == 0).alias("gold"),
        F.col("event_id").alias("arrival"),
    )


# Fixed values the part table is read with.
ENTITY_DOMAIN = {
    "STANDARD": "sensor", "PROMO": "binary_sensor", "LARGE": "light",
    "SMALL": "media_player", "MEDIUM": "device_tracker", "ECONOMY": "switch",
}
DEVICE_CLASSES = ["temperature", "humidity", "motion", "door", "battery", "power", "occupancy", "signal_strength"]
UNITS = ["°C", "%", None, None, "%", "W", None, "dBm"]
ROOM_SPELLINGS = ["Living Room", "living_room", "livingroom", "Kitchen", "kitchen", "Bed-Room", "bedroom", "Hall", None]
ROLES = ["presence", "bed", "power", "light", "media", "env", "person", "focus", "alarm_time", "door", "steps", "battery", "custom"]


def _pick(values: list, index) -> Column:
    arr = F.array(*[F.lit(v).cast("string") for v in values])
    return F.element_at(arr, (index + 1).cast("int"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hub entity metadata, one per part."""
    p = load(spark, sf_dir, "part")
    domains = F.create_map(*[F.lit(x) for kv in ENTITY_DOMAIN.items() for x in kv])
    key, size = F.col("p_partkey"), F.col("p_size")
    cls = F.pmod(size, F.lit(8))
    return p.select(
        key.alias("part_id"),
        F.concat(
            domains[F.col("p_type")], F.lit("."), F.regexp_replace(F.lower("p_name"), " ", "_"), F.lit("_"), key.cast("string")
        ).alias("entity_id"),
        F.concat(F.initcap("p_name"), F.lit(" "), F.lower("p_brand")).alias("friendly_name"),
        _pick(DEVICE_CLASSES, cls).alias("device_class"),
        _pick(UNITS, cls).alias("unit"),
        F.concat(F.lit("dev"), F.floor(key / 7).cast("string")).alias("device_id"),
        F.lower(F.regexp_replace("p_brand", "#", "_")).alias("integration"),
        _pick(ROOM_SPELLINGS, F.pmod(size, F.lit(9))).alias("area"),
        (size % 11 == 0).alias("disabled"),
        F.when(size % 13 == 0, "diagnostic").alias("entity_category"),
        F.col("p_retailprice").alias("price"),
        size.alias("size"),
    )


def bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity → role assignments, one per part."""
    e = entities(spark, sf_dir)
    key = F.col("part_id")
    role = _pick(ROLES, F.pmod(key, F.lit(13)))
    return e.select(
        key.alias("binding_id"),
        "entity_id",
        F.concat(F.regexp_replace(F.element_at(F.split("entity_id", r"\."), 2), "_[0-9]+$", ""), F.lit("_"), role, F.lit("_"), key.cast("string")).alias("name"),
        role.alias("role"),
        F.col("area").alias("room"),
        F.when(F.pmod(key, F.lit(5)) == 0, F.concat(F.lit("p"), F.pmod(key, F.lit(PERSONS)).cast("string"))).alias("person_id"),
        (F.col("size") != 50).alias("enabled"),
        (F.pmod(key, F.lit(17)) == 0).alias("model_excluded"),
        F.when(F.pmod(key, F.lit(19)) == 0, (F.pmod(key, F.lit(3)) + 1).cast("int")).alias("tier_option"),
        "device_id",
        "price",
    )


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Household members, one per customer."""
    c = load(spark, sf_dir, "customer")
    return c.select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("person_id"),
        F.concat_ws(" ", F.lower("c_mktsegment"), F.col("c_custkey").cast("string")).alias("name"),
        F.col("c_custkey").alias("ord"),
        (F.col("c_acctbal") > 0).alias("enabled"),
        (F.col("c_acctbal") > 2000).alias("opted_in"),
    )


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-level taxonomy: regions on top, nations below."""
    region, nation = load(spark, sf_dir, "region"), load(spark, sf_dir, "nation")
    top = region.select(
        F.col("r_regionkey").cast("long").alias("id"), F.lower("r_name").alias("slug"), F.lit(None).cast("long").alias("parent_id")
    )
    fine = nation.select(
        (F.col("n_nationkey") + 100).cast("long").alias("id"),
        F.lower("n_name").alias("slug"),
        F.col("n_regionkey").cast("long").alias("parent_id"),
    )
    return top.unionByName(fine)


def prediction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-minute predictions with a probability map; repeated writes included."""
    ev = events(spark, sf_dir)
    slot = F.col("minute") - F.pmod("minute", F.lit(5))
    total = F.col("value") + F.col("k") + 10.0
    a, b = F.round(F.col("value") / total, 4), F.round(F.col("k") / total, 4)
    states = F.create_map(*[F.lit(x) for kv in STATE_OF_TYPE.items() for x in kv])
    probs = F.map_from_arrays(F.array(F.lit("cooking"), F.lit("movie"), F.lit("home")), F.array(a, b, F.round(1 - a - b, 4)))
    return ev.select(
        "home",
        "person",
        slot.alias("w"),
        states[F.col("event_type")].alias("smoothed"),
        probs.alias("probs"),
        F.when(F.pmod("event_id", F.lit(3)) > 0, F.lit("rf-3")).alias("model"),
        "event_id",
        "k",
        "value",
    )


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out rows of a classifier: truth, three class probabilities, provenance, slice keys."""
    o = load(spark, sf_dir, "orders")
    x = F.pmod(F.col("o_custkey") * 7 + F.col("o_orderkey"), F.lit(97)) + 1
    y = F.pmod(F.col("o_orderkey") * 3 + F.col("o_custkey"), F.lit(89)) + 1
    z = F.pmod(F.col("o_orderkey") * 5, F.lit(83)) + 1
    s = (x + y + z).cast("double")
    return o.select(
        F.col("o_orderkey").alias("row_id"),
        F.concat(F.lit("p"), F.pmod("o_custkey", F.lit(PERSONS)).cast("string")).alias("person"),
        F.col("o_orderstatus").alias("y"),
        F.round(x / s, 4).alias("p_F"),
        F.round(y / s, 4).alias("p_O"),
        F.round(z / s, 4).alias("p_P"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "confirmed")
        .when(F.col("o_orderpriority") == "2-HIGH", "discovered")
        .when(F.col("o_orderpriority") == "5-LOW", "llm")
        .otherwise("bootstrap")
        .alias("provenance"),
        (F.pmod("o_orderkey", F.lit(3)) == 0).alias("gold"),
        F.expr("unix_micros(cast(o_orderdate as timestamp)) div 60000000").alias("minute"),
        F.col("o_totalprice").alias("amount"),
    )


CLASSES = ["F", "O", "P"]
