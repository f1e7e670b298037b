"""Label merging, anti joins, as-of and nearest joins, look-ups at a lead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.segments import last_known

# How far each source of a label is trusted.
TRUST = {"bootstrap": 0, "llm": 1, "discovered": 2, "confirmed": 3, "corrected": 3}


def merge_labels(windows: DataFrame, events: DataFrame, keys: list[str], slot_min: int = 30) -> DataFrame:
    """JON-01: per half hour the most trusted event wins, the later arrival on ties; the leaf slug
    replaces the label; every window of that half hour takes it.

    windows: (keys, w, label); events: (keys, window_min, label, activity, provenance, gold, arrival).
    """
    trust = F.create_map(*[F.lit(x) for kv in TRUST.items() for x in kv])[F.col("provenance")]
    slot = F.col("window_min") - F.pmod("window_min", F.lit(slot_min))
    row = F.struct(F.coalesce("activity", "label").alias("label"), "provenance", "gold")
    best = events.groupBy(*keys, slot.alias("_slot")).agg(F.max_by(row, F.struct(trust, F.col("arrival"))).alias("_e"))
    j = windows.withColumn("_slot", F.col("w") - F.pmod("w", F.lit(slot_min))).join(best, [*keys, "_slot"], "left")
    return j.select(
        *keys, "w", F.coalesce("_e.label", "label").alias("label"), F.coalesce("_e.provenance", F.lit("bootstrap")).alias("provenance"),
        F.coalesce("_e.gold", F.lit(False)).alias("gold"),
    )


def without(rows: DataFrame, others: DataFrame, on: list[str]) -> DataFrame:
    """JON-02/03: rows without a partner."""
    return rows.join(others.select(*on).distinct(), on, "left_anti")


def around(windows: DataFrame, preds: DataFrame, keys: list[str], width: int = 30) -> DataFrame:
    """JON-06: last label before a window and first label after its end; two as-of passes over a union.

    windows: (keys, w), preds: (keys, w, state).
    """
    null_s, null_l = F.lit(None).cast("string"), F.lit(None).cast("long")
    marks = preds.select(*keys, F.col("w").alias("t"), F.col("state"), null_l.alias("w"), F.lit(1).alias("kind"))
    day = F.floor(F.col("t") / 1440)
    ask = windows.select(*keys, F.col("w").alias("t"), null_s.alias("state"), F.col("w"), F.lit(0).alias("kind"))
    before = last_known(ask.unionByName(marks), keys, ["t", "kind"], "state", day, "before").where("kind = 0")
    # time reversed: the first label after the window's end is the last one before it
    late = windows.select(*keys, (-(F.col("w") + width)).alias("t"), null_s.alias("state"), F.col("w"), F.lit(0).alias("kind"))
    rev = marks.withColumn("t", -F.col("t"))
    after = last_known(late.unionByName(rev), keys, ["t", "kind"], "state", F.floor(F.col("t") / 1440), "after").where("kind = 0")
    return before.select(*keys, "w", "before").join(after.select(*keys, "w", "after"), [*keys, "w"])


def nearest(asks: DataFrame, rows: DataFrame, keys: list[str], reach: int = 40) -> DataFrame:
    """JON-07: the row closest to each asked time within ±reach minutes, the earlier one on ties.

    asks: (keys, ask), rows: (keys, w, …); binned so that it stays an equality join.
    """
    size = 2 * reach
    bins = F.explode(F.sequence(F.floor((F.col("ask") - reach) / size), F.floor((F.col("ask") + reach) / size))).alias("_bin")
    right = rows.withColumn("_bin", F.floor(F.col("w") / size))
    hit = asks.select(*keys, "ask", bins).join(right, [*keys, "_bin"]).where(F.abs(F.col("w") - F.col("ask")) <= reach)
    rest = [c for c in rows.columns if c not in keys]
    return hit.groupBy(*keys, "ask").agg(F.min_by(F.struct(*rest), F.struct(F.abs(F.col("w") - F.col("ask")), F.col("w"))).alias("_r")).select(*keys, "ask", "_r.*")


def fired_before(windows: DataFrame, fires: DataFrame, keys: list[str], lead: Column, slot_min: int = 30) -> DataFrame:
    """JON-10: did the marker fire in the window that starts `lead` minutes earlier? fires: (keys, fire)."""
    hits = fires.select(*keys, (F.col("fire") - F.pmod("fire", F.lit(slot_min))).alias("_at")).distinct().withColumn("fired", F.lit(True))
    return windows.withColumn("_at", F.col("w") - lead).join(hits, [*keys, "_at"], "left").withColumn("fired", F.coalesce("fired", F.lit(False))).drop("_at")


def confused_pairs(cells: DataFrame, keys: list[str], min_rate: float = 0.15) -> DataFrame:
    """JON-21: (a→b + b→a) / (n_a + n_b) per pair of classes."""
    support = cells.groupBy(*keys, F.col("y").alias("c")).agg(F.sum("n").alias("s"))
    off = cells.where(F.col("y") != F.col("predicted"))
    both = off.groupBy(*keys, F.least("y", "predicted").alias("a"), F.greatest("y", "predicted").alias("b")).agg(F.sum("n").alias("n"))
    named = lambda c, s: support.select(*keys, F.col("c").alias(c), F.col("s").alias(s))
    j = both.join(named("a", "sa"), [*keys, "a"]).join(named("b", "sb"), [*keys, "b"])
    rate = F.col("n") / (F.col("sa") + F.col("sb"))
    return j.where(rate >= min_rate).select(*keys, "a", "b", F.round(rate, 3).alias("rate"))


def flow_state(persons: DataFrame, windows: DataFrame, labels: DataFrame, preds: DataFrame, now: Column, stall_min: int = 60) -> DataFrame:
    """JON-23: per person counts of windows, labels and predictions, the live model and a stalled flag."""
    one = lambda df, *aggs: df.groupBy("person").agg(*aggs)
    w = one(windows, F.count(F.lit(1)).alias("windows"), F.max("w").alias("last_window"))
    lab = one(labels, F.count(F.lit(1)).alias("labels"), F.count_if(F.col("provenance") == "confirmed").alias("confirmed"))
    p = one(preds, F.count(F.lit(1)).alias("predictions"), F.max_by("model_version", "w").alias("model"))
    j = persons.join(w, "person", "left").join(lab, "person", "left").join(p, "person", "left")
    j = j.fillna(0, subset=["windows", "labels", "confirmed", "predictions"])
    return j.withColumn("stalled", F.coalesce(now - F.col("last_window") > stall_min, F.lit(True))).drop("last_window")


def contrast(cards: DataFrame, named: DataFrame) -> DataFrame:
    """JON-22: for each card the named card with most shared top features, two at least.

    Cards of one set of features have the same candidates, but for themselves: the two best named cards of a set do.
    """
    from .topk import carded, set_overlaps

    left, right = carded(cards, "card", "a"), carded(named, "card", "b")
    # of the named cards of a set only the two with the smallest keys can be among the two best
    first = right.groupBy("set_b").agg(F.min("b").alias("b"))
    second = right.join(first.withColumnRenamed("b", "_b"), "set_b").where("b > _b").groupBy("set_b").agg(F.min("b").alias("b"))
    hits = set_overlaps(left, right, 2).join(first.unionByName(second), "set_b")
    # a named card may have several sets: its best one counts
    order = F.struct((-F.col("shared")).alias("neg"), "b")
    ranked = hits.groupBy("set_a", "b").agg(F.max("shared").alias("shared"))
    best = ranked.groupBy("set_a").agg(F.min(order).alias("_one"))
    next_ = ranked.join(best, "set_a").where(F.col("b") != F.col("_one.b")).groupBy("set_a").agg(F.min(order).alias("_two"))
    found = left.join(best.join(next_, "set_a", "left"), "set_a").withColumn("_hit", F.when(F.col("_one.b") != F.col("a"), F.col("_one")).otherwise(F.col("_two")))
    whole = found.where(F.col("_hit").isNotNull()).groupBy(F.col("a").alias("card")).agg(F.min("_hit").alias("_hit"))
    return whole.select("card", (-F.col("_hit.neg")).alias("shared"), F.col("_hit.b").alias("like"))
