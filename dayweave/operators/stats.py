"""Intervals, drift, calibration, reliability, co-activation, lead/lag and marker statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cols import local_ts, part_of_day
from ..functions.ranks import quantiles, value_cdf
from ..session import materialise

PSI_BINS = 10


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """STA-01: interval of a proportion, clamped to [0, 1]; (0, 1) for no rows."""
    safe = F.when(n > 0, n)
    p = k / safe
    denom = 1 + z * z / safe
    center = (p + z * z / (2 * safe)) / denom
    half = z * F.sqrt(p * (1 - p) / safe + z * z / (4 * safe * safe)) / denom
    low = F.coalesce(F.greatest(F.lit(0.0), center - half), F.lit(0.0))
    high = F.coalesce(F.least(F.lit(1.0), center + half), F.lit(1.0))
    return low, high


def unpivot(df: DataFrame, ids: list[str], columns: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    return df.unpivot(ids, columns, name, value)


# --- drift (STA-02, STA-03) -----------------------------------------------------------------


def psi(long: DataFrame, keys: list[str], bins: int = PSI_BINS) -> DataFrame:
    """STA-02: population stability index of `actual` rows against quantile bins of `expected` rows.

    long: (keys, side in {expected, actual}, value). Values outside the expected range fall in no
    bin but stay in the denominator.
    """
    # equal values collapse once, of both sides; quantiles, totals and bins are read from what is left
    sides = {"_e": F.count_if(F.col("side") == "expected"), "_a": F.count_if(F.col("side") != "expected")}
    rows = materialise(long.where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(*[c.alias(n) for n, c in sides.items()]), "drift-values")
    names = {f"q{i}": i / bins for i in range(bins + 1)}
    q = quantiles(rows.where("_e > 0"), keys, "value", names, weight="_e")
    edges = q.select(*keys, F.array_sort(F.array_distinct(F.array(*names))).alias("edges")).where(F.size("edges") >= 3)
    # one row of at most 11 edges per key: the row side is never the small one
    cut = rows.join(edges, keys)
    last = F.element_at("edges", -1)
    idx = F.when(F.col("value") == last, F.size("edges") - 1).when(
        (F.col("value") < last) & (F.col("value") >= F.element_at("edges", 1)),
        F.size(F.filter("edges", lambda e: e <= F.col("value"))),
    )
    counts = cut.groupBy(*keys, idx.alias("bin"), F.size("edges").alias("m")).agg(F.sum("_e").alias("e"), F.sum("_a").alias("a"))
    tot = rows.groupBy(*keys).agg(F.sum("_e").alias("ne"), F.sum("_a").alias("na"))
    shape = edges.select(*keys, F.explode(F.sequence(F.lit(1), F.size("edges") - 1)).alias("bin"))
    full = shape.join(counts.where("bin is not null"), [*keys, "bin"], "left").join(tot, keys)
    pe = F.greatest(F.coalesce("e", F.lit(0)) / F.col("ne"), F.lit(1e-6))
    pa = F.greatest(F.coalesce("a", F.lit(0)) / F.col("na"), F.lit(1e-6))
    return full.where("na > 0").groupBy(*keys).agg(
        F.sum((pa - pe) * F.ln(pa / pe)).alias("psi"), F.max("ne").alias("n_expected"), F.max("na").alias("n_actual")
    )


def drift_report(long: DataFrame, keys: list[str], min_rows: int = 30) -> DataFrame:
    """STA-03: index per column with the investigate (> 0.2) and severe (> 0.5) flags."""
    p = psi(long, keys).where((F.col("n_expected") >= min_rows) & (F.col("n_actual") >= min_rows))
    v = F.round("psi", 4)
    return p.select(*keys, v.alias("psi"), (v > 0.2).alias("drifted"), (v > 0.5).alias("severe"), "n_expected", "n_actual")


# --- classifier evaluation (STA-04..12) ------------------------------------------------------


def with_prediction(rows: DataFrame, classes: list[str], prefix: str = "p_") -> DataFrame:
    """Adds predicted (first class on ties), conf and correct."""
    top = F.greatest(*[F.col(prefix + c) for c in classes])
    pred = F
    for c in classes:
        pred = pred.when(F.col(prefix + c) == top, F.lit(c))
    return rows.withColumns({"conf": top, "predicted": pred}).withColumn("correct", (F.col("predicted") == F.col("y")).cast("double"))


def calibration(rows: DataFrame, classes: list[str], keys: list[str], bins: int = 10) -> DataFrame:
    """STA-04: multiclass Brier score and expected calibration error over (lo, hi] bins."""
    sq = sum((F.pow(F.col(f"p_{c}") - (F.col("y") == c).cast("double"), 2) for c in classes), F.lit(0.0))
    b = F.least(F.ceil(F.col("conf") * bins), F.lit(bins))
    per = rows.groupBy(*keys, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("conf").alias("sc"), F.sum("correct").alias("sa"), F.sum(sq).alias("sq")
    )
    gap = F.when(F.col("bin") >= 1, F.abs(F.col("sa") - F.col("sc"))).otherwise(0.0)
    return per.groupBy(*keys).agg(
        F.round(F.sum("sq") / F.sum("n"), 4).alias("brier"), F.round(F.sum(gap) / F.sum("n"), 4).alias("ece"), F.sum("n").alias("n_check")
    )


def confusion(rows: DataFrame, keys: list[str]) -> DataFrame:
    """STA-06."""
    return rows.groupBy(*keys, "y", "predicted").agg(F.count(F.lit(1)).alias("n"))


def class_report(cells: DataFrame, keys: list[str]) -> DataFrame:
    """STA-05: precision, recall, F1 and support from the confusion cells."""
    hit = F.sum(F.when(F.col("y") == F.col("predicted"), F.col("n")).otherwise(0))
    truth = cells.groupBy(*keys, F.col("y").alias("class")).agg(F.sum("n").alias("support"), hit.alias("tp"))
    said = cells.groupBy(*keys, F.col("predicted").alias("class")).agg(F.sum("n").alias("said"))
    j = truth.join(said, [*keys, "class"], "left").fillna(0, subset=["said"])
    prec = F.when(F.col("said") > 0, F.col("tp") / F.col("said")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    return j.select(*keys, "class", F.round(prec, 4).alias("precision"), F.round(rec, 4).alias("recall"), F.round(f1, 4).alias("f1"), "support")


def auc_one_vs_rest(rows: DataFrame, classes: list[str], keys: list[str]) -> DataFrame:
    """STA-07: rank-sum AUC per class, ties at their average rank; exact and without a global sort."""
    long = rows.select(*keys, "y", F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"p_{c}").alias("score")) for c in classes])).alias("e"))
    long = long.select(*keys, "e.class", "e.score", (F.col("y") == F.col("e.class")).cast("long").alias("pos"))
    by = [*keys, "class"]
    cdf = value_cdf(long, by, "score", {"pos": F.col("pos")})
    avg_rank = F.col("n_before") + (F.col("n") + 1) / 2
    got = cdf.groupBy(*by).agg(F.sum(F.col("pos") * avg_rank).alias("rs"), F.sum("pos").alias("np"), F.sum("n").alias("nn"))
    neg = F.col("nn") - F.col("np")
    return got.where((F.col("np") > 0) & (neg > 0)).select(*by, ((F.col("rs") - F.col("np") * (F.col("np") + 1) / 2) / (F.col("np") * neg)).alias("auc"))


def accuracy_by_provenance(rows: DataFrame, keys: list[str]) -> DataFrame:
    """STA-08: confirmed, gold (confirmed and random) and bootstrap accuracy with Wilson bounds."""
    conf = F.col("provenance") == "confirmed"
    groups = F.array(
        F.when(conf, F.lit("confirmed")), F.when(conf & F.col("gold"), F.lit("gold")), F.when(~conf, F.lit("bootstrap"))
    )
    long = rows.select(*keys, "correct", F.explode(F.array_compact(groups)).alias("basis"))
    got = long.groupBy(*keys, "basis").agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("k"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return got.select(*keys, "basis", "n", F.round(F.col("k") / F.col("n"), 4).alias("accuracy"), F.round(lo, 4).alias("ci_low"), F.round(hi, 4).alias("ci_high"))


def coverage_curve(rows: DataFrame, keys: list[str]) -> DataFrame:
    """STA-09: share kept and accuracy of the kept at thresholds 0 … 0.9."""
    long = rows.select(*keys, "conf", "correct", F.explode(F.array(*[F.lit(round(i / 10, 1)) for i in range(10)])).alias("t"))
    kept = F.col("conf") >= F.col("t")
    return long.groupBy(*keys, "t").agg(
        F.round(F.count_if(kept) / F.count(F.lit(1)), 4).alias("coverage"), F.round(F.avg(F.when(kept, F.col("correct"))), 4).alias("precision")
    )


def slice_accuracy(rows: DataFrame, keys: list[str], tz: str = "UTC") -> DataFrame:
    """STA-10: accuracy per activity and part of day."""
    part = part_of_day(F.hour(local_ts(F.col("minute"), tz))).cast("long")
    return rows.groupBy(*keys, F.col("y").alias("activity"), part.alias("daypart")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("correct"), 4).alias("accuracy")
    )


def class_moments(long: DataFrame, keys: list[str], label: str) -> DataFrame:
    return long.groupBy(*keys, label).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"))


def cohens_d(a: dict[str, Column], b: dict[str, Column], cap: float = 10.0) -> Column:
    """STA-11: pooled-variance distance of two groups given n, mean and var."""
    dof = F.greatest(a["n"] + b["n"] - 2, F.lit(1))
    pooled = F.sqrt(((a["n"] - 1) * a["var"] + (b["n"] - 1) * b["var"]) / dof)
    gap = F.abs(a["mean"] - b["mean"])
    d = F.when(pooled == 0, F.when(gap == 0, 0.0).otherwise(cap)).otherwise(F.least(gap / F.when(pooled != 0, pooled), F.lit(cap)))
    return F.when((a["n"] < 2) | (b["n"] < 2), 0.0).otherwise(d)


def discriminative_stats(long: DataFrame, pairs: DataFrame, label: str = "y", top: int = 5) -> DataFrame:
    """STA-12: the features that best separate each confused pair. long: (feature, label, value)."""
    m = class_moments(long, ["feature"], label)
    a = m.select("feature", F.col(label).alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("n", "mean", "var")])
    b = m.select("feature", F.col(label).alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("n", "mean", "var")])
    col = lambda s: {c: F.col(f"{s}_{c}") for c in ("n", "mean", "var")}
    j = pairs.select("a", "b").join(a, "a").join(b, ["feature", "b"])
    scored = j.select("a", "b", "feature", F.round(cohens_d(col("a"), col("b")), 3).alias("d"))
    w = Window.partitionBy("a", "b").orderBy(F.col("d").desc(), "feature")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


# --- reliability of foundational facts (STA-13..18) ------------------------------------------


@dataclass(frozen=True)
class FactProfile:
    max_flips: float
    min_block: float
    min_days: float
    night_block: bool = False
    min_night: float = 0.0


SLEEP = FactProfile(8, 180, 5.0, True, 0.6)
PRESENCE = FactProfile(24, 5, 3.0)
FACT_AT, FEATURE_AT = 0.80, 0.45


def plausibility(fact: DataFrame, keys: list[str], profile: FactProfile, tz: str = "UTC") -> DataFrame:
    """STA-13: does a 0/1 series behave like what it claims? fact: (keys, w, fact or NULL)."""
    w = Window.partitionBy(*keys).orderBy("w")
    total = fact.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col("fact").isNull().cast("double")).alias("missing_frac"))
    known = fact.where(F.col("fact").isNotNull()).withColumn("on", F.col("fact") > 0)
    step = known.withColumns({"_gap": F.col("w") - F.lag("w").over(w), "_flip": F.col("on") != F.lag("on").over(w)})
    run = step.withColumn("_run", F.sum(F.coalesce(F.col("_flip"), F.lit(False)).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    hour = F.hour(local_ts(F.col("w"), tz))
    night = (hour >= 22) | (hour < 8)
    base = run.groupBy(*keys).agg(
        F.greatest(F.coalesce(F.median("_gap"), F.lit(1.0)), F.lit(1.0)).alias("freq"),
        (F.max("w") - F.min("w")).alias("span"),
        F.count_if("_flip").alias("flips"),
        F.count_if("on").alias("asserted"),
        F.count_if(F.col("on") & night).alias("at_night"),
        F.count(F.lit(1)).alias("known"),
    )
    blocks = run.where("on").groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("len")).groupBy(*keys).agg(F.median("len").alias("block"))
    j = total.join(base, keys, "left").join(blocks, keys, "left")
    days = F.greatest(F.col("span") / 1440, F.col("freq") / 1440)
    fpd = F.coalesce(F.col("flips") / days, F.lit(0.0))
    block = F.coalesce(F.col("block") * F.col("freq"), F.lit(0.0))
    nf = F.coalesce(F.col("at_night") / F.when(F.col("asserted") > 0, F.col("asserted")), F.lit(0.0))
    stuck = F.col("known").isNull() | (F.col("asserted") == 0) | (F.col("asserted") == F.col("known"))
    calm = F.when(fpd <= profile.max_flips, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (fpd - profile.max_flips) / (profile.max_flips * 3)))
    parts = [1 - F.col("missing_frac"), F.when(stuck, 0.0).otherwise(1.0), calm]
    if profile.night_block:
        parts += [F.least(F.lit(1.0), block / profile.min_block), F.least(F.lit(1.0), nf / profile.min_night)]
    score = F.when(stuck, 0.0).otherwise(sum(parts[1:], parts[0]) / len(parts))
    return j.select(
        *keys, F.round(score, 3).alias("plausibility"), F.round("missing_frac", 3).alias("missing_frac"), stuck.alias("stuck"),
        F.round(fpd, 1).alias("flips_per_day"), F.round(block, 1).alias("median_block_min"), F.round(nf, 3).alias("night_frac"),
        F.when(F.col("known") > 1, F.col("span") / 1440).otherwise(0.0).alias("observation_days"),
    )


def corroboration(rows: DataFrame, keys: list[str]) -> DataFrame:
    """STA-14: rows: (keys, fact, contradiction)."""
    on = F.coalesce(F.col("fact") > 0, F.lit(False))
    against = on & F.coalesce(F.col("contradiction"), F.lit(False))
    got = rows.groupBy(*keys).agg(F.count_if(on).alias("n_asserted"), F.count_if(against).alias("_c"))
    rate = F.when(F.col("n_asserted") > 0, F.col("_c") / F.col("n_asserted")).otherwise(0.0)
    return got.select(*keys, F.round(1 - rate, 3).alias("corroboration"), F.round(rate, 3).alias("contradiction_rate"), "n_asserted")


def label_agreement(rows: DataFrame, keys: list[str]) -> DataFrame:
    """STA-15: rows: (keys, fact, truth); windows with a known truth only."""
    f, t = F.coalesce(F.col("fact") > 0, F.lit(False)), F.col("truth") > 0
    got = rows.where(F.col("truth").isNotNull()).groupBy(*keys).agg(
        F.count_if(f & t).alias("tp"), F.count_if(f & ~t).alias("fp"), F.count_if(~f & t).alias("fn"), F.count(F.lit(1)).alias("n")
    )
    div = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)
    p, r = div(F.col("tp"), F.col("tp") + F.col("fp")), div(F.col("tp"), F.col("tp") + F.col("fn"))
    return got.select(*keys, F.round(div(2 * p * r, p + r), 3).alias("agreement"), F.round(p, 3).alias("precision"), F.round(r, 3).alias("recall"), "n")


def verdict(parts: DataFrame, profile: FactProfile) -> DataFrame:
    """STA-16: parts carry plausibility, observation_days and, where known, corroboration, agreement."""
    pl, co, ag = F.col("plausibility"), F.col("corroboration"), F.col("agreement")
    score = F.round(
        F.when(ag.isNotNull(), 0.5 * ag + 0.3 * F.coalesce(co, pl) + 0.2 * pl).when(co.isNotNull(), 0.6 * pl + 0.4 * co).otherwise(pl), 3
    )
    eligible = F.col("observation_days") >= profile.min_days
    decision = F.when(~eligible, "feature").when(score >= FACT_AT, "fact").when(score >= FEATURE_AT, "feature").otherwise("suspect")
    return parts.withColumns({"score": score, "eligible": eligible, "decision": decision})


def awake_evidence(columns: list[str], hour: Column | None = None, awake_steps: float = 60.0) -> Column:
    """STA-17: signs of being awake against "asleep", from the feature columns at hand."""
    steps = [c for c in columns if "step" in c.lower() and c.endswith("_delta")]
    hard = [F.coalesce(F.col(c) > 0.3, F.lit(False)) for c in columns if c.endswith(("_on_frac", "_on_last"))]
    hard += [F.coalesce(F.col(c) > 0.5, F.lit(False)) for c in columns if c.endswith(("_active", "_playing"))]
    hard += [F.coalesce(F.col(c), F.lit(0.0)) > awake_steps for c in steps]
    charge = [F.coalesce(F.col(c), F.lit(0.0)) > 0.5 for c in columns if "charg" in c.lower()]
    charge += [F.coalesce(F.col(c), F.lit(0.0)) > 0 for c in columns if "batt" in c.lower() and c.endswith("_delta")]
    any_of = lambda xs: _fold(xs, False)
    still = _fold([F.coalesce(F.col(c), F.lit(0.0)) <= awake_steps for c in steps], True)
    day = (F.col("time_bucket") != 0) if "time_bucket" in columns else ((hour >= 8) & (hour < 22))
    return any_of(hard) | (day & ~(any_of(charge) & still))


def _fold(conds: list[Column], conjunction: bool) -> Column:
    out = F.lit(conjunction)
    for c in conds:
        out = (out & c) if conjunction else (out | c)
    return out


def verdict_changes(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """STA-18: new verdicts beside the previous decision, with the event a change raises."""
    j = new.join(old.select(*keys, F.col("decision").alias("previous")), keys, "left")
    event = F.when((F.col("previous") == "fact") & (F.col("decision") != "fact"), "demoted").when(
        F.col("previous").isin("feature", "suspect") & (F.col("decision") == "fact"), "promoted"
    )
    return j.withColumn("event", event)


# --- co-activation and lead/lag (STA-21..23) ---------------------------------------------------


def value_changes(minutes: DataFrame, keys: list[str]) -> DataFrame:
    """Minutes at which a numeric series differs from its last known value."""
    rows = minutes.where(F.col("num").isNotNull())
    prev = F.lag("num").over(Window.partitionBy(*keys).orderBy("minute"))
    return rows.withColumn("_p", prev).where(F.abs(F.col("num") - F.col("_p")) > 1e-9).drop("_p")


def co_activation(changes: DataFrame, frame: DataFrame, home: str = "home", sensor: str = "sensor", bin_min: int = 5) -> DataFrame:
    """STA-21: correlation of change counts per bin for every sensor pair of a home.

    The cross products are summed per (home, day) as one small matrix product, then added up, so
    no pair rows are ever made per bin. frame: (home, first minute, last minute) sets the number of bins.
    """
    b = F.floor(F.col("minute") / bin_min)
    act = changes.groupBy(home, sensor, b.alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("x"))
    day = F.floor(F.col("bin") * bin_min / 1440)

    def products(pdf):
        import numpy as np
        import pandas as pd

        names, col = np.unique(pdf["sensor"], return_inverse=True)
        slots, row = np.unique(pdf["bin"], return_inverse=True)
        x = np.zeros((len(slots), len(names)))
        x[row, col] = pdf["x"]
        gram = x.T @ x
        i, j = np.nonzero(np.triu(gram, 1))
        return pd.DataFrame({"home": pdf["home"].iloc[0], "a": names[i], "b": names[j], "sxy": gram[i, j]})

    per_day = act.select(F.col(home).alias("home"), F.col(sensor).alias("sensor"), "bin", "x", day.alias("day"))
    cross = per_day.groupBy("home", "day").applyInPandas(products, "home string, a string, b string, sxy double")
    sxy = cross.groupBy("home", "a", "b").agg(F.sum("sxy").alias("sxy"))
    one = act.groupBy(F.col(home).alias("home"), F.col(sensor).alias("s")).agg(F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"))
    bins = frame.select(F.col(home).alias("home"), (F.floor(F.col("last") / bin_min) - F.floor(F.col("first") / bin_min) + 1).alias("n"))
    names = one.groupBy("home").agg(F.array_sort(F.collect_set("s")).alias("ss"))
    # the answer itself is one row per pair of a home's sensors
    pairs = names.select("home", "ss", F.explode("ss").alias("a")).select("home", "a", F.explode(F.filter("ss", lambda s: s > F.col("a"))).alias("b"))
    ab = pairs.join(one.select("home", F.col("s").alias("a"), F.col("sx").alias("ax"), F.col("sxx").alias("axx")), ["home", "a"]).join(
        one.select("home", F.col("s").alias("b"), F.col("sx").alias("bx"), F.col("sxx").alias("bxx")), ["home", "b"])
    j = ab.join(sxy, ["home", "a", "b"], "left").join(bins, "home")
    n = F.col("n")
    den = F.sqrt((n * F.col("axx") - F.col("ax") ** 2) * (n * F.col("bxx") - F.col("bx") ** 2))
    r = F.when(den > 0, (n * F.coalesce("sxy", F.lit(0.0)) - F.col("ax") * F.col("bx")) / F.when(den > 0, den)).otherwise(0.0)
    return j.select("home", "a", "b", r.alias("r"))


def sensor_groups(corr: DataFrame, threshold: float = 0.7, min_sensors: int = 4) -> DataFrame:
    """STA-22: average linkage on distance 1 − r, cut at the threshold; group numbers per home.

    A round merges all pairs of groups that are each other's nearest, as average linkage never
    brings a merged group nearer to a third one than the nearer of its halves was; the merges are those
    of taking the nearest pair one by one. Between two groups the sum of r over their pairs is kept, and the
    mean follows from the sizes; a pair absent from corr counts with r = 0. Ties go to the
    smaller names. No group or home is brought into one task. Groups are numbered by their smallest sensor.
    """
    from ..session import materialise

    every = corr.select("home", F.explode(F.array("a", "b")).alias("sensor")).distinct()
    large = every.groupBy("home").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_sensors).select("home")
    member = materialise(every.join(large, "home", "left_semi").withColumn("lead", F.col("sensor")), "sensors")
    sums = corr.join(large, "home", "left_semi").where("r <> 0 and a <> b").groupBy("home", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.sum("r").alias("s"))
    links = materialise(sums, "linkage")
    while True:
        size = member.groupBy("home", "lead").agg(F.count(F.lit(1)).alias("n"))
        near = links.join(size.withColumnsRenamed({"lead": "lo", "n": "n_lo"}), ["home", "lo"]).join(size.withColumnsRenamed({"lead": "hi", "n": "n_hi"}), ["home", "hi"])
        near = near.withColumn("d", 1 - F.col("s") / (F.col("n_lo") * F.col("n_hi"))).where(F.col("d") < threshold)
        best = near.select("home", F.explode(F.array("lo", "hi")).alias("lead"), F.struct("d", "lo", "hi").alias("p")).groupBy("home", "lead").agg(F.min("p").alias("p"))
        pairs = materialise(best.groupBy("home", "p.lo", "p.hi").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("home", F.col("hi").alias("old"), F.col("lo").alias("new")), "merges")
        if not pairs.head(1):
            break
        moved = lambda df, c: df.join(pairs.withColumnRenamed("old", c), ["home", c], "left").withColumn(c, F.coalesce("new", c)).drop("new")
        member = materialise(moved(member, "lead"), "sensors")
        both = moved(moved(links, "lo"), "hi").where("lo <> hi")
        links = materialise(both.groupBy("home", F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).agg(F.sum("s").alias("s")), "linkage")
    # one row per group
    number = member.select("home", "lead").distinct().withColumn("group_id", (F.row_number().over(Window.partitionBy("home").orderBy("lead")) - 1).cast("long"))
    return member.join(number, ["home", "lead"]).select("home", "sensor", "group_id")


def _lagged_products(act: DataFrame, max_lag: int) -> DataFrame:
    """Σ x_a(t)·x_b(t+k) for k = 1 … max_lag: one small matrix product per home, day and lag.

    A day also gets the first max_lag minutes of the next one, to be looked at but not led from.
    """
    day = F.floor(F.col("t") / 1440)
    days = F.when(F.col("t") % 1440 < max_lag, F.array(day, day - 1)).otherwise(F.array(day))

    def products(pdf):
        import numpy as np
        import pandas as pd

        names, col = np.unique(pdf["s"], return_inverse=True)
        x = np.zeros((1440 + max_lag, len(names)))
        x[(pdf["t"] - pdf["day"] * 1440).to_numpy(), col] = pdf["x"]
        out = []
        for k in range(1, max_lag + 1):
            m = x[:1440].T @ x[k : 1440 + k]
            np.fill_diagonal(m, 0.0)
            i, j = np.nonzero(m)
            out.append(pd.DataFrame({"home": pdf["home"].iloc[0], "a": names[i], "b": names[j], "k": k, "sxy": m[i, j]}))
        return pd.concat(out)

    parts = act.select("home", "s", "t", "x", F.explode(days).alias("day"))
    got = parts.groupBy("home", "day").applyInPandas(products, "home string, a string, b string, k long, sxy double")
    return got.groupBy("home", "a", "b", "k").agg(F.sum("sxy").alias("sxy"))


def lead_lag(changes: DataFrame, frame: DataFrame, home: str = "home", sensor: str = "sensor", max_lag: int = 15,
             min_strength: float = 0.2, top: int | None = None, max_sensors: int | None = None) -> DataFrame:
    """STA-23 / JON-11 / TOP-08: directed sensor edges by best positive lagged correlation.

    Activity is a three-minute rolling change count, kept sparse; the lagged products are small
    matrix products per home and day. frame: (home, first, last) minutes. max_sensors: only the
    busiest sensors of a home; top: only its strongest edges.
    """
    fr = frame.select(F.col(home).alias("home"), "first", (F.col("last") - F.col("first") + 1).alias("n"))
    ch = changes.select(F.col(home).alias("home"), F.col(sensor).alias("s"), "minute").join(fr, "home")
    t0 = F.col("minute") - F.col("first")
    roll = ch.select("home", "s", "n", F.explode(F.sequence(t0, F.least(t0 + 2, F.col("n") - 1))).alias("t"))
    act = roll.groupBy("home", "s", "n", "t").agg(F.count(F.lit(1)).cast("double").alias("x"))
    if max_sensors is not None:
        busy = act.groupBy("home", "s").agg(F.sum("x").alias("sx"))
        rank = F.row_number().over(Window.partitionBy("home").orderBy(F.col("sx").desc(), "s"))
        act = act.join(busy.withColumn("_r", rank).where(F.col("_r") <= max_sensors).select("home", "s"), ["home", "s"])
    # read by the totals, the edges and the products
    act = materialise(act, "lagged-activity")
    ks = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(max_lag).cast("long"))).alias("k")
    # sums without the first or last k minutes: totals minus the few rows at the frame's edges
    totals = act.groupBy("home", "s", "n").agg(F.sum("x").alias("x1"), F.sum(F.col("x") ** 2).alias("x2"))
    edge = act.where((F.col("t") >= F.col("n") - max_lag) | (F.col("t") < max_lag)).select("home", "s", "n", "t", "x", ks)
    off = [F.sum(F.when(c, F.col("x") ** p).otherwise(0.0)).alias(f"{nm}{p}") for nm, c in (("end", F.col("t") >= F.col("n") - F.col("k")), ("begin", F.col("t") < F.col("k"))) for p in (1, 2)]
    cut = edge.groupBy("home", "s", "k").agg(*off)
    sums = totals.select("*", ks).join(cut, ["home", "s", "k"], "left").fillna(0.0, subset=["end1", "end2", "begin1", "begin2"])
    sums = sums.select("home", "s", "k", "n", *[(F.col(f"x{p}") - F.col(f"end{p}")).alias(f"lead{p}") for p in (1, 2)], *[(F.col(f"x{p}") - F.col(f"begin{p}")).alias(f"lag{p}") for p in (1, 2)])
    cross = _lagged_products(act, max_lag)
    sa = sums.select("home", F.col("s").alias("a"), "k", "n", F.col("lead1").alias("a1"), F.col("lead2").alias("a2"))
    sb = sums.select("home", F.col("s").alias("b"), "k", F.col("lag1").alias("b1"), F.col("lag2").alias("b2"))
    # pairs that never meet at a lag have no positive correlation there
    j = cross.join(sa, ["home", "a", "k"]).join(sb, ["home", "b", "k"])
    m = F.col("n") - F.col("k")
    den = F.sqrt((m * F.col("a2") - F.col("a1") ** 2) * (m * F.col("b2") - F.col("b1") ** 2))
    r = F.when((m >= 8) & (den > 1e-9), (m * F.col("sxy") - F.col("a1") * F.col("b1")) / F.when(den > 1e-9, den)).otherwise(0.0)
    scored = j.withColumn("r", F.round(r, 9))
    low, high = F.least("a", "b"), F.greatest("a", "b")
    best = scored.where("r > 0").groupBy("home", low.alias("x"), high.alias("y")).agg(
        F.max_by(F.struct("a", "b", "k", "r"), F.struct(F.col("r"), -F.col("k"), F.col("a") == low)).alias("e")
    )
    edges = best.where(F.col("e.r") >= min_strength).select(
        "home", F.col("e.a").alias("from_sensor"), F.col("e.b").alias("to_sensor"), F.col("e.k").alias("lag_min"), F.round("e.r", 3).alias("strength"))
    w = Window.partitionBy("home").orderBy(F.col("strength").desc(), "from_sensor", "to_sensor")
    ranked = edges.withColumn("rank", F.row_number().over(w))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


# --- markers (STA-24..27, JON-08) --------------------------------------------------------------


def suggest_markers(edges: DataFrame, bindings: DataFrame, activities: DataFrame, existing: DataFrame, min_strength: float = 0.35) -> DataFrame:
    """STA-24: strong edges into a bed or person sensor whose state exists and is not marked yet."""
    state = F.when(F.col("role") == "bed", "asleep").when(F.col("role") == "person", "away")
    target = bindings.select(F.col("name").alias("to_sensor"), state.alias("to_state")).where(F.col("to_state").isNotNull())
    got = edges.where(F.col("strength") >= min_strength).join(target, "to_sensor")
    got = got.join(bindings.select(F.col("name").alias("from_sensor")), "from_sensor", "left_semi")
    got = got.join(activities.select(F.col("slug").alias("to_state")), "to_state", "left_semi")
    return got.join(existing.select("from_sensor", "to_state"), ["from_sensor", "to_state"], "left_anti")


def match_fires(fires: DataFrame, moves: DataFrame, keys: list[str], tol: int = 15, reach: int = 90) -> DataFrame:
    """JON-08: each fire with its nearest transition in [−tol, +reach] minutes; a binned range join.

    fires: (keys, fire), moves: (keys, move), both distinct minutes.
    """
    size = tol + reach
    bins = F.explode(F.sequence(F.floor((F.col("fire") - tol) / size), F.floor((F.col("fire") + reach) / size))).alias("_bin")
    left = fires.select(*keys, "fire", bins)
    right = moves.select(*keys, "move", F.floor(F.col("move") / size).alias("_bin"))
    hit = left.join(right, [*keys, "_bin"]).where(F.col("move").between(F.col("fire") - tol, F.col("fire") + reach))
    best = hit.groupBy(*keys, "fire").agg(F.min_by("move", F.struct(F.abs(F.col("move") - F.col("fire")), F.col("move"))).alias("move"))
    return best


def matched_moves(fires: DataFrame, moves: DataFrame, keys: list[str], tol: int = 15, reach: int = 90) -> DataFrame:
    size = tol + reach
    bins = F.explode(F.sequence(F.floor((F.col("fire") - tol) / size), F.floor((F.col("fire") + reach) / size))).alias("_bin")
    right = moves.select(*keys, "move", F.floor(F.col("move") / size).alias("_bin"))
    hit = fires.select(*keys, "fire", bins).join(right, [*keys, "_bin"]).where(F.col("move").between(F.col("fire") - tol, F.col("fire") + reach))
    return hit.select(*keys, "move").distinct()


def marker_timing(fires: DataFrame, moves: DataFrame, keys: list[str], window_min: int = 30) -> DataFrame:
    """STA-25: learned lead, spread, precision, recall and strength of a marker."""
    best = match_fires(fires, moves, keys)
    lag = best.select(*keys, (F.col("move") - F.col("fire")).alias("lag"))
    # lags are whole minutes between −15 and 90, so the exact median is cheap
    got = lag.groupBy(*keys).agg(F.median("lag").alias("med"), F.stddev_pop("lag").alias("sd"), F.count(F.lit(1)).alias("hits"))
    nf = fires.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_fires"))
    nm = moves.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_transitions"))
    mm = matched_moves(fires, moves, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("m"))
    j = nf.join(nm, keys).join(got, keys, "left").join(mm, keys, "left")
    spread = F.round(F.when(F.col("hits") > 1, F.col("sd")).otherwise(0.0), 1)
    precision = F.round(F.coalesce("hits", F.lit(0)) / F.col("n_fires"), 3)
    factor = F.when(spread <= window_min, 1.0).otherwise(F.greatest(F.lit(0.3), 1 - (spread - window_min) / (3 * window_min)))
    return j.select(
        *keys, "n_fires", "n_transitions",
        (F.coalesce(F.round(F.col("med") / window_min), F.lit(0.0)) * window_min).cast("long").alias("lead_min"),
        spread.alias("spread_min"), precision.alias("precision"),
        F.round(F.coalesce("m", F.lit(0)) / F.col("n_transitions"), 3).alias("recall"),
        F.round(precision * factor, 3).alias("strength"),
    )


# Feature suffix → level above which a marker counts as fired.
FIRE_LEVELS = {"on_frac": 0.3, "on_last": 0.5, "opened_any": 0.5, "active": 0.5, "playing": 0.5, "max": 0.5, "delta": 0.0, "open_count": 0.0}


def marker_fired(columns: list[str], binding: str) -> Column:
    """STA-26: any of the binding's feature columns is above its level."""
    hits = [F.coalesce(F.col(f"{binding}_{s}") > v, F.lit(False)) for s, v in FIRE_LEVELS.items() if f"{binding}_{s}" in columns]
    return _fold(hits, False)


def marker_prior(probs: Column, prev: Column, from_state: Column, to_state: Column, strength: Column, boost: float = 6.0, damp: float = 0.3) -> Column:
    """STA-27: one fired marker's reweighting of a probability map, renormalised."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), strength))
    applies = (from_state.isNull() | (from_state == prev)) & F.map_contains_key(probs, to_state) & (s > 0)
    shifted = F.transform_values(
        probs,
        lambda c, p: F.when(c == to_state, p * (1 + (boost - 1) * s) + 1e-6)
        .when((c == prev) & (prev != to_state), p * (1 - (1 - damp) * s))
        .otherwise(p),
    )
    total = F.aggregate(F.map_values(shifted), F.lit(0.0), lambda a, v: a + v)
    return F.when(applies & (total > 0), F.transform_values(shifted, lambda c, p: p / total)).otherwise(probs)


def evidence_profile(weights: DataFrame, keys: list[str], tier: Column) -> DataFrame:
    """STA-19: share of absolute weight per tier, the direct share and its word."""
    names = F.create_map(*[F.lit(x) for kv in ((0, "prior"), (1, "direct"), (2, "behavioral"), (3, "ambient")) for x in kv])
    mass = weights.groupBy(*keys, names[tier].alias("tier")).agg(F.sum(F.abs("weight")).alias("m"))
    share = F.col("m") / F.sum("m").over(Window.partitionBy(*keys))
    return mass.where("m > 0").select(*keys, "tier", F.round(share, 4).alias("share"))


def evidence_word(direct: Column) -> Column:
    return F.when(direct >= 0.5, "strong").when(direct >= 0.25, "mixed").otherwise("weak")
