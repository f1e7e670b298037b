"""Exact ranks and order statistics without pulling a key into one task.

Equal values collapse first (partial aggregation), the distinct values of a key
are then split over range buckets cut by a mergeable quantile sketch, and the
counts of the buckets before (at most SPLITS rows per key) are added to a rank
inside each bucket. A key that holds a third of the rows is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

SPLITS = 64
STEP = 8


def _cuts_below(cuts: str, v):
    """Number of sorted cuts below v: first over every eighth cut, then inside that stretch."""
    blocks = F.size(F.filter(F.col(f"{cuts}.every"), lambda s: s < v)) * STEP
    near = F.slice(F.col(f"{cuts}.all"), blocks + 1, F.lit(STEP))
    return blocks + F.size(F.filter(near, lambda s: s < v))


def value_cdf(df: DataFrame, keys: list[str], value: str, extra=None, weight: str | None = None) -> DataFrame:
    """One row per (keys, value): n rows, n_before rows with a smaller value, n_total of the key.

    extra: further sums as {name: column}; each also gets a running `<name>_before`. weight: column with
    the number of rows that a row stands for.
    """
    extra = extra or {}
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        (F.sum(weight) if weight else F.count(F.lit(1))).alias("n"), *[F.sum(c).alias(k) for k, c in extra.items()]
    )
    probs = F.array(*[F.lit(i / SPLITS) for i in range(1, SPLITS)])
    sketch = counted.groupBy(*keys).agg(
        F.array_distinct(F.percentile_approx(value, probs, F.lit(1000))).alias("_all"),
        F.sum("n").alias("n_total"),
    )
    every = F.filter("_all", lambda c, i: i % STEP == STEP - 1)
    # written once: a sketch depends on the order in which its parts arrive, and rows and offsets need the same cuts
    cuts = materialise(sketch.select(*keys, F.struct(F.col("_all").alias("all"), every.alias("every")).alias("_cuts"), "n_total"), "rank-cuts")
    if keys:
        joined = counted.join(cuts, keys)
    else:
        joined = counted.withColumns(
            {"_cuts": cuts.select("_cuts").scalar(), "n_total": cuts.select("n_total").scalar()}
        )
    bucketed = joined.withColumn("_b", _cuts_below("_cuts", F.col(value))).drop("_cuts")
    sums = ["n", *extra]
    totals = bucketed.groupBy(*keys, "_b").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    # at most SPLITS rows per key
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_b", *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums]
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = bucketed.join(offsets, [*keys, "_b"])
    return out.select(
        *keys,
        value,
        *sums,
        "n_total",
        *[
            (F.col(f"_o_{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0))).alias(f"{s}_before")
            for s in sums
        ],
    )


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], weight: str | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles, one row per key."""
    cdf = value_cdf(df, keys, value, weight=weight)
    aggs = []
    for name, p in probs.items():
        pos = (F.col("n_total") - 1) * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)
        at = lambda k: F.max(F.when((F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n")), F.col(value)))
        aggs += [at(lo).alias(f"_lo_{name}"), at(hi).alias(f"_hi_{name}"), F.max(pos - lo).alias(f"_w_{name}")]
    got = cdf.groupBy(*keys).agg(*aggs)
    return got.select(
        *keys,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n)
            for n in probs
        ],
    )
