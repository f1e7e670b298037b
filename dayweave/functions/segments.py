"""Previous-row, as-of and run logic for series too long for one task.

A plain `lag` puts all rows of a key into one task. Here a key is cut into time
segments; `lag` runs inside a segment and only the first row of a segment looks at
the last row of the nearest earlier one, found among one summary row per segment.
Results equal the unsplit window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], values: list[str], segment, prefix: str = "prev_"
) -> DataFrame:
    """Adds prefix+value of the row before, by (keys, order).

    segment: column that never decreases along the order (e.g. day number of the time).
    """
    seg = df.withColumn("_seg", segment)
    inside = Window.partitionBy(*keys, "_seg").orderBy(*order)
    row = F.struct(*[F.col(v) for v in values])
    marked = seg.withColumns({"_prev": F.lag(row).over(inside), "_first": F.lag(F.lit(1)).over(inside).isNull()})
    tails = seg.groupBy(*keys, "_seg").agg(F.max_by(row, F.struct(*order)).alias("_tail"))
    # one row per (key, segment)
    carry = tails.select(
        *keys, "_seg", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_seg")).alias("_carry")
    )
    out = marked.join(carry, [*keys, "_seg"])
    picked = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev"))
    return out.withColumn("_p", picked).select(
        *df.columns, *[F.col("_p")[v].alias(f"{prefix}{v}") for v in values]
    )


def running_count(df: DataFrame, keys: list[str], order: list[str], flag, segment, name: str) -> DataFrame:
    """Inclusive running sum of a flag along the order, split by segment; island ids."""
    seg = df.withColumns({"_seg": segment, "_f": flag.cast("long")})
    inside = Window.partitionBy(*keys, "_seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    part = seg.withColumn("_c", F.sum("_f").over(inside))
    totals = seg.groupBy(*keys, "_seg").agg(F.sum("_f").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_seg", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))
    return part.join(offsets, [*keys, "_seg"]).select(*df.columns, (F.col("_o") + F.col("_c")).alias(name))


def last_known(
    df: DataFrame, keys: list[str], order: list[str], value: str, segment, name: str, inclusive: bool = True
) -> DataFrame:
    """As-of: last non-null value at or before each row (before only if not inclusive)."""
    seg = df.withColumn("_seg", segment)
    inside = Window.partitionBy(*keys, "_seg").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    part = seg.withColumn("_l", F.last(value, ignorenulls=True).over(inside))
    tails = seg.groupBy(*keys, "_seg").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_tail")
    )
    before = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select(*keys, "_seg", F.last("_tail", ignorenulls=True).over(before).alias("_carry"))
    return part.join(carry, [*keys, "_seg"]).select(*df.columns, F.coalesce("_l", "_carry").alias(name))
