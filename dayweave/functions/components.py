"""Connected components by alternating star contraction; all rows stay in Spark.

A hub, a node with more than one in SHARE of all links, is not brought into one task: its smallest
neighbour comes from a partial aggregation and is broadcast to its links where they lie. A link has two
ends and a round adds at most one link a node, so fewer than 3 * SHARE nodes can be hubs at any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

SHARE = 10_000
LEAST_HUB = 256


def _hung(turned: DataFrame, least: DataFrame, most: int) -> DataFrame:
    """turned (a, b) with m, the smallest node that a sees; nodes of over `most` links keep their rows in place."""
    # fewer than 3 * SHARE rows
    hubs = F.broadcast(least.where(F.col("n") > most).select("a", "m"))
    light = turned.join(hubs.select("a"), "a", "left_anti").join(least.where(F.col("n") <= most).select("a", "m"), "a")
    return light.unionByName(turned.join(hubs, "a"))


def _stars(edges: DataFrame, both: bool, most: int) -> DataFrame:
    """Links neighbours to the smallest node they see: the larger ones (both) or all smaller ones."""
    turned = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else edges
    least = turned.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
    hung = _hung(turned, least, most)
    linked = hung.where("b > a" if both else "b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.where("a <> m").select("a", F.col("m").alias("b"))
    return linked.unionByName(own).where("a <> b").groupBy("a", "b").agg(F.lit(0).alias("_")).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of every node that has a link.

    edges: (a, b) with a > b. Every round shrinks the depth; it ends when a round changes nothing.
    """
    now = materialise(edges.where("a > b").select("a", "b").distinct(), "links")
    links, seal = now.count(), None
    while True:
        most = max(LEAST_HUB, links // SHARE)
        now = materialise(_stars(materialise(_stars(now, True, most), "large-star"), False, most), "small-star")
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seal:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        links, seal = mark[0], mark
