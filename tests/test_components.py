"""Connected components: results against plain merging, and hubs that no task holds whole."""

import random

import pytest
from pyspark.sql import functions as F

from dayweave.functions import components as C


def merged(edges):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {x: top(x) for x in root if top(x) != x}


def star(hub, first, n):
    return [(max(hub, first + i), min(hub, first + i)) for i in range(n)]


@pytest.mark.parametrize("hub", [0, 1500, 10_000])
def test_hubs_and_chains_against_merging(spark, hub):
    """A hub below, between and above its neighbours, with chains, pairs and a repeated link."""
    draw = random.Random(hub)
    edges = [e for e in star(hub, 1, 3000) if e[0] != e[1]] + [(20_000 + i + 1, 20_000 + i) for i in range(40)] + [(30_001, 30_000)] * 3
    edges += [(20_040, 3000), (50_001, 50_000)] + [tuple(sorted(draw.sample(range(60_000, 60_400), 2), reverse=True)) for _ in range(300)]
    got = dict(C.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == merged(edges)


def test_structs_and_empty_links(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (None, 3)], "x long, y long").select(F.struct("y", "x").alias("a"), F.struct(F.lit(0).cast("long").alias("y"), F.col("x")).alias("b"))
    got = {(tuple(r.node), tuple(r.root)) for r in C.components(edges).collect()}
    assert got == {((2, 1), (0, 1)), ((3, 2), (0, 2)), ((3, None), (0, None))}
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("both", [True, False])
def test_no_task_holds_a_hub(spark, both):
    """A third of all nodes hang on one; after the join with the smallest nodes no partition has much more than the median."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    for k, v in {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}.items():
        spark.conf.set(k, v)
    try:
        i = F.col("id")
        far = spark.range(0, 30_000, 1, 16).select((i + 100_000).alias("a"), F.when(i % 3 == 0, 5).otherwise(i + 10).alias("b"))
        turned = far.select(F.col("b").alias("a"), F.col("a").alias("b")) if both else far.select(F.when(F.col("b") == 5, 900_000).otherwise(F.col("a")).alias("a"), F.when(F.col("b") == 5, F.col("a")).otherwise(F.col("b")).alias("b"))
        least = turned.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
        hung = C._hung(turned, least, C.LEAST_HUB)
        sizes = sorted(r["count"] for r in hung.groupBy(F.spark_partition_id()).count().collect())
        assert sum(sizes) == 30_000 and sizes[-1] < 3 * sizes[len(sizes) // 2]
        # the aggregation is shuffled once; links of a hub are not shuffled for the join
        assert {r.a for r in hung.where("a = 5 OR a = 900000").select("a").distinct().collect()} == {5 if both else 900_000}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
