"""Path attribution of forests."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayweave.operators import attribution as A
from dayweave.operators import learning as N

COLS = ["bed", "tv", "noise", "flat"]


@pytest.fixture(scope="module")
def world(spark):
    df = spark.range(400).select(
        F.col("id").alias("row_id"), (F.pmod(F.xxhash64("id"), F.lit(10)) / 10).alias("bed"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10)) / 10).alias("tv"),
        (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(100)) / 100).alias("noise"), F.lit(1.0).alias("flat"),
    )
    return N.align(df.withColumn("y", F.when(F.col("bed") > 0.6, "sleeping").when(F.col("tv") > 0.5, "movie").otherwise("home")), COLS)


def walk(tree, x, label):
    """Changes along one path, read from the fitted tree itself."""
    node, out = tree._call_java("rootNode"), {}
    share = lambda n: list(n.impurityStats().stats())[label] / sum(n.impurityStats().stats())
    base = share(node)
    while node.getClass().getSimpleName() == "InternalNode":
        column, at = node.split().featureIndex(), share(node)
        node = node.leftChild() if x[column] <= node.split().threshold() else node.rightChild()
        out[column] = out.get(column, 0.0) + share(node) - at
    return base, out


def test_attributions_add_up_and_equal_a_walk_through_every_tree(world):
    model = N.fit_classifier(world, COLS, numTrees=7, maxDepth=4)
    got = A.path_attribution(model, world, "row_id").collect()
    assert len(got) == 400 and max(abs(r.base + sum(r.weights) - r.confidence) for r in got) < 1e-9
    rows = {r.row_id: r for r in world.collect()}
    trees = model.model.stages[-1].trees
    for r in got[:25]:
        want, base = np.zeros(4), 0.0
        for t in trees:
            b, parts = walk(t, [rows[r.row_id][c] for c in COLS], model.classes.index(r.predicted))
            base += b / len(trees)
            for c, v in parts.items():
                want[c] += v / len(trees)
        assert np.allclose(want, r.weights) and abs(base - r.base) < 1e-9
    assert all(r.weights[3] == 0 for r in got)


def test_the_column_behind_a_class_is_strongest(world):
    model = N.fit_classifier(world, COLS, numTrees=15, maxDepth=5)
    top = A.strongest(A.path_attribution(model, world, "row_id"), COLS, 2).where("predicted = 'sleeping'")
    assert {r.rank for r in top.collect()} == {1, 2}
    assert {r.feature for r in top.where("rank = 1").collect()} == {"bed"} and top.where("rank = 1 and weight <= 0").count() == 0


def test_a_forest_of_leaves_gives_nothing(world):
    model = N.fit_classifier(world.where("y = 'home'").unionByName(world.where("y = 'movie'").limit(1)), COLS, numTrees=2, maxDepth=1, minInstancesPerNode=300)
    r = A.path_attribution(model, world, "row_id").first()
    assert not any(r.weights) and abs(r.base - r.confidence) < 1e-9
