"""Forests whose trees are grown and walked by tasks."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayweave.operators import forest as W
from dayweave.operators import learning as N
from dayweave.operators import stats as X
from dayweave.operators.attribution import path_attribution

COLS = ["bed", "tv", "noise", "flat"]


@pytest.fixture(scope="module")
def world(spark):
    part = lambda seed, n: (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)) / n)
    df = spark.range(600).select(F.col("id").alias("row_id"), (F.col("id") * 30).alias("minute"), part(0, 10).alias("bed"), part(1, 300).alias("tv"), part(2, 100).alias("noise"), F.lit(1.0).alias("flat"), part(3, 12).alias("luck"))
    y = F.when(F.col("bed") > 0.6, "sleeping").when(F.col("tv") > 0.5, "movie").otherwise("home")
    return N.align(df.withColumn("y", F.when(F.col("luck") == 0, "home").otherwise(y)).drop("luck"), COLS)


@pytest.fixture
def grown(world, monkeypatch):
    monkeypatch.setattr(N, "ONE_FIT_ROWS", 100)
    return N.fit_classifier(world, COLS, numTrees=60, maxDepth=6)


def gini_split(x, y, w, classes, least):
    """Best (gain, column, bin) by plain loops."""
    side = lambda m: sum(w[m & (y == c)].sum() ** 2 for c in range(classes)) / w[m].sum() if w[m].sum() else 0
    best, every = (0, None, None), np.ones(len(x), bool)
    for j in range(x.shape[1]):
        for b in range(int(x[:, j].max())):
            left = x[:, j] <= b
            if w[left].sum() >= least and w[~left].sum() >= least:
                gain = side(left) + side(~left) - side(every)
                if gain > best[0] + 1e-9:
                    best = (gain, j, b)
    return best


@pytest.mark.parametrize("pieces", [False, True])
def test_a_tree_splits_as_plain_loops_do(monkeypatch, pieces):
    if pieces:  # nodes and rows are taken a few at a time
        monkeypatch.setattr(W, "NODES", 2)
        monkeypatch.setattr(W, "PIECE", 50)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (300, 4)).astype(np.uint8)
    y = (x[:, 0] > 2).astype(np.int64) + (x[:, 1] > 3) * (rng.random(300) < 0.8)
    drawn = np.random.default_rng([7, 1]).poisson(1.0, 300).astype(float)
    tree = W.grow_tree(x, y, None, 3, 6, np.random.default_rng([7, 1]), 1.0, 4, 5, 4)
    todo, seen = [(0, np.ones(300, bool), 0)], 0
    while todo:
        at, here, level = todo.pop()
        assert np.allclose(tree.counts[at], [drawn[here & (y == c)].sum() for c in range(3)])
        gain, _, _ = gini_split(x[here], y[here], drawn[here], 3, 5)
        if tree.feature[at] < 0:
            continue
        seen += 1
        left = x[:, tree.feature[at]] <= tree.cut[at]
        side = lambda m: sum(drawn[m & (y == c)].sum() ** 2 for c in range(3)) / drawn[m].sum()
        assert side(here & left) + side(here & ~left) - side(here) == pytest.approx(gain) and level < 4
        one = tree.child[at]
        assert drawn[here & left].sum() >= 5 and drawn[here & ~left].sum() >= 5
        assert min(tree.feature[one], tree.feature[one + 1]) >= 0 or max(tree.feature[one], tree.feature[one + 1]) >= 0 or tree.counts[one].argmax() != tree.counts[one + 1].argmax()
        todo += [(one, here & left, level + 1), (one + 1, here & ~left, level + 1)]
    assert seen >= 3


def test_weights_move_a_tree_but_drawn_rows_bound_its_leaves():
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 8, (400, 2)).astype(np.uint8), rng.integers(0, 2, 400)
    drawn = np.random.default_rng([1, 1]).poisson(1.0, 400)
    weight = np.where(y == 1, 1e-3, 1.0)
    tree = W.grow_tree(x, y, weight, 2, 8, np.random.default_rng([1, 1]), 1.0, 5, 20, 2)
    assert tree.counts[0] == pytest.approx([drawn[y == 0].sum(), drawn[y == 1].sum() * 1e-3])
    leaf = tree.down(x, np.zeros(400, np.int64))
    assert min(drawn[leaf == k].sum() for k in np.unique(leaf)) >= 20
    assert np.allclose(W.Tree.read(*tree.bytes(), 2).counts, tree.counts)


def test_bins_keep_rare_values_apart_and_follow_quantiles(spark):
    df = N.align(spark.range(500).select(F.when(F.col("id") == 7, 0.0).when(F.col("id") == 9, 1.0).otherwise(2.0).alias("few"), F.col("id").cast("double").alias("many"), F.lit(3.0).alias("flat")), ["few", "many", "flat"])
    few, many, flat = W.edges_of(df, "features", 3)
    assert few == [0.5, 1.5] and flat == [] and len(many) == 31 and abs(many[15] - 249.5) < 2
    x = np.array([[0.0, 0.0, 3.0], [1.0, 600.0, 9.0], [2.0, many[3], 3.0], [np.nan, -1.0, 3.0]])
    assert W.binned(x, [few, many, flat]).tolist() == [[0, 0, 0], [1, 31, 0], [2, 3, 0], [2, 0, 0]]


def test_keys_are_dealt_one_to_each_partition(spark):
    keys = W.spread_keys(spark, 24)
    got = spark.createDataFrame([(k,) for k in keys], "key long").repartition(24, "key").select(F.spark_partition_id().alias("p")).distinct().count()
    assert len(set(keys)) == 24 and got == 24


def test_the_driver_keeps_no_node_of_many_rows(grown, world):
    """Spark's own model, which holds every node in the driver, is not among the stages; what is kept grows with the columns only."""
    (stage,) = grown.model.stages
    assert isinstance(stage, W.GrownForest) and len(stage.getOrDefault("edges")) < 5_000
    assert not [p for p in stage.params if "tree" in p.name.lower() and p.name != "numTrees"]
    assert stage.table().count() == 60


def test_scores_equal_a_walk_through_every_tree_in_any_blocks(grown, world, monkeypatch):
    scored = {r.row_id: r for r in grown.score(world).collect()}
    assert len(scored) == 600
    stage = grown.grown()
    trees = [t for _, t in stage.trees()]
    data = world.orderBy("row_id").collect()
    x = W.binned(np.array([r.features.toArray() for r in data]), json.loads(stage.getOrDefault("edges")))
    want = sum(t.share[t.down(x, np.zeros(600, np.int64))] for t in trees) / 60
    got = np.array([[scored[r.row_id][f"p_{c}"] for c in grown.classes] for r in data])
    assert np.allclose(got, want)
    hit = np.array(grown.classes)[got.argmax(1)] == np.array([r.y for r in data])
    assert hit.mean() > 0.85
    monkeypatch.setattr(W, "BLOCK_ROWS", 0)
    monkeypatch.setattr(W, "BLOCK_BYTES", 0)
    wide = world.unionByName(world.withColumn("row_id", F.col("row_id") + 600)).unionByName(world.withColumn("row_id", F.col("row_id") + 1200))
    again = {r.row_id: r for r in grown.score(wide).collect()}
    assert len(again) == 1800 and all(again[k + 1200][f"p_{c}"] == r[f"p_{c}"] for k, r in scored.items() for c in grown.classes)


def test_a_grown_forest_scores_as_well_as_that_of_spark(world, monkeypatch):
    train, val = world.where("row_id % 3 <> 0"), world.where("row_id % 3 = 0")
    hit = lambda m: X.with_prediction(m.score(val), m.classes).agg(F.avg("correct")).first()[0]
    usual = hit(N.fit_classifier(train, COLS, numTrees=60, maxDepth=6))
    monkeypatch.setattr(N, "ONE_FIT_ROWS", 100)
    assert abs(hit(N.fit_classifier(train, COLS, numTrees=60, maxDepth=6)) - usual) < 0.05


def spread_scores(model, rows, n):
    """(row_id, column) → votes of the classes with the column replaced, scored row by row as models of other kinds are."""
    got = model.score(rows).select("row_id", "_j", *[f"p_{c}" for c in model.classes]).collect()
    return {(r.row_id, r._j): [r[f"p_{c}"] for c in model.classes] for r in got}


def test_ablation_by_paths_equals_scoring_of_spread_rows(grown, world):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    mean = world.agg(*[F.avg(c) for c in COLS]).first()
    x = vector_to_array("features")
    spread = world.select("row_id", x.alias("x")).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(3))))
    cut = F.transform("x", lambda v, i: F.when(i == F.col("_j"), F.element_at(F.array(*map(F.lit, mean)), F.col("_j") + 1)).otherwise(v))
    after = spread_scores(grown, spread.withColumn("features", array_to_vector(cut)), 4)
    whole = {r.row_id: [r[f"p_{c}"] for c in grown.classes] for r in grown.score(world).collect()}
    got = N.ablation(grown, world, "row_id").collect()
    assert len(got) == 2400
    for r in got:
        k = int(np.argmax(whole[r.row_id]))
        assert r.weight == pytest.approx(whole[r.row_id][k] - after[r.row_id, COLS.index(r.feature)][k], abs=1e-9)


def test_ablation_of_repeated_and_missing_keys_is_that_of_spread_rows(grown, world, monkeypatch):
    odd = world.unionByName(world.where("row_id < 40")).withColumn("row_id", F.when(F.col("row_id") % 50 != 7, F.floor(F.col("row_id") / 2)))
    table = lambda: sorted((r.row_id, r.feature, round(r.weight, 9) + 0.0) for r in N.ablation(grown, odd, "row_id").collect())
    fast = table()
    monkeypatch.setattr(N.ClassModel, "grown", lambda self: None)
    slow = table()
    assert len(fast) == len(slow) > 600 * 4
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 2e-9 for a, b in zip(fast, slow))


def test_importance_by_paths_equals_scoring_of_spread_rows(grown, world, monkeypatch):
    fast = {r.feature: r.importance for r in N.permutation_importance(grown, world, "row_id").collect()}
    monkeypatch.setattr(N.ClassModel, "grown", lambda self: None)
    slow = {r.feature: r.importance for r in N.permutation_importance(grown, world, "row_id").collect()}
    assert fast.keys() == slow.keys() == set(COLS) and all(fast[c] == pytest.approx(slow[c], abs=1e-9) for c in COLS)
    assert fast["bed"] > 0.1 and fast["flat"] == 0


def test_paths_add_up_and_are_those_of_the_trees(grown, world):
    got = path_attribution(grown, world, "row_id").collect()
    assert len(got) == 600 and max(abs(r.base + sum(r.weights) - r.confidence) for r in got) < 1e-9
    assert all(r.weights[3] == 0 for r in got)
    edges = json.loads(grown.grown().getOrDefault("edges"))
    rows, trees = {r.row_id: r.features.toArray() for r in world.collect()}, [t for _, t in grown.grown().trees()]
    for r in got[:20]:
        want, label = np.zeros(4), grown.classes.index(r.predicted)
        for t in trees:
            at = 0
            while t.feature[at] >= 0:
                f = t.feature[at]
                to = t.child[at] + (0 if rows[r.row_id][f] <= edges[f][t.cut[at]] else 1)
                want[f] += (t.share[to, label] - t.share[at, label]) / 60
                at = to
        assert np.allclose(want, r.weights)


def test_the_search_grows_the_trees_of_all_draws(world, monkeypatch):
    folds = N.folds_of(world, 600 * 30, 2, 3)
    few = N.search(world, COLS, folds, n_draws=3, trees=30)
    monkeypatch.setattr(N, "ONE_FIT_ROWS", 100)
    fits = []
    monkeypatch.setattr(N, "RandomForestClassifier", lambda **p: fits.append(p))
    params, f1 = N.search(world, COLS, folds, n_draws=3, trees=30)
    assert not fits and params["numTrees"] == 30 and abs(f1 - few[1]) < 0.1


def test_empty_and_untyped_rows_are_scored(grown, world):
    got = grown.score(world.limit(0).withColumn("none", F.lit(None)))
    assert got.count() == 0 and "none" in got.columns
    odd = world.withColumns({"none": F.lit(None), "key": F.lit(1)})
    scored = grown.score(odd)
    assert scored.count() == 600 and scored.columns[: len(odd.columns)] == odd.columns and dict(scored.dtypes)["none"] == "void"


def test_a_fold_without_a_class_gives_it_nothing(spark, world):
    rows = world.where("y <> 'movie'").withColumn("label", F.when(F.col("y") == "home", 0.0).otherwise(1.0))
    (model,) = W.grow(rows, [{"numTrees": 30, "maxDepth": 3, "minInstancesPerNode": 5, "seed": 1}], 3)
    p = model.transform(rows).select("probability").first()[0]
    assert len(p) == 3 and p[2] == 0 and sum(p) == pytest.approx(1)


@pytest.fixture
def no_driver_fit(monkeypatch):
    """Every table counts as one of many rows, and a fit whose trees the driver would hold fails."""

    def fit(**params):
        raise AssertionError("the driver would hold the trees")

    monkeypatch.setattr(N, "ONE_FIT_ROWS", 100)
    monkeypatch.setattr(N, "RandomForestClassifier", fit)


FAST = {"numTrees": 30, "maxDepth": 5}


def test_nodes_of_many_rows_are_grown(spark, world, no_driver_fit):
    parents = spark.createDataFrame([("sleeping", None), ("movie", "home"), ("home", "home")], "y string, parent string")
    models = N.train_nodes(world, COLS, parents, **FAST)
    assert {k: m.classes for k, m in models.items()} == {"root": ["home", "sleeping"], "home": ["home", "movie"]}
    root = models["root"].score(world).select("row_id", "p_home", "p_sleeping")
    child = models["home"].score(world).select("row_id", F.lit("home").alias("node"), F.col("p_home").alias("q_home"), F.col("p_movie").alias("q_movie"))
    got = N.top_down(root, child, ["row_id"], ["home", "sleeping"], ["home", "movie"]).join(world, "row_id")
    assert got.count() == 600 and got.where("predicted = y").count() > 500


def test_folds_of_many_rows_are_grown_and_pooled(world, no_driver_fit):
    folds = N.folds_of(world, 600 * 30, 2, 3)
    scored, last = N.pooled_scores(world, COLS, folds, N.classes_of(world), **FAST)
    r = scored.agg(F.count("*"), F.avg("correct"), F.count_distinct("row_id")).first()
    assert (r[0], r[2]) == (288, 288) and r[1] > 0.75 and last.grown() is not None


def test_the_flat_baseline_of_many_rows_keeps_every_pooled_row(world, no_driver_fit):
    rows = world.withColumns({"provenance": F.when(F.col("row_id") % 3 == 0, "confirmed").otherwise("bootstrap"), "gold": F.col("row_id") % 2 == 0})
    scored, _ = N.pooled_scores(rows, COLS, N.folds_of(rows, 600 * 30, 2, 3), N.classes_of(rows), **FAST)
    got = X.accuracy_by_provenance(scored, []).collect()
    assert got and {r.provenance: r[1] for r in scored.groupBy("provenance").count().collect()} == {"confirmed": 96, "bootstrap": 192}


def test_both_sides_of_a_prune_trial_are_grown(world, no_driver_fit):
    wide = world.select("*", *[(F.pmod(F.xxhash64("row_id", F.lit(i)), F.lit(50)) / 50).alias(f"x{i}") for i in range(20)])
    columns = [*COLS, *[f"x{i}" for i in range(20)]]
    r = N.prune_trial(N.align(wide, columns).where("row_id % 4 <> 0"), N.align(wide, columns).where("row_id % 4 = 0"), columns, ["x18", "x19"], **FAST).first()
    assert 0 < r.champion < 1 and 0 < r.challenger < 1 and r.prune == (r.challenger >= r.champion - 0.02)
    assert not N.prune_trial(N.align(wide, columns), world, columns, columns[:10], **FAST).first().prune  # too few columns stay


def test_what_if_of_a_grown_forest_scores_the_edited_rows(world, no_driver_fit):
    model = N.fit_classifier(world, COLS, **FAST)
    got = {r.row_id: r for r in N.what_if(model, world, {"bed": 0.9}).collect()}
    want = {r.row_id: r for r in model.score(N.align(world.withColumn("bed", F.lit(0.9)), COLS)).collect()}
    assert len(got) == 600 and all(got[k].p_sleeping == want[k].p_sleeping for k in got)
    assert sum(r.p_sleeping for r in got.values()) > 300


def test_windows_are_scored_by_a_grown_forest(world, no_driver_fit):
    rows = world.withColumns({"person": F.concat(F.lit("p"), F.col("row_id") % 4), "w": F.col("minute")})
    model = N.fit_classifier(rows, COLS, **FAST)
    out = N.score_windows(model, rows, F.when(F.col("row_id") % 20 == 0, "away"), F.lit(None).cast("string"), F.lit(0.6), F.lit(0.7)).collect()
    assert len(out) == 600 and sum(r.basis == "fact" for r in out) == 30 and {r.predicted for r in out if r.basis == "fact"} == {"away"}
    p = {r.w: max(r.p_home, r.p_movie, r.p_sleeping) for r in model.score(rows).collect()}
    assert all(r.confidence == pytest.approx(p[r.w]) for r in out if r.basis == "model")


def test_calibration_of_a_grown_forest_keeps_all_rows(world, no_driver_fit):
    model = N.fit_classifier(world.where("row_id % 4 <> 0"), COLS, **FAST)
    scored = model.score(world.where("row_id % 4 = 0"))
    got = N.calibrate(scored, N.fit_calibrators(scored, model.classes))
    total = F.col("p_home") + F.col("p_movie") + F.col("p_sleeping")
    r = got.agg(F.count("*"), F.min(total), F.max(total)).first()
    assert r[0] == 150 and r[1] == pytest.approx(1) and r[2] == pytest.approx(1)
