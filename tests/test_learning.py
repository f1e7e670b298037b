"""Contracts of the fitted operators."""

import threading
import time

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from dayweave.operators import learning as N
from dayweave.operators import stats as X
from dayweave.operators.attribution import path_attribution


@pytest.fixture(scope="module")
def world(spark):
    """Bed → sleeping, tv → movie, else home, two noise columns; 14 days of half hours."""
    h = F.floor(F.col("id") / 2) % 24
    bed = ((h >= 23) | (h < 7)).cast("double")
    tv = ((h >= 20) & (h < 23)).cast("double")
    df = spark.range(14 * 48).select(
        F.col("id").alias("row_id"), (F.col("id") * 30).alias("minute"), bed.alias("bed"), tv.alias("tv"), ((F.xxhash64("id") % 100) / 100.0).alias("noise"), F.lit(1.0).alias("flat"),
    )
    labelled = df.withColumn("y", F.when(F.col("bed") == 1, "sleeping").when(F.col("tv") == 1, "movie").otherwise("home")).cache()
    yield labelled
    labelled.unpersist()


COLS = ["bed", "tv", "noise", "flat"]
FAST = {"numTrees": 5, "maxDepth": 4}


def test_pooled_scores_learn_the_world(world):
    folds = N.folds_of(world, 14 * 1440, 2, 3)
    assert [f["ship"] for f in folds] == [False, False, True]
    scored, _ = N.pooled_scores(world, COLS, folds, N.classes_of(world), **FAST)
    r = scored.agg(F.avg("correct"), F.count("*"), F.min(F.col("p_home") + F.col("p_movie") + F.col("p_sleeping"))).first()
    assert r[0] > 0.95 and r[1] == 6 * 48 and r[2] == pytest.approx(1.0)


def test_importance_finds_bed_and_ignores_constants(world):
    ready = N.align(world, COLS)
    model = N.fit_classifier(ready, COLS, **FAST)
    imp = {r.feature: r.importance for r in N.permutation_importance(model, ready, "row_id").collect()}
    assert imp["bed"] > 0.1 and imp["tv"] > 0.02 and imp["flat"] == pytest.approx(0.0)
    att = N.ablation(model, ready.where("bed = 1"), "row_id", ready).groupBy("feature").agg(F.avg("weight").alias("w"))
    w = {r.feature: r.w for r in att.collect()}
    assert max(w, key=w.get) == "bed" and abs(w["flat"]) < 1e-9


def test_trees_of_many_rows_are_fitted_in_groups(world, monkeypatch, tmp_path):
    params = {"numTrees": 60, "maxDepth": 4}
    assert len(N.fit_classifier(world, COLS, **params).forests()) == 1
    monkeypatch.setattr(N, "ONE_FIT_ROWS", 100)
    model = N.fit_classifier(world, COLS, **params)
    # all trees are there, and no two groups draw the same
    assert [m.getNumTrees for m in model.forests()] == [25, 25, 10]
    assert len({m.toDebugString.split("\n", 1)[1] for m in model.forests()}) == 3
    scored = model.score(world)
    share = F.col("p_home") + F.col("p_movie") + F.col("p_sleeping")
    r = X.with_prediction(scored, model.classes).agg(F.avg("correct"), F.min(share), F.max(share), F.count("*")).first()
    assert r[0] > 0.95 and r[1] == pytest.approx(1.0) and r[2] == pytest.approx(1.0) and r[3] == world.count()
    assert not [c for c in scored.columns if c.startswith("_")]
    model.save(f"{tmp_path}/forest")
    again = N.ClassModel.load(f"{tmp_path}/forest")
    key = lambda df: df.orderBy("row_id").select("p_home", "p_movie", "p_sleeping").collect()
    assert key(again.score(world)) == key(scored)
    got = path_attribution(model, N.align(world, COLS), "row_id")
    gap = F.abs(F.aggregate("weights", F.col("base"), lambda a, v: a + v) - F.col("confidence"))
    assert got.agg(F.max(gap)).first()[0] < 1e-9


def test_search_judges_every_draw_on_every_fold(world, monkeypatch):
    running, most, guard = [0], [0], threading.Lock()
    real = N.RandomForestClassifier

    def counted(**params):
        est = real(**params)
        fit = est.fit

        def slow(df):
            with guard:
                running[0] += 1
                most[0] = max(most[0], running[0])
            try:
                time.sleep(0.5)
                return fit(df)
            finally:
                with guard:
                    running[0] -= 1

        est.fit = slow
        return est

    class Single:
        def __init__(self, stages):
            self.est = stages[0]

        def fit(self, df):
            return N.PipelineModel([self.est.fit(df)])

    monkeypatch.setattr(N, "RandomForestClassifier", counted)
    monkeypatch.setattr(N, "Pipeline", Single)
    folds = N.folds_of(world, 14 * 1440, 2, 3)
    params, f1 = N.search(world, COLS, folds, n_draws=2, trees=3, parallelism=6)
    assert params["numTrees"] == 3 and 0.9 < f1 <= 1
    # folds of one draw do not wait for each other
    assert most[0] > 2


def test_calibrated_rows_sum_to_one(world):
    model = N.fit_classifier(world, COLS, "logistic", maxIter=10)
    scored = model.score(world)
    c = N.calibrate(scored, N.fit_calibrators(scored, model.classes))
    low, high = c.select((F.col("p_home") + F.col("p_movie") + F.col("p_sleeping")).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert low == pytest.approx(1.0) and high == pytest.approx(1.0)


def test_nodes_follow_the_tree(world, spark):
    parents = spark.createDataFrame([("sleeping", None), ("movie", "home"), ("home", None)], "y string, parent string")
    models = N.train_nodes(world, COLS, parents, 60, 20, **FAST)
    assert set(models) == {"root", "home"} and models["root"].classes == ["home", "sleeping"] and models["home"].classes == ["home", "movie"]


def test_missing_columns_are_zero_and_extra_ones_ignored(world):
    model = N.fit_classifier(world, COLS, **FAST)
    assert model.score(world.drop("noise").withColumn("other", F.lit(3.0))).count() == world.count()


def test_density_recovers_planted_clusters(spark):
    a = spark.range(300).select(F.col("id").alias("row_id"), F.array(F.randn(1) * 0.2, F.randn(2) * 0.2).alias("x"), F.lit("a").alias("g"))
    b = spark.range(300, 600).select(F.col("id").alias("row_id"), F.array(F.randn(3) * 0.2 + 5, F.randn(4) * 0.2 + 5).alias("x"), F.lit("b").alias("g"))
    # a third of all rows are copies of one point
    copies = spark.range(600, 900).select(F.col("id").alias("row_id"), F.array(F.lit(5.0), F.lit(5.0)).alias("x"), F.lit("b").alias("g"))
    far = spark.range(900, 903).select(F.col("id").alias("row_id"), F.array(F.lit(50.0) + F.col("id"), F.lit(0.0)).alias("x"), F.lit("n").alias("g"))
    df = a.union(b).union(copies).union(far).withColumn("reduced", array_to_vector("x"))
    got = N.density_clusters(df, "row_id", 0.5, 5)
    top = got.groupBy("g", "cluster").count().toPandas()
    main = top.sort_values("count").groupby("g").tail(1).set_index("g")
    assert main.loc["a", "cluster"] != main.loc["b", "cluster"] and main.loc["n", "cluster"] == -1
    assert main.loc["a", "count"] > 270 and main.loc["b", "count"] > 570


def brute_clusters(points, radius, min_points):
    """{key: cluster} by plain loops; points: {key: vector}."""
    import numpy as np

    keys = list(points)
    x = np.array([points[k] for k in keys], dtype=float)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = (d <= radius).sum(1) >= min_points
    label = {}
    for i in np.flatnonzero(core):
        if keys[i] in label:
            continue
        todo, group = [i], {i}
        while todo:
            near = [j for j in np.flatnonzero((d[todo.pop()] <= radius) & core) if j not in group]
            group |= set(near)
            todo += near
        low = min(keys[j] for j in group)
        label |= {keys[j]: low for j in group}
    for i in np.flatnonzero(~core):
        hit = [j for j in np.flatnonzero((d[i] <= radius) & core)]
        label[keys[i]] = label[keys[min(hit, key=lambda j: (d[i, j], keys[j]))]] if hit else -1
    return label


@pytest.mark.parametrize("dims, block", [(1, 2000), (2, 40), (5, 60)])
def test_density_equals_brute_force_in_any_dimension(spark, dims, block):
    import numpy as np

    rng = np.random.default_rng(dims)
    x = np.concatenate([rng.normal(c, 0.35, (90, dims)) for c in (0.0, 4.0)] + [rng.uniform(-3, 7, (60, dims))])
    if dims == 5:  # two groups that only the fourth component tells apart
        x[:90, :3] = x[90:180, :3]
        x[90:180, 3] += 10
    points = {int(i): v.tolist() for i, v in enumerate(x)}
    df = spark.createDataFrame([(i, v) for i, v in points.items()], "row_id long, x array<double>").withColumn("reduced", array_to_vector("x"))
    got = N.density_clusters(df, "row_id", 0.8, 5, block=block).select("row_id", "cluster").collect()
    want = brute_clusters(points, 0.8, 5)
    assert {r.row_id: r.cluster for r in got} == want
    if dims == 5:
        assert len({want[i] for i in range(180) if want[i] >= 0}) >= 2
    small = N.density_clusters(df, "row_id", 0.8, 5, min_cluster=1000, block=block)
    assert small.where("cluster <> -1").count() == 0


def test_blocks_of_rows_grow_with_their_number(spark, monkeypatch):
    """A row goes to as many tasks as there are blocks; they were as many as the rows need at one size."""
    import numpy as np

    x = np.random.default_rng(9).normal(0, 0.3, (600, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, x array<double>").withColumn("reduced", array_to_vector("x"))
    kept, sizes = N.materialise, {}

    def watched(df, name):
        out = kept(df, name)
        sizes[name] = out.count() if name != "block-pairs" else out.select("home").distinct().count()
        return out

    monkeypatch.setattr(N, "materialise", watched)
    monkeypatch.setattr(N, "SIDE_BLOCKS", 4)
    got = N.density_clusters(df, "row_id", 0.8, 5, block=10).select("row_id", "cluster").collect()
    assert {r.row_id: r.cluster for r in got} == brute_clusters(dict(enumerate(x.tolist())), 0.8, 5)
    assert sizes["block-pairs"] <= 4 + 2 * 4  # four cells, each with a block that is not full


def test_a_large_cluster_keeps_all_its_windows(spark):
    df = spark.range(1500).select("id", (F.col("id") * 30).alias("minute"), F.lit(7).cast("long").alias("cluster"), F.col("id").cast("double").alias("v"))
    r = N.pattern_cards(df, ["v"]).first()
    assert r.windows == 1500 and len(r.members) == 1500


def test_row_weights_reach_boosting(world):
    weighted = world.withColumn("wt", F.when(F.col("y") == "movie", 0.0001).otherwise(1.0)).withColumn("tv", F.lit(0.0)).withColumn("bed", F.lit(0.0))
    even = N.fit_classifier(weighted, ["noise"], "boosting", maxIter=2).score(weighted).agg(F.avg("p_movie")).first()[0]
    low = N.fit_classifier(weighted, ["noise"], "boosting", weight="wt", maxIter=2).score(weighted).agg(F.avg("p_movie")).first()[0]
    assert low < even - 0.03


def test_two_co_firing_groups_are_separated(spark):
    import numpy as np

    rng = np.random.default_rng(11)
    rows = []
    for base, names in ((0, ("hall", "stairs")), (7, ("hob", "extractor"))):
        for t in rng.choice(2000, 120, replace=False):
            rows += [("h", n, int(t)) for n in names]
    ch = spark.createDataFrame(rows, "home string, sensor string, minute long")
    frame = spark.createDataFrame([("h", 0, 1999)], "home string, first long, last long")
    corr = X.co_activation(ch, frame)
    g = {r.sensor: r.group_id for r in X.sensor_groups(corr).collect()}
    assert g["hall"] == g["stairs"] and g["hob"] == g["extractor"] and g["hall"] != g["hob"]


def test_leading_sensor_is_found(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    t = rng.choice(4000, 150, replace=False)
    rows = [("h", "a", int(x)) for x in t] + [("h", "b", int(x) + 4) for x in t] + [("h", "c", int(x)) for x in rng.choice(4000, 150, replace=False)]
    ch = spark.createDataFrame(rows, "home string, sensor string, minute long").distinct()
    frame = spark.createDataFrame([("h", 0, 4010)], "home string, first long, last long")
    e = X.lead_lag(ch, frame).where("rank = 1").first()
    assert (e.from_sensor, e.to_sensor, e.lag_min) == ("a", "b", 4) and e.strength > 0.8


def linkage(pairs, threshold):
    """{sensor: smallest sensor of its group} by naive average linkage over all pairs."""
    names = sorted({s for p in pairs for s in p})
    dist = lambda a, b: min(max(1 - pairs.get((min(a, b), max(a, b)), 0.0), 0.0), 2.0)
    groups = [[s] for s in names]
    while len(groups) > 1:
        mean = lambda x, y: sum(dist(a, b) for a in x for b in y) / (len(x) * len(y))
        d, i, j = min((mean(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        if d >= threshold:
            break
        groups[i] += groups.pop(j)
    return {s: min(g) for g in groups for s in g}


def test_sensor_groups_equal_linkage_over_all_pairs(spark):
    import itertools

    import numpy as np

    rng = np.random.default_rng(12)
    rows, want = [], {}
    for home in ("h1", "h2"):
        names = [f"s{k:02d}" for k in range(14)]
        pairs = {(a, b): float(np.round(rng.uniform(0.2, 0.95) if int(a[1:]) % 4 == int(b[1:]) % 4 else rng.uniform(-0.2, 0.45), 6)) for a, b in itertools.combinations(names, 2)}
        rows += [(home, a, b, r) for (a, b), r in pairs.items()]
        want[home] = linkage(pairs, 0.7)
    rows.append(("small", "a", "b", 0.9))
    got = X.sensor_groups(spark.createDataFrame(rows, "home string, a string, b string, r double")).toPandas()
    assert set(got.home) == {"h1", "h2"}
    for home, own in got.groupby("home"):
        lead = own.groupby("group_id").sensor.min()
        assert dict(zip(own.sensor, own.group_id.map(lead))) == want[home]
        assert lead.is_monotonic_increasing


def test_folds_are_fitted_at_the_same_time(spark):
    """Every fit waits for the other two; one after the other they would never meet."""
    import threading

    class Sure:
        classes = ["a", "b"]

        def score(self, df):
            return df.withColumns({"p_a": F.lit(1.0), "p_b": F.lit(0.0)})

    met = threading.Barrier(3)

    def fit(train, columns):
        met.wait(30)
        return Sure()

    rows = spark.createDataFrame([(m, "a") for m in range(40)], "minute long, y string")
    folds = [{"fold": i, "val_start": 10 * i, "val_end": 10 * i + 10} for i in (1, 2, 3)]
    scored, _ = N.pooled_scores(rows, [], folds, ["a", "b"], fit=fit)
    assert sorted((r.fold, r.n) for r in scored.groupBy("fold").agg(F.count("*").alias("n")).collect()) == [(1, 10), (2, 10), (3, 10)]
