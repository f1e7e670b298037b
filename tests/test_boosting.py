"""Softmax boosting against a booster of plain loops; pipelines that are saved and loaded."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from dayweave.operators import learning as N
from dayweave.operators.boosting import SoftmaxBooster
from dayweave.session import scratch_path


def data(seed=0, n=240):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 1)
    y = (x[:, 0] + 0.5 * x[:, 1] > 0.3).astype(int) + ((x[:, 1] > 0.4) & (x[:, 0] < 0.5)).astype(int)
    return x, y, np.round(rng.uniform(0.5, 2, n), 2)


def frame(spark, x, y, w):
    rows = [(i, r.tolist(), float(c), float(v)) for i, (r, c, v) in enumerate(zip(x, y, w))]
    return spark.createDataFrame(rows, "id long, v array<double>, label double, weight double").withColumn("features", array_to_vector("v")).repartition(4)


def plain(x, y, w, rounds, rate, depth, classes):
    """Scores after every round, by trying every value of every column at every node."""
    start = np.log([w[y == k].sum() / w.sum() for k in range(classes)])
    scores, out = np.tile(start, (len(x), 1)), []
    for _ in range(rounds):
        e = np.exp(scores - scores.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        step = np.zeros_like(scores)
        for k in range(classes):
            r = (y == k) - p[:, k]

            def grow(rows, left):
                g, n = (w * r)[rows].sum(), w[rows].sum()
                best = (1e-10 * n, None)
                for c in range(x.shape[1]) if left else ():
                    for v in sorted(set(x[rows, c]))[:-1]:
                        a = rows[x[rows, c] <= v]
                        ga, na = (w * r)[a].sum(), w[a].sum()
                        gain = round(ga**2 / na + (g - ga) ** 2 / (n - na) - g**2 / n, 10)
                        if gain > best[0]:
                            best = (gain, (c, v))
                if best[1] is None:
                    h = (w * np.abs(r) * (1 - np.abs(r)))[rows].sum()
                    step[rows, k] = rate * (classes - 1) / classes * g / h
                    return
                c, v = best[1]
                grow(rows[x[rows, c] <= v], left - 1)
                grow(rows[x[rows, c] > v], left - 1)

            grow(np.arange(len(x)), depth)
        scores = scores + step
        out.append(scores)
    return out


def log_loss(scores, y, w):
    e = np.exp(scores - scores.max(1, keepdims=True))
    return -(w * np.log((e / e.sum(1, keepdims=True))[np.arange(len(y)), y])).sum() / w.sum()


@pytest.mark.parametrize("depth, keep, few", [(1, 25, 0), (3, 2, 0), (3, 25, 1000)])
def test_boosting_equals_plain_loops(spark, depth, keep, few):
    x, y, w = data()
    df = frame(spark, x, y, w)
    model = SoftmaxBooster(numClasses=3, maxIter=5, stepSize=0.3, maxDepth=depth, maxBins=250, keep=keep, fewRows=few, weightCol="weight").fit(df)
    got = {r.id: r.p for r in model.transform(df).select("id", vector_to_array("probability").alias("p")).collect()}
    want = plain(x, y, w, 5, 0.3, depth, 3)
    e = np.exp(want[-1] - want[-1].max(1, keepdims=True))
    assert np.allclose([got[i] for i in range(len(x))], e / e.sum(1, keepdims=True), atol=1e-9)
    losses = [log_loss(s, y, w) for s in want]
    assert all(b < a for a, b in zip(losses, losses[1:])) and len(model.rounds()) == 5


def test_boosting_as_classifier_family_learns_and_can_be_saved(spark):
    x, y, w = data(1, 600)
    df = frame(spark, x, y, w).withColumn("y", F.element_at(F.array(*map(F.lit, ["home", "movie", "sleeping"])), F.col("label").cast("int") + 1)).drop("label")
    cols = ["v0", "v1", "v2"]
    df = df.select("id", "y", *[F.col("v")[i].alias(c) for i, c in enumerate(cols)])
    model = N.fit_classifier(df, cols, "boosting", maxIter=30, stepSize=0.2)
    scored = model.score(df)
    hit = F.greatest("p_home", "p_movie", "p_sleeping") == F.coalesce(*[F.when(F.col("y") == c, F.col(f"p_{c}")) for c in model.classes])
    assert scored.agg(F.avg(hit.cast("int"))).first()[0] > 0.95
    key = lambda m: sorted(map(tuple, m.score(df).select("id", "p_home", "p_movie", "p_sleeping").collect()))
    for fitted in (model, N.fit_classifier(df, cols, numTrees=3), N.fit_classifier(df, cols, "logistic", maxIter=5)):
        path = scratch_path(spark, "model")
        fitted.save(path)
        again = N.ClassModel.load(path)
        assert (again.classes, again.columns) == (model.classes, cols) and key(again) == key(fitted)


def test_estimator_in_a_pipeline_survives_disk(spark):
    path = scratch_path(spark, "estimator")
    Pipeline(stages=[SoftmaxBooster(numClasses=3, maxIter=2, maxDepth=2)]).write().save(path)
    stage = Pipeline.load(path).getStages()[0]
    x, y, w = data(2, 60)
    model = stage.fit(frame(spark, x, y, w))
    assert stage.getOrDefault("maxDepth") == 2 and len(model.rounds()) == 2


def test_constant_columns_and_missing_classes(spark):
    x, y, w = np.ones((20, 2)), np.array([0, 2] * 10), np.ones(20)
    model = SoftmaxBooster(numClasses=3, maxIter=3).fit(frame(spark, x, y, w))
    p = model.transform(frame(spark, x, y, w)).select(vector_to_array("probability").alias("p")).first().p
    assert p[0] == pytest.approx(0.5, abs=1e-6) and p[1] < 1e-6
