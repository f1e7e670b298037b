"""Training, evaluation, importance, clustering and batch scoring with pyspark.ml.

One pooled model per node over role-level features is the default; a person is a column, and
metrics and gates are grouped by it. Feature vectors are built from named double columns.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.ml import Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA, QuantileDiscretizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from . import forest, scoring, stats
from .boosting import SoftmaxBooster
from .forest import GrownForest

# Fixed values of the estimators.
FOREST = {"numTrees": 300, "minInstancesPerNode": 5, "maxDepth": 20, "seed": 42}
BOOSTING = {"maxIter": 200, "stepSize": 0.05, "maxDepth": 3}
MIN_CHILD_WINDOWS, MIN_CHILD_FINE = 60, 20
#: Rows of a partition of a fold.
FOLD_ROWS = 20_000
#: Up to so many rows a forest is one fit of Spark; beyond that its trees are grown by tasks.
ONE_FIT_ROWS = 1_000
TEMPORAL = ["hour_of_day", "day_of_week", "is_weekend", "time_bucket"]


def align(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    """ML-05: the training columns in order, absent or NULL ones 0, extra ones ignored."""
    parts = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in columns]
    return df.withColumn(out, array_to_vector(F.array(*parts)))


def index_labels(df: DataFrame, classes: list[str], label: str = "y") -> DataFrame:
    pairs = [F.lit(x) for i, c in enumerate(classes) for x in (c, float(i))]
    return df.withColumn("label", F.create_map(*pairs)[F.col(label)])


def classes_of(df: DataFrame, label: str = "y") -> list[str]:
    """Class names of a label column; as many as there are activities."""
    return [r[0] for r in df.where(F.col(label).isNotNull()).select(label).distinct().orderBy(label).collect()]


class ClassModel:
    """A fitted classifier with its classes and columns; scoring yields p_<class> columns."""

    def __init__(self, model: Model, classes: list[str], columns: list[str]):
        self.model, self.classes, self.columns = model, classes, columns

    def score(self, df: DataFrame) -> DataFrame:
        ready = df if "features" in df.columns else align(df, self.columns)
        got = self.model.transform(ready)
        wide = got.withColumn("_p", vector_to_array("probability")).withColumns({f"p_{c}": F.col("_p")[i] for i, c in enumerate(self.classes)})
        return wide.drop("_p", "rawPrediction", "probability", "prediction", "label")

    def grown(self) -> GrownForest | None:
        """The forest that tasks have grown, if it is one."""
        return next((m for m in self.model.stages if isinstance(m, GrownForest)), None)

    def forests(self) -> list[RandomForestClassificationModel | forest.TreeGroup]:
        """The groups of trees of a forest, in order."""
        return self.grown().groups() if self.grown() else [m for m in self.model.stages if isinstance(m, RandomForestClassificationModel)]

    def save(self, path: str) -> None:
        """Writes the fitted pipeline with its classes and columns to a new folder of shared storage."""
        if self.grown():
            self.grown().copy_trees(f"{path}/trees")
        self.model.write().save(f"{path}/pipeline")
        spark = SparkSession.active()
        spark.createDataFrame([(self.classes, self.columns)], "classes array<string>, columns array<string>").coalesce(1).write.parquet(f"{path}/names")

    @classmethod
    def load(cls, path: str) -> ClassModel:
        names = SparkSession.active().read.parquet(f"{path}/names").first()
        model = cls(PipelineModel.load(f"{path}/pipeline"), list(names.classes), list(names.columns))
        if model.grown():
            model.grown()._set(path=f"{path}/trees")
        return model


def fit_classifier(df: DataFrame, columns: list[str], family: str = "random_forest", label: str = "y", weight: str | None = None,
                   embed: Transformer | None = None, **params) -> ClassModel:
    """ML-01..04: forest, boosting, logistic head, optionally behind an embedding transformer."""
    classes = classes_of(df, label)
    ready = index_labels(df if "features" in df.columns else align(df, columns), classes, label).where(F.col("label").isNotNull())
    extra = {"weightCol": weight} if weight else {}
    if family == "random_forest":
        first = [embed] if embed is not None else []
        return ClassModel(fit_forest(ready, first, len(classes), **{**FOREST, **params}, **extra), classes, columns)
    if family == "boosting":
        est = SoftmaxBooster(numClasses=len(classes), **{**BOOSTING, **params}, **extra)
    else:
        est = LogisticRegression(family="multinomial", **params, **extra)
    stages = [embed, est.setFeaturesCol(embed.getOutputCol())] if embed is not None else [est]
    model = Pipeline(stages=stages).fit(ready)
    return ClassModel(model, classes, columns)


def fit_forest(ready: DataFrame, first: list[Transformer], classes: int, **params) -> PipelineModel:
    """A forest behind fitted stages: one fit of Spark for few rows, trees grown by tasks for many."""
    weight = params.pop("weightCol", None)
    if not set(params) <= forest.KNOWN or ready.count() <= ONE_FIT_ROWS:
        est = RandomForestClassifier(**params, **({"weightCol": weight} if weight else {}))
        return Pipeline(stages=[*first, est.setFeaturesCol(first[-1].getOutputCol()) if first else est]).fit(ready)
    features = first[-1].getOutputCol() if first else "features"
    return PipelineModel([*first, *forest.grow(reduce(lambda df, t: t.transform(df), first, ready), [params], classes, features, weight)])


def logistic_importance(model: ClassModel) -> dict[str, float]:
    """ML-03: mean absolute coefficient per column; a matrix of classes × columns."""
    m = model.model.stages[-1].coefficientMatrix.toArray()
    return dict(zip(model.columns, abs(m).mean(axis=0).tolist()))


def at_once(jobs: list, spark: SparkSession, most: int = 4) -> list:
    """The results of fits that do not need each other, in order; `most` run at the same time."""
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target

    pool = ThreadPool(most)
    try:
        return pool.map(inheritable_thread_target(spark)(lambda job: job()), jobs, 1)
    finally:
        pool.close()


# --- folds, search and evaluation (ML-06, 12..14, SET-04) -----------------------------------------


def fold_parts(df: DataFrame, fold: dict) -> tuple[DataFrame, DataFrame]:
    m = F.col("minute")
    return df.where(m < fold["val_start"]), df.where((m >= fold["val_start"]) & (m < fold["val_end"]))


def folds_of(df: DataFrame, end: int, val_days: int = 7, n_folds: int = 3) -> list[dict]:
    """Usable rolling-origin folds, oldest first (three rows at most reach the driver)."""
    got = scoring.rolling_folds(df, [], F.lit(end), val_days, n_folds) if df.columns else None
    return [r.asDict() for r in got.orderBy("fold").collect()]


def pooled_scores(df: DataFrame, columns: list[str], folds: list[dict], classes: list[str], fit=fit_classifier, **kw) -> tuple[DataFrame, ClassModel]:
    """ML-12 / SET-04: every fold's block scored by a model of what came before, pooled by name;
    a class a fold never saw gets 0 and its rows are left out. The last model ships."""
    models = at_once([lambda f=f: fit(fold_parts(df, f)[0], columns, **kw) for f in folds], df.sparkSession)
    parts, model = [], None
    for f, model in zip(folds, models):
        _, val = fold_parts(df, f)
        scored = model.score(val.where(F.col("y").isin(model.classes)))
        missing = {f"p_{c}": F.lit(0.0) for c in classes if c not in model.classes}
        parts.append((scored.withColumns(missing) if missing else scored).withColumn("fold", F.lit(f["fold"])))
    pooled = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stats.with_prediction(pooled, classes), model


def macro_f1(scored: DataFrame) -> Column:
    return stats.class_report(stats.confusion(scored, []), []).agg(F.avg("f1").alias("f1"))


def draw_params(i: int, seed: int = 42) -> dict:
    """The i-th seeded draw of the search space."""
    h = hashlib.md5(f"{seed}|{i}".encode()).digest()
    pick = lambda k, xs: xs[h[k] % len(xs)]
    return {"numTrees": pick(0, [100, 200, 300]), "maxDepth": pick(1, [6, 10, 20]), "minInstancesPerNode": pick(2, [2, 5, 10]), "subsamplingRate": pick(3, [0.7, 0.85, 1.0])}


def binned_folds(df: DataFrame, columns: list[str], folds: list[dict], classes: list[str], bins: int = 32) -> list[tuple[DataFrame, DataFrame]]:
    """Training and validation rows of every fold, their columns cut into bins of the training rows once and written.

    A tree looks for splits between bins of its columns in any case; here all fits of a search share them.
    """
    named = [f"{c}_bin" for c in columns]
    out = []
    for f in folds:
        train, val = (align(part, columns).select("y", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in part.columns else F.lit(0.0).alias(c) for c in columns]) for part in fold_parts(df, f))
        cut = QuantileDiscretizer(numBuckets=bins, inputCols=columns, outputCols=named, relativeError=0.001).fit(train)
        ready = lambda part: index_labels(align(cut.transform(part).drop(*columns), named), classes).where(F.col("label").isNotNull()).select("y", "label", "features")
        # every partition of the training rows holds the sums of all open nodes: no more partitions than rows call for
        few = max(1, train.count() // FOLD_ROWS)
        out.append((materialise(ready(train).coalesce(few), "fold-train"), materialise(ready(val).coalesce(few), "fold-val")))
    return out


def search(df: DataFrame, columns: list[str], folds: list[dict], n_draws: int = 15, trees: int | None = None, parallelism: int | None = None) -> tuple[dict, float]:
    """ML-06: seeded random draws judged by macro F1 over the rolling folds.

    Every draw and fold is a forest of its own on the binned folds. On folds of few rows each is a fit, on many rows the
    trees of all draws are grown at once; `parallelism` fits or folds (the cores if None) run at the same time.
    Ties go to the earlier draw. trees: overrides the drawn number.
    """
    classes = classes_of(df)
    parts = [(train, val, classes_of(train)) for train, val in binned_folds(df, columns, folds, classes)]
    spark = df.sparkSession
    drawn = [draw_params(i) | ({"numTrees": trees} if trees else {}) for i in range(n_draws)]

    def judge(i: int, train: DataFrame, val: DataFrame, seen: list[str]) -> list:
        """Counts of (label, prediction) of a fold; the fitted trees are let go of."""
        model = ClassModel(Pipeline(stages=[RandomForestClassifier(**{**FOREST, **drawn[i]})]).fit(train), classes, [])
        scored = stats.with_prediction(model.score(val.where(F.col("y").isin(seen))), classes)
        return [(i, *r) for r in stats.confusion(scored, []).select("y", "predicted", "n").collect()]

    def judge_all(train: DataFrame, val: DataFrame, seen: list[str]) -> list:
        """The same of every draw, whose trees are grown and walked by tasks of one job."""
        models = forest.grow(train, [{**FOREST, **p} for p in drawn], len(classes))
        held = materialise(val.where(F.col("y").isin(seen)).select(F.monotonically_increasing_id().alias("row"), "y", models[0].codes().alias("codes")), "fold-codes")
        said = forest.over_trees(models, held, forest.votes, len(classes)).select(F.col("forest").alias("draw"), "row", *[F.col("v")[k].alias(f"p_{c}") for k, c in enumerate(classes)])
        scored = stats.with_prediction(said.join(held.select("row", "y"), "row"), classes)
        return [tuple(r) for r in stats.confusion(scored, ["draw"]).select("draw", "y", "predicted", "n").collect()]

    jobs = []
    for p in parts:
        jobs += [lambda p=p: judge_all(*p)] if p[0].count() > ONE_FIT_ROWS else [lambda i=i, p=p: judge(i, *p) for i in range(n_draws)]
    counts = [r for got in at_once(jobs, spark, parallelism or max(4, spark.sparkContext.defaultParallelism)) for r in got]
    pooled = spark.createDataFrame(counts, "draw int, y string, predicted string, n long").groupBy("draw", "y", "predicted").agg(F.sum("n").alias("n"))
    f1 = dict(stats.class_report(pooled, ["draw"]).groupBy("draw").agg(F.avg("f1")).collect())
    return max(((params, f1[i]) for i, params in enumerate(drawn)), key=lambda r: r[1])


def train_nodes(df: DataFrame, columns: list[str], parents: DataFrame, min_windows: int = MIN_CHILD_WINDOWS, min_fine: int = MIN_CHILD_FINE, **kw) -> dict[str, ClassModel]:
    """ML-13: a root model on coarse labels and one per parent with enough windows, fine labels and
    two classes. parents: (y, parent) with parent NULL for top activities."""
    tree = df.join(parents, "y", "left").withColumn("coarse", F.coalesce("parent", "y"))
    jobs = {"root": lambda: fit_classifier(tree.drop("y").withColumnRenamed("coarse", "y"), columns, **kw)}
    per = tree.groupBy("coarse").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("parent").isNotNull()).alias("fine"), F.count_distinct("y").alias("k"))
    for r in per.where((F.col("n") >= min_windows) & (F.col("fine") >= min_fine) & (F.col("k") >= 2)).orderBy("coarse").collect():
        jobs[r["coarse"]] = lambda c=r["coarse"]: fit_classifier(tree.where(F.col("coarse") == c), columns, **kw)
    return dict(zip(jobs, at_once(list(jobs.values()), df.sparkSession)))


# --- calibration (ML-15) ------------------------------------------------------------------------------


def fit_calibrators(scored: DataFrame, classes: list[str]) -> dict[str, Model]:
    out = {}
    for c in classes:
        rows = scored.select(F.col(f"p_{c}").alias("features"), (F.col("y") == c).cast("double").alias("label"))
        out[c] = IsotonicRegression().fit(rows.withColumn("features", array_to_vector(F.array("features"))))
    return out


def _knot_value(x: Column, bx: list[float], by: list[float]) -> Column:
    """Linear interpolation between sorted knots. The knots are array literals, searched in two steps of
    about the square root of their number, so the expression does not grow with the fit."""
    n = len(bx)
    if n == 1:
        return F.lit(by[0])
    step = max(1, int(n ** 0.5))
    xs, ys = F.array(*map(F.lit, bx)), F.array(*map(F.lit, by))
    coarse = F.array(*[F.lit(v) for v in bx[::step]])
    begin = F.greatest(F.lit(0), F.size(F.filter(coarse, lambda v: v < x)) - 1) * step
    # index (from 0) of the first knot that is not below x
    at = begin + F.size(F.filter(F.slice(xs, begin + 1, F.lit(step + 1)), lambda v: v < x))
    x0, x1 = F.element_at(xs, F.greatest(at, F.lit(1)).cast("int")), F.element_at(xs, (F.least(at, F.lit(n - 1)) + 1).cast("int"))
    y0, y1 = F.element_at(ys, F.greatest(at, F.lit(1)).cast("int")), F.element_at(ys, (F.least(at, F.lit(n - 1)) + 1).cast("int"))
    between = F.when(x1 > x0, y0 + (y1 - y0) * (x - x0) / (x1 - x0)).otherwise(y1)
    return F.when(at == 0, by[0]).when(at >= n, by[-1]).otherwise(between)


def calibrate(scored: DataFrame, models: dict[str, Model]) -> DataFrame:
    """ML-15: isotonic per class, clipped to [.001, .999], renormalised; the fitted curve becomes a column."""
    cols = {}
    for c, m in models.items():
        val = _knot_value(F.col(f"p_{c}"), m.boundaries.toArray().tolist(), m.predictions.toArray().tolist())
        cols[f"c_{c}"] = F.least(F.lit(0.999), F.greatest(F.lit(0.001), val))
    raw = scored.withColumns(cols)
    total = reduce(lambda a, b: a + b, [F.col(k) for k in cols])
    return raw.withColumns({f"p_{c}": F.col(f"c_{c}") / total for c in models}).drop(*cols)


# --- importance and attribution (ML-16, 18, 19) ------------------------------------------------------------


def shuffled_partners(df: DataFrame, key: str, rows_per_bucket: int = 1000, seed: int = 42) -> DataFrame:
    """Each row's partner vector: the next row by hash inside a random bucket of bounded size.

    A seeded permutation without a global order: buckets come from the hash, so they are random
    samples, and no task holds more than a bucket.
    """
    from pyspark.sql import Window

    n = df.agg(F.count(F.lit(1))).scalar()
    h = F.xxhash64(F.lit(seed), F.col(key))
    placed = df.withColumns({"_h": h, "_n": n}).withColumn("_b", F.pmod(F.hash(F.col(key), F.lit(seed + 1)), F.greatest(F.lit(1), F.ceil(F.col("_n") / rows_per_bucket))))
    w = Window.partitionBy("_b").orderBy("_h")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return placed.withColumn("_partner", F.coalesce(F.lead("_x").over(w), F.first("_x").over(whole))).drop("_h", "_n", "_b")


def permutation_importance(model: ClassModel, val: DataFrame, key: str, repeats: int = 2, seed: int = 42) -> DataFrame:
    """ML-16: mean accuracy lost when a column is shuffled; all columns scored in one batch per repeat."""
    if model.grown() and len(model.model.stages) == 1:
        return _grown_importance(model, val, key, repeats, seed)
    base = val.withColumn("_x", vector_to_array("features"))
    acc = stats.with_prediction(model.score(val), model.classes).agg(F.avg("correct")).scalar()
    names = F.array(*map(F.lit, model.columns))
    parts = []
    for r in range(repeats):
        pairs = shuffled_partners(base, key, seed=seed + r)
        spread = pairs.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(len(model.columns) - 1))))
        swapped = F.transform("_x", lambda v, i: F.when(i == F.col("_j"), F.element_at("_partner", F.col("_j") + 1)).otherwise(v))
        moved = spread.withColumns({"features": array_to_vector(swapped), "feature": F.element_at(names, F.col("_j") + 1)})
        scored = stats.with_prediction(model.score(moved.drop("_x", "_partner", "_j")), model.classes)
        parts.append(scored.groupBy("feature").agg(F.avg("correct").alias("acc")))
    every = reduce(lambda a, b: a.unionByName(b), parts)
    return every.groupBy("feature").agg(F.avg("acc").alias("acc")).select("feature", (acc - F.col("acc")).alias("importance"))


def _grown_importance(model: ClassModel, val: DataFrame, key: str, repeats: int, seed: int) -> DataFrame:
    """The same over a grown forest: a task walks its trees with every column shuffled, rows are not spread by column."""
    grown, classes, n = model.grown(), len(model.classes), len(model.columns)
    base = materialise(val.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("_key"), "y", grown.codes().alias("_x")), "importance-rows")
    said = materialise(forest.over_trees([grown], base.select("row", F.col("_x").alias("codes")), forest.votes, classes).select("row", F.col("v").alias("votes")).join(base.select("row", "y"), "row"), "importance-votes")
    named = lambda at: [at(i).alias(f"p_{c}") for i, c in enumerate(model.classes)]
    acc = stats.with_prediction(said.select("y", *named(lambda i: F.col("votes")[i])), model.classes).agg(F.avg("correct")).scalar()
    parts = []
    for r in range(repeats):
        pairs = materialise(shuffled_partners(base, "_key", seed=seed + r).select("row", F.col("_x").alias("codes"), F.col("_partner").alias("other")), "importance-pairs")
        moved = forest.over_trees([grown], pairs, forest.replaced_votes, n * classes, "other")
        spread = said.join(moved, "row").withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        scored = stats.with_prediction(spread.select("y", "_j", *named(lambda i: F.col("votes")[i] + F.get("v", F.col("_j") * classes + i))), model.classes)
        parts.append(scored.groupBy("_j").agg(F.avg("correct").alias("acc")))
    every = reduce(lambda a, b: a.unionByName(b), parts).withColumn("feature", F.element_at(F.array(*map(F.lit, model.columns)), F.col("_j") + 1))
    return every.groupBy("feature").agg(F.avg("acc").alias("acc")).select("feature", (acc - F.col("acc")).alias("importance"))


def ablation(model: ClassModel, rows: DataFrame, key: str, background: DataFrame | None = None) -> DataFrame:
    """ML-19: p(predicted) minus p(predicted) with a feature at its background mean, per row and feature."""
    if model.grown() and len(model.model.stages) == 1:
        return _grown_ablation(model, rows, key, background)
    base = rows.withColumn("_x", vector_to_array("features"))
    n = len(model.columns)
    usual = base if background is None else background.withColumn("_x", vector_to_array("features"))
    means = usual.agg(F.array(*[F.avg(F.col("_x")[i]) for i in range(n)])).scalar()
    top = stats.with_prediction(model.score(rows), model.classes).select(key, F.col("predicted").alias("_predicted"), F.col("conf").alias("_conf"))
    # the prediction travels with the row, so only whole rows are joined and the spread ones never move
    base = base.join(top, key).repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, key)
    spread = base.withColumn("_m", means).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    cut = F.transform("_x", lambda v, i: F.when(i == F.col("_j"), F.element_at("_m", F.col("_j") + 1)).otherwise(v))
    names = F.array(*map(F.lit, model.columns))
    moved = spread.withColumns({"features": array_to_vector(cut), "feature": F.element_at(names, F.col("_j") + 1)}).drop("_x", "_m", "_j")
    scored = model.score(moved)
    after = F.coalesce(*[F.when(F.col("_predicted") == c, F.col(f"p_{c}")) for c in model.classes])
    return scored.select(key, "feature", (F.col("_conf") - after).alias("weight"))


def _grown_ablation(model: ClassModel, rows: DataFrame, key: str, background: DataFrame | None) -> DataFrame:
    """The same over a grown forest: a task walks its trees with every column at its mean, rows are not spread by column."""
    grown, n = model.grown(), len(model.columns)
    x = vector_to_array(grown.getFeaturesCol())
    means = (rows if background is None else background).agg(F.array(*[F.coalesce(F.avg(x[i]), F.lit(float("nan"))) for i in range(n)]).alias("m"))
    usual = means.select(array_to_vector("m").alias(grown.getFeaturesCol())).select(grown.codes()).first()[0]
    base = materialise(rows.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("_key"), grown.codes().alias("codes")), "ablation-rows")
    trees, many = grown.getOrDefault("numTrees"), len(model.classes)
    said = materialise(base.join(forest.over_trees([grown], base.select("row", "codes"), forest.votes, many).select("row", F.col("v").alias("votes")), "row"), "ablation-votes")
    top = said.select("_key", F.expr("array_position(votes, array_max(votes)) - 1").cast("int").alias("label"), (F.array_max("votes") / trees).alias("_conf"))
    # as rows and their predictions meet by key in the other form, a repeated key gives every pair here as well
    met = said.join(top, "_key").withColumn("_less", F.col("_conf") - F.get("votes", F.col("label")) / trees)
    asked = materialise(met.select(F.monotonically_increasing_id().alias("row"), "_key", "codes", "label", "_less", F.lit(bytes(usual)).alias("other")), "ablation-asked")
    moved = forest.over_trees([grown], asked, forest.replaced_share, n, "other, label")
    spread = asked.select("row", "_key", "_less").join(moved.select("row", "v"), "row").select(F.col("_key").alias(key), "_less", F.posexplode("v").alias("_j", "_v"))
    return spread.select(key, F.element_at(F.array(*map(F.lit, model.columns)), F.col("_j") + 1).alias("feature"), (F.col("_less") - F.col("_v") / trees).alias("weight"))


def prune_trial(train: DataFrame, val: DataFrame, columns: list[str], candidates: list[str], min_columns: int = 20, margin: float = 0.02, **kw) -> DataFrame:
    """ML-18: champion with all columns against a challenger without the candidates, by lower bound."""
    kept = [c for c in columns if c not in set(candidates)]
    if len(kept) < min_columns:
        kept = columns
    one = lambda cols, name: stats.with_prediction(fit_classifier(train.drop("features"), cols, **kw).score(align(val.drop("features"), cols)), classes_of(train)).agg(
        F.count(F.lit(1)).alias("n"), F.sum("correct").alias("k")).withColumn("side", F.lit(name))
    sides = ((columns, "champion"), (kept, "challenger"))
    both = reduce(lambda a, b: a.unionByName(b), at_once([lambda s=s: one(*s) for s in sides], train.sparkSession))
    low = stats.wilson(F.col("k"), F.col("n"))[0]
    row = both.withColumn("low", low).groupBy().pivot("side", ["champion", "challenger"]).agg(F.first("low"))
    return row.withColumn("prune", (F.col("challenger") >= F.col("champion") - margin) & F.lit(len(kept) < len(columns)))


# --- discovery (ML-28..32) ----------------------------------------------------------------------------------


def standardise(df: DataFrame, columns: list[str], out: str = "scaled") -> tuple[DataFrame, list[str]]:
    """ML-28: z-scores by mean and deviation; constants and clock columns are dropped."""
    usable = [c for c in columns if c not in TEMPORAL]
    spread = df.agg(*[F.stddev_samp(c).alias(c) for c in usable]).first()
    kept = [c for c in usable if (spread[c] or 0) > 0]
    ready = align(df, kept)
    return StandardScaler(withMean=True, withStd=True, inputCol="features", outputCol=out).fit(ready).transform(ready), kept


def reduce_dims(df: DataFrame, n_columns: int, variance: float = 0.9, most: int = 30, col: str = "scaled", out: str = "reduced") -> tuple[DataFrame, int]:
    """ML-29: principal components that hold the share of variance; three columns or fewer pass through."""
    if n_columns <= 3:
        return df.withColumn(out, F.col(col)), n_columns
    k_max = min(n_columns, most)
    model = PCA(k=k_max, inputCol=col, outputCol="_pc").fit(df)
    total, k = 0.0, 0
    for v in model.explainedVariance.toArray():
        total, k = total + v, k + 1
        if total >= variance:
            break
    k = max(2, k)
    cut = F.slice(vector_to_array("_pc"), 1, k)
    return model.transform(df).withColumn(out, array_to_vector(cut)).drop("_pc"), k


def _near(x, left, right, radius: float):
    """Index pairs within the radius, of the rows `left` and `right` of a task, and their distances."""
    import numpy as np

    norm, step = (x**2).sum(1), max(1, (1 << 20) // max(1, len(right)))
    for at in range(0, len(left) if len(right) else 0, step):
        rows = left[at : at + step]
        square = ((x[rows, None, :] - x[None, right, :]) ** 2).sum(-1) if x.shape[1] <= 4 else (norm[rows][:, None] + norm[right][None]) - 2 * x[rows] @ x[right].T
        # roots of the few near ones only; the margin is above their rounding
        i, j = np.nonzero(square <= radius**2 * (1 + 1e-9))
        d = np.sqrt(np.maximum(square[i, j], 0))
        near = d <= radius
        yield rows[i[near]], right[j[near]], d[near]


def _sides(pdf):
    """Vectors of a task and the places of its rows: a block against itself, or two blocks."""
    import numpy as np

    side = pdf["side"].to_numpy()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return np.stack(pdf["x"].to_numpy()), left, right if len(right) else left, not len(right)


#: Blocks that all rows are cut into, so that a row goes to so many tasks; a block has at most so many rows.
SIDE_BLOCKS, MOST_IN_BLOCK = 32, 200_000


def density_clusters(df: DataFrame, key: str, radius: float, min_points: int, col: str = "reduced", min_cluster: int = 1, block: int = 2_000) -> DataFrame:
    """ML-30: density clusters over all components of `col`, whatever their number; noise is −1.

    A row with min_points rows within the radius (itself included, copies counted) is a core; cores
    within the radius belong together; another row joins its nearest core within the radius. Clusters
    of fewer than min_cluster rows are noise. The number of a cluster is its smallest core key.

    Rows meet in cells of side `radius` over the two leading components, which never hides a pair, and
    distances are over all of them. Equal vectors are one row, crowded cells are cut into blocks, a task
    compares two blocks, and reports counts and a spanning forest, never the pairs. Blocks grow with the
    rows, from `block` on, so that what is shuffled grows as the rows do; blocks without a core meet no
    other such block a second time.
    """
    import pandas as pd

    from ..functions.components import components

    rows = df.withColumn("_x", vector_to_array(col))
    cell = F.transform(F.slice("_x", 1, 2), lambda v: F.floor(v / radius).cast("long"))
    points = rows.groupBy("_x").agg(F.min(F.col(key).cast("long")).alias("node"), F.count(F.lit(1)).alias("n")).withColumn("cell", cell)
    points = materialise(points, "distinct-points")
    most = max(block, min(MOST_IN_BLOCK, -(-points.count() // SIDE_BLOCKS)))
    sized = points.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / most).cast("long").alias("blocks"))
    placed = materialise(points.join(sized, "cell").select("node", "n", F.col("_x").alias("x"), F.struct("cell", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("b")).alias("home")), "points")
    # one row per pair of neighbouring blocks
    blocks = sized.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("b"))
    moves = F.sequence(F.lit(-1).cast("long"), F.lit(1).cast("long"))
    around = F.when(F.size("cell") == 1, F.transform(moves, lambda i: F.array(F.element_at("cell", 1) + i))).otherwise(
        F.flatten(F.transform(moves, lambda i: F.transform(moves, lambda j: F.array(F.element_at("cell", 1) + i, F.element_at("cell", 2) + j)))))
    pairs = blocks.select(F.struct("cell", "b").alias("one"), F.explode(around).alias("cell")).join(blocks.withColumnRenamed("b", "b2"), "cell").select("one", F.struct("cell", F.col("b2").alias("b")).alias("two")).where("one <= two")
    tasks = materialise(pairs.select(F.xxhash64("one", "two").alias("task"), F.explode(F.when(F.col("one") == F.col("two"), F.array(F.struct(F.lit(0).alias("side"), F.col("one").alias("home")))).otherwise(
        F.array(F.struct(F.lit(0).alias("side"), F.col("one").alias("home")), F.struct(F.lit(1).alias("side"), F.col("two").alias("home"))))).alias("m")).select("task", "m.*"), "block-pairs")

    def counts(pdf):
        import numpy as np

        n, total = pdf["n"].to_numpy(), np.zeros(len(pdf))
        x, left, right, same = _sides(pdf)
        for i, j, _ in _near(x, left, right, radius):
            total += np.bincount(i, n[j], len(pdf))
            if not same:
                total += np.bincount(j, n[i], len(pdf))
        return pd.DataFrame({"node": pdf["node"], "held": total.astype("int64")})

    def links(pdf):
        import numpy as np

        node, core = pdf["node"].to_numpy(), pdf["core"].to_numpy()
        x, left, right, same = _sides(pdf)
        up = np.arange(len(pdf))

        def root(k):
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        tree, near = [], {}
        # pairs with a core: all rows against the cores, and of two blocks also the cores against the others
        for some, others in ((left, right[core[right]]), *(() if same else ((left[core[left]], right[~core[right]]),))):
            for i, j, d in _near(x, some, others, radius):
                both = core[i] & core[j]
                a, b = up[i[both]], up[j[both]]
                apart = np.unique(np.minimum(a, b)[a != b] * len(pdf) + np.maximum(a, b)[a != b])
                for one, two in zip((apart // len(pdf)).tolist(), (apart % len(pdf)).tolist()):
                    one, two = root(one), root(two)
                    if one != two:
                        up[max(one, two)] = min(one, two)
                        tree.append((node[one], node[two]))
                while (up != up[up]).any():
                    up = up[up]
                border, held = np.where(core[i], j, i)[~both], np.where(core[i], i, j)[~both]
                for k, c, v in zip(node[border].tolist(), node[held].tolist(), d[~both].tolist()):
                    near[k] = min(near.get(k, (v, c)), (v, c))
        out = [(max(x, y), min(x, y), None) for x, y in tree] + [(k, c, v) for k, (v, c) in near.items()]
        return pd.DataFrame(out, columns=["a", "b", "d"])

    held = placed.join(tasks, "home").groupBy("task").applyInPandas(counts, "node long, held long").groupBy("node").agg(F.sum("held").alias("held"))
    cored = materialise(placed.join(held, "node").withColumn("core", F.col("held") >= min_points), "cores")
    linking = tasks.join(tasks.join(cored.where("core").select("home").distinct(), "home", "left_semi").select("task").distinct(), "task")
    found = materialise(cored.join(linking, "home").groupBy("task").applyInPandas(links, "a long, b long, d double"), "core-links")
    roots = components(found.where("d is null").select("a", "b"))
    cores = cored.where("core").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("cluster"))
    borders = found.where("d is not null").groupBy(F.col("a").alias("border")).agg(F.min_by("b", F.struct("d", "b")).alias("node")).join(cores, "node").select(F.col("border").alias("node"), "cluster")
    named = placed.select("node", "x").join(cores.unionByName(borders), "node").select(F.col("x").alias("_x"), "cluster")
    tagged = rows.join(named, "_x", "left").drop("_x")
    large = named.join(points.select("_x", "n"), "_x").groupBy("cluster").agg(F.sum("n").alias("_rows")).where(F.col("_rows") >= min_cluster).select("cluster", F.lit(True).alias("_ok"))
    kept = F.when(F.col("_ok"), F.col("cluster")).otherwise(F.lit(-1).cast("long"))
    return tagged.join(large, "cluster", "left").withColumn("cluster", kept).drop("_ok")


def mixture_rescue(df: DataFrame, floor: int, max_k: int = 6, col: str = "reduced", seed: int = 42) -> DataFrame:
    """ML-31: Gaussian components over the noise, their number by BIC; components below the floor stay noise."""
    noise = df.where(F.col("cluster") == -1)
    n = noise.count()
    if n < 2 * floor:
        return df.withColumn("rescued", F.lit(False))
    d = len(noise.select(col).first()[0])
    best = None
    for k in range(2, min(max_k, n // floor) + 1):
        m = GaussianMixture(k=k, featuresCol=col, seed=seed).fit(noise)
        free = k * (d + d * (d + 1) / 2) + k - 1
        import math

        bic = free * math.log(n) - 2 * m.summary.logLikelihood
        if best is None or bic < best[1]:
            best = (m, bic)
    if best is None:
        return df.withColumn("rescued", F.lit(False))
    comp = best[0].transform(noise).withColumnRenamed("prediction", "_c").drop("probability")
    big = comp.groupBy("_c").agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") >= floor).select("_c")
    named = comp.join(F.broadcast(big.withColumn("_ok", F.lit(True))), "_c", "left")
    fresh = named.withColumns({"cluster": F.when(F.col("_ok"), F.col("_c").cast("long")).otherwise(F.col("cluster")), "rescued": F.coalesce("_ok", F.lit(False))}).drop("_c", "_ok")
    return df.where(F.col("cluster") != -1).withColumn("rescued", F.lit(False)).unionByName(fresh)


def pattern_cards(clustered: DataFrame, columns: list[str], minute: str = "minute", most: int | None = None) -> DataFrame:
    """ML-32: per cluster its size, signature, hour histogram and member windows (the first `most`, all if None)."""
    from . import insight, topk

    clustered = materialise(clustered.select("cluster", *dict.fromkeys([minute, *columns])), "clustered")
    known = clustered.where(F.col("cluster") != -1)
    long = stats.unpivot(clustered.select("cluster", *[F.col(c).cast("double").alias(c) for c in columns]), ["cluster"], columns)
    sig = topk.signature(long, ["cluster"]).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda e: e["feature"]).alias("features"))
    hist = insight.hour_histogram(known, ["cluster"], F.floor(F.col(minute) / 60) % 24)
    from pyspark.sql import Window

    listed = known.select("cluster", minute)
    if most is not None:
        # rank-limited before the array is built
        listed = listed.withColumn("_r", F.row_number().over(Window.partitionBy("cluster").orderBy(minute))).where(F.col("_r") <= most)
    members = listed.groupBy("cluster").agg(F.array_sort(F.collect_list(minute)).alias("members"))
    size = known.groupBy("cluster").agg(F.count(F.lit(1)).alias("windows"))
    return size.join(sig, "cluster").join(hist, "cluster").join(members, "cluster")


def fresh_cards(cards: DataFrame, handled: DataFrame, min_shared: int = 3) -> DataFrame:
    """ML-32: cards that do not repeat a named or dismissed one. Both: (card, features)."""
    from . import topk

    seen = topk.signature_overlaps(cards, handled, "card", min_shared).select(F.col("a").alias("card")).distinct()
    return cards.join(seen, "card", "left_anti")


# --- batch scoring (ML-36, 40, 44) -----------------------------------------------------------------------------


def top_down(root: DataFrame, child: DataFrame, key: list[str], roots: list[str], fine: list[str]) -> DataFrame:
    """ML-40: where the winning root class has a child model its row is used; parent and coarse
    confidence are kept. root: (key, p_<root>), child: (key, node, q_<fine>)."""
    r = stats.with_prediction(root.withColumn("y", F.lit(None).cast("string")), roots).select(*key, F.col("predicted").alias("parent"), F.col("conf").alias("coarse_confidence"))
    best = F.greatest(*[F.col(f"q_{c}") for c in fine])
    name = F.coalesce(*[F.when(F.col(f"q_{c}") == best, c) for c in fine])
    c = child.select(*key, F.col("node").alias("parent"), name.alias("_fine"), best.alias("_conf"))
    j = r.join(c, [*key, "parent"], "left")
    return j.select(*key, F.coalesce("_fine", "parent").alias("predicted"), F.coalesce("_conf", "coarse_confidence").alias("confidence"), F.when(F.col("_fine").isNotNull(), F.col("parent")).alias("parent"), "coarse_confidence")


def score_windows(model: ClassModel, rows: DataFrame, gate: Column, presence: Column, direct_share: Column, qhat: Column, threshold: float = 0.4) -> DataFrame:
    """ML-36: settled windows skip the model; the rest go through gate, evidence cap, set, smoothing and
    abstention. rows: (person, w, features…); one row per published window comes out."""
    from .runs import hysteresis

    marked = rows.withColumns({"_gate": gate, "_presence": presence, "_direct": direct_share, "_qhat": qhat})
    open_rows = marked.where(F.col("_gate").isNull())
    scored = model.score(open_rows)
    probs = F.map_from_arrays(F.array(*map(F.lit, model.classes)), F.array(*[F.col(f"p_{c}") for c in model.classes]))
    gated = scored.withColumn("probs", scoring.presence_gate(probs, F.col("_presence")))
    from ..functions.cols import ranked_entries

    top = gated.withColumn("_top", ranked_entries(F.col("probs"))[0])
    base = top.select("person", "w", F.col("_top.k").alias("predicted"), scoring.weak_evidence_cap(F.col("_top.p"), F.col("_direct")).alias("confidence"),
                      scoring.prediction_set(F.col("probs"), F.col("_qhat")).alias("pred_set"), F.lit("model").alias("basis"))
    settled = marked.where(F.col("_gate").isNotNull()).select("person", "w", F.col("_gate").alias("predicted"), F.lit(1.0).alias("confidence"), F.array("_gate").alias("pred_set"), F.lit("fact").alias("basis"))
    both = hysteresis(base.unionByName(settled), ["person"])
    return both.withColumn("smoothed", scoring.abstain(F.col("published"), F.col("confidence"), F.col("pred_set"), threshold)).drop("published")


def scoring_chain(rows: DataFrame, matrices: DataFrame, hazards: DataFrame, overrides: DataFrame, now: Column, threshold: float = scoring.ABSTAIN_AT) -> DataFrame:
    """ML-36: one row per published window through every stage of scoring.

    rows: (person, w, part, gate, presence, direct, probs, fired, child, qhat), with probabilities that
    are calibrated and aliased; child: node → its own probabilities; qhat: node → threshold.
    Order: gate or presence mask, transition and duration prior, markers, coarse to fine, evidence cap,
    prediction set, hysteresis, abstention, override.
    """
    from ..functions.cols import ranked_entries
    from .chains import filtered_states
    from .runs import hysteresis

    masked = rows.withColumn("probs", scoring.presence_gate(F.col("probs"), F.col("presence")))
    coarse = filtered_states(masked, matrices, hazards)
    j = coarse.join(rows.select("person", "w", "gate", "direct", "child", "qhat"), ["person", "w"])
    fine = F.when(F.col("gate").isNull(), F.element_at("child", F.col("coarse")))
    top = ranked_entries(fine)[0]
    node = F.when(fine.isNotNull(), F.col("coarse")).otherwise("root")
    used = F.coalesce(fine, F.col("probs"))
    conf = F.when(F.col("gate").isNotNull(), 1.0).otherwise(scoring.weak_evidence_cap(F.when(fine.isNotNull(), top["p"]).otherwise(F.col("coarse_confidence")), F.col("direct")))
    sets = F.when(F.col("gate").isNotNull(), F.array("gate")).otherwise(scoring.prediction_set(used, F.element_at("qhat", node)))
    base = j.select(
        "person", "w", "gate", F.coalesce(top["k"], F.col("coarse")).alias("predicted"), conf.alias("confidence"), sets.alias("pred_set"),
        F.when(top["k"] != F.col("coarse"), F.col("coarse")).alias("parent"), F.when(fine.isNotNull(), F.col("coarse_confidence")).alias("coarse_confidence"),
        F.when(F.col("gate").isNotNull(), "fact").otherwise("model").alias("model_version"),
    )
    published = hysteresis(base, ["person"], force=F.col("gate").isNotNull())
    smoothed = F.when(F.col("gate").isNotNull(), F.col("published")).otherwise(scoring.abstain(F.col("published"), F.col("confidence"), F.col("pred_set"), threshold))
    return scoring.pin_overrides(published.withColumn("smoothed", smoothed), overrides, ["person", "w"], now).drop("gate", "published")


def what_if(model: ClassModel, rows: DataFrame, edits: dict[str, float]) -> DataFrame:
    """ML-44: the rows rescored with some features replaced."""
    edited = rows.drop("features").withColumns({k: F.lit(float(v)) for k, v in edits.items()})
    return model.score(align(edited, model.columns))
