"""Multiclass gradient boosting from distributed gradient histograms.

All classes share one softmax: a round fits one small regression tree for each class to the difference
of label and probability. Columns are cut into bins once. For a level of the trees every task adds up
gradients, curvatures and weights of its rows by class, node, column and bin; the sums are what travels to the task
that picks the split of a node, and their number depends on the trees, not on the rows. The leaves follow from the sums of the last level, so a
round takes `maxDepth` passes. Scores are written every `keep` rounds, so a pass adds few trees to them.
A table counted to have at most `fewRows` rows is not worth passes: one task does all rounds, by the same functions.

Estimator and model are stages of a pipeline and can be saved and loaded; the trees are a parameter of the model.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasProbabilityCol, HasStepSize, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Smallest gain of a split, as a share of the node's sum of squares.
LEAST_GAIN = 1e-10


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def leaf_of(tree: list[dict], x: np.ndarray, binned: bool) -> np.ndarray:
    """Node number a row ends in. A node has column, edge (value) and bin, and children left and left + 1; a leaf has a value."""
    at, going = np.zeros(len(x), int), np.arange(len(x))
    while len(going):
        here = at[going]
        inner = np.array([("left" in n) for n in tree])[here]
        going, here = going[inner], here[inner]
        for node in np.unique(here).tolist():
            rows, n = going[here == node], tree[node]
            at[rows] = n["left"] + (x[rows, n["column"]] > n["bin" if binned else "edge"])
    return at


def add_trees(scores: np.ndarray, x: np.ndarray, rounds: list[list[list[dict]]], binned: bool) -> np.ndarray:
    for trees in rounds:
        for k, tree in enumerate(trees):
            values = np.array([n.get("value", 0.0) for n in tree])
            scores[:, k] += values[leaf_of(tree, x, binned)]
    return scores


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1) if len(column) else np.zeros((0, 1), kind)


class SoftmaxBooster(Estimator, HasFeaturesCol, HasLabelCol, HasWeightCol, HasMaxIter, HasStepSize, DefaultParamsReadable, DefaultParamsWritable):
    """ML-02. labelCol: class numbers 0 … numClasses − 1."""

    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits of a tree", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a column", TypeConverters.toInt)
    numClasses = Param(Params._dummy(), "numClasses", "number of classes", TypeConverters.toInt)
    keep = Param(Params._dummy(), "keep", "rounds between written scores", TypeConverters.toInt)
    fewRows = Param(Params._dummy(), "fewRows", "rows up to which one task does all rounds", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, numClasses=2, maxIter=200, stepSize=0.05, maxDepth=3, maxBins=32, keep=25, fewRows=20_000, featuresCol="features", labelCol="label", weightCol=None):
        super().__init__()
        self._setDefault(numClasses=2, maxIter=200, stepSize=0.05, maxDepth=3, maxBins=32, keep=25, fewRows=20_000, featuresCol="features", labelCol="label")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def setFeaturesCol(self, value):
        return self._set(featuresCol=value)

    def _fit(self, dataset: DataFrame) -> SoftmaxBoosterModel:
        get = self.getOrDefault
        classes, depth, rate = get("numClasses"), get("maxDepth"), get("stepSize")
        weight = F.col(get("weightCol")).cast("double") if self.isDefined("weightCol") else F.lit(1.0)
        rows = materialise(dataset.select(vector_to_array(F.col(get("featuresCol"))).alias("x"), F.col(get("labelCol")).cast("int").alias("y"), weight.alias("w")), "boosting-rows")
        held = {r.y: r.w for r in rows.groupBy("y").agg(F.sum("w").alias("w")).collect()}
        total = sum(held.values()) or 1.0
        start = [float(np.log(max(held.get(k, 0.0) / total, 1e-15))) for k in range(classes)]
        first = rows.select(F.size("x").alias("n")).first()
        width = first.n if first else 0
        edges = self._edges(rows, width, get("maxBins"))
        cut = F.arrow_udf(lambda c: _bins(c, edges), "array<int>")
        now = materialise(rows.select(cut(F.col("x")).alias("x"), "y", "w", F.array(*map(F.lit, start)).alias("scores")), "boosting-bins")
        rounds: list[list[list[dict]]] = []
        fresh: list[list[list[dict]]] = []
        turns = get("maxIter") if width and total else 0
        if turns and now.limit(get("fewRows") + 1).count() <= get("fewRows"):
            one = now.groupBy().applyInArrow(_whole(classes, depth, turns, rate, edges), "trees string")
            rounds, turns = json.loads(one.first().trees), 0
        for _ in range(turns):
            trees: list[list[dict]] = [[{}] for _ in range(classes)]
            for level in range(depth):
                sums = now.mapInArrow(_histograms(fresh, trees, level), "k int, node int, col int, bin int, g double, h double, n double")
                if not split_nodes(trees, node_splits(sums, width), edges, rate, level == depth - 1):
                    break
            rounds.append(trees)
            fresh.append(trees)
            if len(fresh) == get("keep"):
                now = materialise(now.mapInArrow(_moved(fresh), now.schema), "boosting-scores")
                fresh = []
        model = SoftmaxBoosterModel(start=json.dumps(start), trees=json.dumps(rounds), featuresCol=get("featuresCol"))
        return self._copyValues(model)

    @staticmethod
    def _edges(rows: DataFrame, width: int, bins: int) -> list[list[float]]:
        """Upper bounds of the bins: columns times bins numbers reach the driver."""
        named = rows.select(*[F.col("x")[i].alias(f"c{i}") for i in range(width)])
        got = named.approxQuantile(named.columns, [j / bins for j in range(1, bins)], 0.001) if width else []
        return [sorted(set(q)) for q in got]


def _bins(column: pa.Array, edges: list[list[float]]) -> pa.Array:
    x = _matrix(column, float)
    out = np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], 1) if len(x) else np.zeros((0, 1))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel().astype(np.int32)))


def level_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, scores: np.ndarray, trees: list[list[dict]], level: int) -> dict[tuple[int, int], np.ndarray]:
    """Gradients, curvatures and weights by (class, open node): an array (3, columns, 256 bins)."""
    sums, p, width = {}, softmax(scores), x.shape[1]
    for k, tree in enumerate(trees):
        r = (y == k) - p[:, k]
        at = leaf_of(tree, x, True)
        for node in np.unique(at).tolist():
            if "open" in tree[node] or level == 0:
                own = np.flatnonzero(at == node)
                place = (x[own] + np.arange(width) * 256).ravel()
                parts = [np.bincount(place, np.repeat(v[own], width), width * 256) for v in (w * r, w * np.abs(r) * (1 - np.abs(r)), w)]
                sums[k, node] = np.stack(parts).reshape(3, width, 256)
    return sums


def _histograms(fresh, trees, level: int):
    """The sums of a task as rows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            x, scores = _matrix(batch.column(0), int), _matrix(batch.column(3), float).copy()
            for at, part in level_sums(x, batch.column(1).to_numpy(), batch.column(2).to_numpy(), add_trees(scores, x, fresh, True), trees, level).items():
                sums[at] = sums.get(at, 0) + part
        parts = []
        for (k, node), part in sorted(sums.items()):
            col, at = np.nonzero(part[2])
            parts.append([np.full(len(col), k), np.full(len(col), node), col, at, *part[:, col, at]])
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0)] * 7
        kinds = [pa.int32()] * 4 + [pa.float64()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t, safe=False) for c, t in zip(columns, kinds)], names=["k", "node", "col", "bin", "g", "h", "n"])

    return rows


#: Columns of the best split of a node: column and bin, its gain, the sums of the node and those left of the split.
SPLIT = "k int, node int, col int, bin int, gain double, g double, h double, n double, gl double, hl double"


def best_split(part: np.ndarray) -> tuple:
    """(column, bin, gain, gradient, curvature and weight of the node, gradient and curvature left of the split)."""
    g, h, n = part[:, 0].sum(axis=1)
    left = part.cumsum(axis=2)
    # a split lies after a bin with rows, but for the last such bin
    held = part[2] > 0
    open_ = held & (np.cumsum(held[:, ::-1], axis=1)[:, ::-1] > 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[0] ** 2 / left[2] + (g - left[0]) ** 2 / (n - left[2]) - g**2 / n
    gain = np.where(open_, np.round(gain, 10), -np.inf)
    col, at = np.unravel_index(int(gain.argmax()), gain.shape)
    return int(col), int(at), gain[col, at], g, h, n, *left[:2, col, at]


def node_splits(sums: DataFrame, width: int) -> dict[tuple[int, int], tuple]:
    """The best split of every open node over all tasks, found by one task a node: a row a node reaches the driver."""

    def best(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part = np.zeros((3, width, 256))
        part[:, table["col"].to_numpy(), table["bin"].to_numpy()] = [table[c].to_numpy() for c in ("g", "h", "n")]
        names = [c.split()[0] for c in SPLIT.split(", ")]
        kinds = [pa.int32() if c.endswith("int") else pa.float64() for c in SPLIT.split(", ")]
        row = [key[0].as_py(), key[1].as_py(), *best_split(part)]
        return pa.table([pa.array([v], t) for v, t in zip(row, kinds)], names=names)

    whole = sums.groupBy("k", "node", "col", "bin").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])
    return {(r.k, r.node): tuple(r)[2:] for r in whole.groupBy("k", "node").applyInArrow(best, SPLIT).collect()}


def split_nodes(trees: list[list[dict]], found: dict[tuple[int, int], tuple], edges: list[list[float]], rate: float, last: bool) -> bool:
    """Splits the open nodes by their best splits over all rows; True if a node stays open for the next level."""
    classes, more = len(trees), False

    def value(g: float, h: float) -> float:
        return float(rate * (classes - 1) / classes * g / h) if abs(h) > 1e-150 else 0.0

    for (k, node), (col, at, gain, g, h, n, gl, hl) in sorted(found.items()):
        tree = trees[k]
        tree[node].pop("open", None)
        if gain <= LEAST_GAIN * n:
            tree[node]["value"] = value(g, h)
            continue
        tree[node] |= {"column": col, "bin": at, "edge": edges[col][at], "left": len(tree)}
        for side in ((gl, hl), (g - gl, h - hl)):
            tree.append({"value": value(*side)} if last else {"value": value(*side), "open": True})
            more |= not last
    return more


def _whole(classes: int, depth: int, turns: int, rate: float, edges: list[list[float]]):
    """All rounds over one table of few rows, by the same sums and splits."""

    def rows(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        x, scores = (_matrix(table.column(c).combine_chunks(), t) for c, t in (("x", int), ("scores", float)))
        y, w, rounds = table.column("y").to_numpy(), table.column("w").to_numpy(), []
        for _ in range(turns):
            trees: list[list[dict]] = [[{}] for _ in range(classes)]
            for level in range(depth):
                found = {at: best_split(part) for at, part in level_sums(x, y, w, scores, trees, level).items()}
                if not split_nodes(trees, found, edges, rate, level == depth - 1):
                    break
            rounds.append(trees)
            scores = add_trees(scores.copy(), x, [trees], True)
        return pa.table({"trees": [json.dumps(rounds)]})

    return rows


def _moved(fresh):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = add_trees(_matrix(batch.column(3), float).copy(), _matrix(batch.column(0), int), fresh, True)
            scores = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * s.shape[1]), pa.array(s.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], scores], names=["x", "y", "w", "scores"])

    return rows


class SoftmaxBoosterModel(Model, HasFeaturesCol, HasProbabilityCol, DefaultParamsReadable, DefaultParamsWritable):
    start = Param(Params._dummy(), "start", "scores before the first round, as JSON", TypeConverters.toString)
    trees = Param(Params._dummy(), "trees", "trees by round and class, as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, start="[]", trees="[]", featuresCol="features", probabilityCol="probability"):
        super().__init__()
        self._setDefault(start="[]", trees="[]", featuresCol="features", probabilityCol="probability")
        self._set(**self._input_kwargs)

    def rounds(self) -> list[list[list[dict]]]:
        return json.loads(self.getOrDefault("trees"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        start, rounds = json.loads(self.getOrDefault("start")), self.rounds()

        def score(column: pa.Array) -> pa.Array:
            x = _matrix(column, float)
            p = softmax(add_trees(np.tile(start, (len(x), 1)), x, rounds, False))
            return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(start)), pa.array(p.ravel()))

        probs = F.arrow_udf(score, "array<double>")(vector_to_array(F.col(self.getFeaturesCol())))
        return dataset.withColumn(self.getProbabilityCol(), array_to_vector(probs))
