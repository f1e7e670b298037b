"""Row attribution from the paths that rows take through a forest.

The nodes of a fitted forest are a table. Along its path a row's class probability changes from node to
node, and each change is owed to the column that the node splits on. Summed over the trees the
changes of a row are its probability less the mean one of the roots, so attributions add up; a row
costs one walk through each tree and no further scoring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, scratch_path
from . import forest, stats


class Nodes:
    """Trees as arrays: the split column of a node (−1 in leaves), threshold, children and class shares."""

    def __init__(self, tree, node, feature, threshold, left, right, share):
        order = np.lexsort((node, tree))
        tree, node, self.feature, self.threshold, left, right, self.share = (v[order] for v in (tree, node, feature, threshold, left, right, share))
        starts = np.flatnonzero(np.append(True, tree[1:] != tree[:-1]))
        base = np.repeat(starts, np.diff(np.append(starts, len(tree))))
        # nodes of a tree are numbered from 0 without holes
        self.roots, self.left, self.right = starts, base + left, base + right
        self.leaf = self.feature < 0

    def contributions(self, x: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, columns) changes of the probability of each row's class, and the mean of the roots."""
        out, n = np.zeros(x.shape), np.arange(len(x))
        for root in self.roots.tolist():
            at = np.full(len(x), root)
            going = np.flatnonzero(~self.leaf[at])
            while len(going):
                here = at[going]
                column = self.feature[here]
                after = np.where(x[going, column] <= self.threshold[here], self.left[here], self.right[here])
                np.add.at(out, (going, column), self.share[after, label[going]] - self.share[here, label[going]])
                at[going] = after
                going = going[~self.leaf[after]]
        return out / len(self.roots), self.share[self.roots].mean(0)[label[n]]


def node_table(model, spark) -> Nodes:
    """The nodes of the forest inside a fitted classifier. Its size is that of the model, which Spark also sends to every task."""
    parts, before = [], 0
    for forest in model.forests():
        path = scratch_path(spark, "forest")
        forest.write().save(path)
        stored = spark.read.parquet(f"{path}/data")
        flat = stored.select("treeID", "nodeData.*") if "nodeData" in stored.columns else stored
        part = flat.select("treeID", "id", "split.featureIndex", F.get("split.leftCategoriesOrThreshold", 0).alias("threshold"), "leftChild", "rightChild", "impurityStats").toPandas()
        parts.append(part.assign(treeID=part["treeID"] + before))
        before += forest.getNumTrees
    pdf = pd.concat(parts, ignore_index=True)
    stat = np.stack(pdf["impurityStats"].to_numpy()).astype(float)
    inner = pdf["leftChild"].to_numpy() >= 0
    whole = lambda c: np.where(inner, pdf[c].to_numpy(), -1).astype(int)
    return Nodes(pdf["treeID"].to_numpy(), pdf["id"].to_numpy(), whole("featureIndex"), pdf["threshold"].fillna(0).to_numpy(float), whole("leftChild"), whole("rightChild"), stat / stat.sum(1, keepdims=True))


def path_attribution(model, rows: DataFrame, key: str) -> DataFrame:
    """ML-19: (key, predicted, confidence, base, weights): what each column adds to the probability of the predicted class.

    weights: one number for each column of the model, in order; base + sum(weights) = confidence.
    """
    if model.grown():
        return _grown_attribution(model, rows, key)
    spark = rows.sparkSession
    nodes = spark.sparkContext.broadcast(node_table(model, spark))
    scored = stats.with_prediction(model.score(rows), model.classes)
    place = F.create_map(*[F.lit(v) for i, c in enumerate(model.classes) for v in (c, i)])[F.col("predicted")]
    asked = scored.select(F.col(key).cast("long").alias(key), "predicted", F.col("conf").alias("confidence"), place.cast("int").alias("_c"), vector_to_array("features").alias("_x"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            got, base = nodes.value.contributions(x, batch.column(3).to_numpy())
            weights = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(got.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(base), weights], names=[key, "predicted", "confidence", "base", "weights"])

    return asked.mapInArrow(walk, f"`{key}` long, predicted string, confidence double, base double, weights array<double>")


def _grown_attribution(model, rows: DataFrame, key: str) -> DataFrame:
    """The same over a grown forest: its trees meet the rows in tasks, no table of nodes is sent."""
    grown = model.grown()
    n, trees = grown.width(), grown.getOrDefault("numTrees")
    scored = stats.with_prediction(model.score(rows), model.classes)
    place = F.create_map(*[F.lit(v) for i, c in enumerate(model.classes) for v in (c, i)])[F.col("predicted")]
    asked = materialise(scored.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("_key"), "predicted", F.col("conf").alias("confidence"), place.cast("int").alias("label"), grown.codes().alias("codes")), "attribution-rows")
    got = forest.over_trees([grown], asked, forest.paths, n + 1, "label")
    weights = F.transform(F.slice("v", 1, n), lambda v: v / trees)
    return asked.join(got, "row").select(F.col("_key").alias(key), "predicted", "confidence", (F.element_at("v", -1) / trees).alias("base"), weights.alias("weights"))


def strongest(attributed: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """The k columns that moved a row's prediction most, as (…, rank, feature, weight)."""
    named = F.transform("weights", lambda w, i: F.struct((-F.abs(w)).alias("o"), F.element_at(F.array(*map(F.lit, columns)), i + 1).alias("feature"), w.alias("weight")))
    top = F.slice(F.array_sort(named), 1, k)
    return attributed.select(*[c for c in attributed.columns if c != "weights"], F.posexplode(top).alias("rank", "e")).withColumn("rank", F.col("rank") + 1).select("*", "e.feature", "e.weight").drop("e")
