"""Quality classifier: hashed word n-gram logistic regression, trained by follow the regularised leader.

Features are hashed words, hashed neighbour pairs (coded by the difference of their hashes, so a
repeated word gives one and the same feature) and the byte classes of word ends. The model is fitted
in one task on a bounded sample: the MOST_ROWS labelled documents with the smallest id hash. Scores
are sparse dot products, a gather and a sum per document, over every whole text.

Cases: null and empty texts have no features and score the bias; null labels and labels of other
documents are ignored; a document labelled twice counts once, by its largest label; without both
labels the bias alone is fitted; rows with equal ids are scored each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

MOST_ROWS = 8_000
BITS = 18
SCALE = 8.0

#: Byte classes of word ends: a small letter or byte beyond ASCII, A capital, 0 digit, else itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every feature of a run."""
    starts, ends, row = T.words(data, offs)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = T.hashes(data, starts, ends)
    near = row[1:] == row[:-1]
    pairs = T.mix(h[1:] - h[:-1] + np.uint64(1))[near]
    shape = T.hashes(_SHAPE[data], np.maximum(starts, ends - 3), ends) ^ np.uint64(0x5851F42D4C957F2D)
    keys = np.concatenate((h, pairs, T.mix(shape)))
    return (keys >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate((row, row[1:][near], row))


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """order, label, distinct buckets and their weights of every labelled text."""
    for batch in batches:
        for first, data, offs in T.runs(batch.column(2)):
            n = len(offs) - 1
            bucket, row = features(data, offs)
            pair, count = np.unique(row << BITS | bucket, return_counts=True)
            bucket, row = pair & ((1 << BITS) - 1), pair >> BITS
            total = np.maximum(np.bincount(row, weights=count, minlength=n), 1)
            bounds = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
            x = (SCALE * count / total[row]).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.ListArray.from_arrays(bounds, pa.array(bucket.astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(x))],
                names=["place", "label", "bucket", "x"],
            )


def ftrl(rows: list[tuple[float, np.ndarray, np.ndarray]], epochs: int = 3, alpha: float = 0.5, beta: float = 0.1, l1: float = 0.001, l2: float = 0.0) -> np.ndarray:
    """Weights of FTRL-proximal logistic regression; the last one is the bias."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at):
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for label, bucket, x in rows:
            at, x = np.append(bucket, 1 << BITS), np.append(x, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(np.arange((1 << BITS) + 1)).astype(np.float32)


def _fit(table: pa.Table) -> pa.Table:
    table = table.sort_by("place")
    rows = [(float(y), np.asarray(b), np.asarray(x)) for y, b, x in zip(table["label"].to_pylist(), (v.values.to_numpy() for v in table["bucket"]), (v.values.to_numpy() for v in table["x"]))]
    return pa.table({"weights": [ftrl(rows).tobytes()]})


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", doc_id: str = "doc_id", text: str = "text", most_rows: int = MOST_ROWS) -> np.ndarray:
    """Weights fitted on at most most_rows labelled documents for which `learn` (of doc_id) holds."""
    known = (
        labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("double").alias("label"))
        .where(learn & F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .withColumn("place", F.xxhash64("doc_id"))
        .orderBy("place", "doc_id").limit(most_rows)
    )
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    # most_rows narrow rows at most
    found = texts.join(F.broadcast(known), "doc_id").select("place", "label", "text").mapInArrow(_training_rows, "place long, label double, bucket array<int>, x array<float>")
    # one task, bounded by most_rows
    got = found.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_fit, "weights binary").first()
    return np.frombuffer(got[0], np.float32) if got else np.zeros((1 << BITS) + 1, np.float32)


def score(text: Column, weights: np.ndarray) -> Column:
    def rows(column: pa.Array) -> pa.Array:
        out = np.zeros(len(column))
        for first, data, offs in T.runs(column):
            n = len(offs) - 1
            bucket, row = features(data, offs)
            dot = np.bincount(row, weights=weights[bucket], minlength=n)
            out[first : first + n] = SCALE * dot / np.maximum(np.bincount(row, minlength=n), 1)
        return pa.array(1 / (1 + np.exp(-np.clip(out + float(weights[-1]), -30, 30))))

    return F.arrow_udf(rows, "double")(F.coalesce(text, F.lit("")).cast("binary"))
