"""Language identification: averaged hashed subword embeddings and a linear softmax.

Subwords are byte 3-grams and 4-grams, white space folded to one blank. Embeddings and softmax are
trained by stochastic gradient descent in numpy on a bounded sample: about PER_LANGUAGE documents
of each language by smallest id hash, MOST_ROWS at most. A fifth of the sample calibrates a temperature and the
score below which a prediction is rejected. At scoring, embedding times softmax is one small table,
so a text costs a gather and a sum.

Cases: null text or text without a letter is `und` with score 0; shorter than a subword counts as
padded by blanks; null languages are not learned; without any learned language all is `und`; rows
with equal ids are scored each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

PER_LANGUAGE = 1_500
MOST_ROWS = 12_000
BITS = 16
DIMS = 16
RUN = 2 << 20


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    floor: float  # scores below are rejected


def subwords(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row offsets) of the subwords of a run; rows are padded by a blank on either side."""
    n = len(offs) - 1
    padded = offs + 3 * np.arange(n + 1)
    wide = np.full(padded[-1] + 1, 32, np.uint8)
    wide[np.arange(len(data)) + 3 * np.repeat(np.arange(n), np.diff(offs)) + 1] = np.where(T.SPACE[data], 32, data)
    w = wide.astype(np.uint32)
    # each padded row of length L gives L - 2 places; a 4-gram may take in a blank of the pad
    three = w[:-2] | w[1:-1] << np.uint32(8) | w[2:] << np.uint32(16)
    four = three[: len(three) - 1] | w[3:] << np.uint32(24)
    at = np.ones(len(w), bool)
    at[padded[1:] - 1] = False
    at[padded[1:] - 2] = False
    at[-1] = False
    at = np.flatnonzero(at)
    keys = np.empty((len(at), 2), np.uint32)
    keys[:, 0] = three[at] * np.uint32(0x9E3779B1)
    keys[:, 1] = four[np.minimum(at, len(four) - 1)] * np.uint32(0x85EBCA6B) ^ np.uint32(0x27D4EB2F)
    keys ^= keys >> np.uint32(15)
    keys *= np.uint32(0x2C1B3C6D)
    return (keys >> np.uint32(32 - BITS)).ravel().astype(np.int64), 2 * (padded - 2 * np.arange(n + 1))


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data, offs in T.runs(batch.column(2), RUN):
            n = len(offs) - 1
            bucket, bounds = subwords(data, offs)
            row = np.repeat(np.arange(n), np.diff(bounds))
            pair, count = np.unique(row << BITS | bucket, return_counts=True)
            row, bucket = pair >> BITS, pair & ((1 << BITS) - 1)
            total = np.maximum(np.bincount(row, weights=count, minlength=n), 1)
            at = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.ListArray.from_arrays(at, pa.array(bucket.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array((count / total[row]).astype(np.float32)))],
                names=["place", "lang", "bucket", "x"],
            )


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(labels: np.ndarray, n_labels: int, rows: list[tuple[np.ndarray, np.ndarray]], epochs: int = 4, rate: float = 8.0) -> tuple[np.ndarray, np.ndarray, float, float]:
    """table, bias, temperature, floor."""
    rng = np.random.Generator(np.random.PCG64(7))
    embed = rng.normal(0, 0.1, (1 << BITS, DIMS)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (DIMS, n_labels)).astype(np.float32), np.zeros(n_labels, np.float32)
    learn, check = [i for i in range(len(rows)) if i % 5], [i for i in range(len(rows)) if i % 5 == 0]
    learn = learn or check
    for epoch in range(epochs):
        for k, i in enumerate(rng.permutation(learn)):
            step = rate * (1 - (epoch + k / len(learn)) / epochs)
            bucket, x = rows[i]
            mean = x @ embed[bucket]
            gap = _softmax(mean @ out + bias)
            gap[labels[i]] -= 1
            back = out @ gap
            out -= 0.1 * step * np.outer(mean, gap)
            bias -= 0.01 * step * gap
            embed[bucket] -= step * x[:, None] * back
    table = embed @ out
    z = np.array([x @ table[b] + bias for b, x in (rows[i] for i in check)])
    want = labels[check]

    def loss(t):
        return -np.log(np.maximum(_softmax(z / t)[np.arange(len(want)), want], 1e-12)).mean()

    temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0), key=loss)
    p = _softmax(z / temperature)
    right = np.sort(p.max(1)[p.argmax(1) == want])
    # 99 of 100 right predictions are accepted
    return table, bias, temperature, float(right[len(right) // 100]) if len(right) else 0.0


def train(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS) -> Model | None:
    known = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang")).where(learn & F.col("lang").isNotNull())
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    place = F.xxhash64("doc_id")
    share = F.pmod(place, F.lit(1_000_003)) / 1_000_003.0
    picked = known.join(sizes, "lang").where(share * F.col("n") < per_language).select("doc_id", place.alias("place"), "lang").orderBy("place", "doc_id").limit(most_rows).dropDuplicates(["doc_id"])
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")).where(F.col("text").isNotNull())
    # most_rows narrow rows at most
    found = texts.join(F.broadcast(picked), "doc_id").select("place", "lang", "text").mapInArrow(_training_rows, "place long, lang string, bucket array<int>, x array<float>")

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        names = sorted(set(table["lang"].to_pylist()))
        labels = np.array([names.index(v) for v in table["lang"].to_pylist()])
        rows = [(b.values.to_numpy(), x.values.to_numpy()) for b, x in zip(table["bucket"], table["x"])]
        grid, bias, temperature, floor = fit(labels, len(names), rows)
        return pa.table({"languages": [names], "grid": [grid.astype(np.float32).tobytes()], "bias": [bias.tobytes()], "temperature": [temperature], "floor": [floor]})

    # one task, bounded by most_rows
    got = found.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(one, "languages array<string>, grid binary, bias binary, temperature double, floor double").first()
    if got is None:
        return None
    n = len(got["languages"])
    return Model(got["languages"], np.frombuffer(got["grid"], np.float32).reshape(-1, n), np.frombuffer(got["bias"], np.float32), got["temperature"], got["floor"])


def predict(text: Column, model: Model | None) -> Column:
    """Struct lang_pred, score, accepted."""
    nothing = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    if model is None:
        return nothing

    def rows(column: pa.Array) -> pa.Array:
        best, p = np.zeros(len(column), np.int64), np.zeros(len(column))
        for first, data, offs in T.runs(column, RUN):
            n = len(offs) - 1
            bucket, bounds = subwords(data, offs)
            size = np.maximum(np.diff(bounds), 1)
            row = np.repeat(np.arange(n), np.diff(bounds))
            z = np.stack([np.bincount(row, weights=model.table[bucket, k], minlength=n) for k in range(len(model.languages))], 1) / size[:, None]
            chance = _softmax((z + model.bias) / model.temperature)
            best[first : first + n], p[first : first + n] = chance.argmax(1), chance.max(1)
        return pa.StructArray.from_arrays([pa.array(model.languages).take(pa.array(best)), pa.array(p), pa.array(p >= model.floor)], names=["lang_pred", "score", "accepted"])

    got = F.arrow_udf(rows, "lang_pred string, score double, accepted boolean")(text.cast("binary"))
    return F.when(F.coalesce(F.regexp_like(text, F.lit("\\p{L}")), F.lit(False)), got).otherwise(nothing)
