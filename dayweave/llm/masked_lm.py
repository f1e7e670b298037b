"""Document scores by masked pseudo-likelihood: every token is predicted from both sides.

The vocabulary holds the KNOWN most frequent words of all documents; other words share hashed
ids. A small window network (position-weighted embeddings of the REACH words on either side, one
tanh layer, class-factored softmax) gives each token a conditional probability; a score is the sum of
their logarithms. Every document is learned from: they are dealt to ROUNDS rounds by a hash, in a round every input partition fits a
copy on its documents, and the copies are averaged weighted by tokens; a model has a fixed size.

Cases: null and wordless texts have no tokens, sum 0 and a null mean; long texts are scored whole, in
blocks; rows with equal ids are scored each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import materialise

CLASSES = 64
VOCAB = CLASSES * CLASSES
KNOWN = VOCAB - 1024
REACH = 3
DIMS = 24
HIDDEN = 32
ROUNDS = 2
STEP = 4096
#: Exponents that far apart still add up in four bytes.
SPAN = 80

SHAPES = {"embed": (VOCAB + 1, DIMS), "place": (2 * REACH, DIMS), "mix": (DIMS, HIDDEN), "mix_bias": (HIDDEN,), "group": (HIDDEN, CLASSES), "group_bias": (CLASSES,), "word": (CLASSES, HIDDEN, CLASSES), "word_bias": (CLASSES, CLASSES)}


def start_model() -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(11))
    parts = [np.zeros(s) if name.endswith("bias") else np.ones(s) if name == "place" else rng.normal(0, 0.1, s) for name, s in SHAPES.items()]
    return np.concatenate([p.ravel() for p in parts]).astype(np.float32)


def opened(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Named views into one flat vector of weights."""
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, data, offs in T.runs(batch.column(0)):
            starts, ends, _ = T.words(data, offs)
            h, n = np.unique(T.hashes(data, starts, ends), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])


def vocabulary(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Sorted hashes of the KNOWN most frequent words, counted over all documents."""
    raw = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")).mapInArrow(_count_words, "word long, n long")
    counts = materialise(raw.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    # at most 64 rows: how many words have counts of each power of two; rarer words never travel
    sizes = sorted(counts.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True)
    power, seen = 0, 0
    for r in sizes:
        power, seen = r["power"], seen + r["words"]
        if seen >= KNOWN:
            break
    top = counts.where(F.col("n") >= 2**power).orderBy(F.desc("n"), "word").limit(KNOWN).select("word").toArrow()
    return np.sort(top["word"].to_numpy().view(np.uint64))


def token_ids(data: np.ndarray, offs: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, row) of every word. Known words have ids below KNOWN, the rest share hashed ids; VOCAB pads."""
    starts, ends, row = T.words(data, offs)
    h = T.hashes(data, starts, ends)
    if not len(known):
        return (KNOWN + (h % np.uint64(VOCAB - KNOWN)).astype(np.int64)), row
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at, KNOWN + (h % np.uint64(VOCAB - KNOWN)).astype(np.int64)), row


def contexts(ids: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Ids of the REACH words before and after every token of the same row."""
    out = np.full((len(ids), 2 * REACH), VOCAB, np.int64)
    for k in range(1, min(REACH, len(ids) - 1) + 1):
        near = row[k:] == row[:-k]
        out[k:, REACH - k] = np.where(near, ids[:-k], VOCAB)
        out[:-k, REACH + k - 1] = np.where(near, ids[k:], VOCAB)
    return out


def _lower(z: np.ndarray) -> None:
    """Takes from each row what keeps its exponents finite; one top does for all rows unless their exponents could vanish."""
    z -= z.max(1, keepdims=True) if len(z) and z.max() - z.min() > SPAN else z.max(initial=-np.inf)


def _row_sums(z: np.ndarray) -> np.ndarray:
    return z @ np.ones(z.shape[1], z.dtype)


def _sums(z: np.ndarray) -> np.ndarray:
    return np.ones(len(z), z.dtype) @ z


def _log_pick(z: np.ndarray, want: np.ndarray) -> np.ndarray:
    """The log-softmax of one column in every row; z is used up."""
    _lower(z)
    picked = z[np.arange(len(z)), want]
    return picked - np.log(_row_sums(np.exp(z, out=z)))


def log_chances(m: dict, ids: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Log-probability of every token given both sides, its class first and then the word in it."""
    out = np.empty(len(ids))
    # what a word adds to the hidden layer at every place of the window
    adds = [(m["embed"] * m["place"][k]) @ m["mix"] for k in range(2 * REACH)]
    words = _with_bias(m)
    for at in range(0, len(ids), 4 * STEP):
        part = slice(at, at + 4 * STEP)
        want, near = ids[part], around[part]
        hidden = adds[0].take(near[:, 0], 0)
        for k in range(1, 2 * REACH):
            hidden += adds[k].take(near[:, k], 0)
        hidden += m["mix_bias"]
        np.tanh(hidden, out=hidden)
        # ids are dealt to classes by remainder, so frequent words spread over all of them
        group, word = want % CLASSES, want // CLASSES
        got = _log_pick(hidden @ m["group"] + m["group_bias"], group).astype(float)
        order, held = _by_class(group)
        mine, z = _with_one(hidden.take(order, 0)), np.empty((len(want), CLASSES), np.float32)
        for g, own in held:
            np.matmul(mine[own], words[g], out=z[own])
        got[order] += _log_pick(z, word[order])
        out[part] = got
    return out


def _with_one(hidden: np.ndarray) -> np.ndarray:
    """hidden with a column of ones, which meets the biases."""
    return np.concatenate([hidden, np.ones((len(hidden), 1), hidden.dtype)], axis=1)


def _with_bias(m: dict) -> np.ndarray:
    return np.concatenate([m["word"], m["word_bias"][:, None]], axis=1)


def _by_class(group: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order in which the rows of a class lie side by side, and where those of each class lie."""
    order = np.argsort(group.astype(np.uint8), kind="stable")
    bounds = np.searchsorted(group[order], np.arange(CLASSES + 1)).tolist()
    return order, [(g, slice(lo, hi)) for g, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])) if lo < hi]


def _gaps(z: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Softmax of every row less one in the wanted column, in place."""
    _lower(z)
    np.exp(z, out=z)
    z /= _row_sums(z)[:, None]
    z[np.arange(len(z)), want] -= 1
    return z


def _adagrad(w: np.ndarray, total: np.ndarray, g: np.ndarray, n: int, rate: float) -> None:
    g = g / n
    square = g * g
    total += square
    np.add(total, 1e-8, out=square)
    np.sqrt(square, out=square)
    g *= rate
    g /= square
    w -= g


def learn(m: dict, ids: np.ndarray, around: np.ndarray, sums: dict, rate: float) -> None:
    """One pass of Adagrad steps over the tokens, STEP at a time."""
    for at in range(0, len(ids), STEP):
        want, near = ids[at : at + STEP], around[at : at + STEP]
        total = (m["embed"] * m["place"][0]).take(near[:, 0], 0)
        for k in range(1, 2 * REACH):
            total += (m["embed"] * m["place"][k]).take(near[:, k], 0)
        hidden = np.tanh(total @ m["mix"] + m["mix_bias"])
        group, word = want % CLASSES, want // CLASSES
        gap = _gaps(hidden @ m["group"] + m["group_bias"], group)
        back = gap @ m["group"].T
        grads = {"group": hidden.T @ gap, "group_bias": _sums(gap)}
        # only the products are taken class by class
        order, held = _by_class(group)
        mine, z, turned = _with_one(hidden.take(order, 0)), np.empty((len(want), CLASSES), np.float32), np.empty_like(hidden)
        words, steps = _with_bias(m), np.zeros((CLASSES, HIDDEN + 1, CLASSES), np.float32)
        for g, own in held:
            np.matmul(mine[own], words[g], out=z[own])
        gap = _gaps(z, word[order])
        for g, own in held:
            np.matmul(gap[own], m["word"][g].T, out=turned[own])
            np.matmul(mine[own].T, gap[own], out=steps[g])
        grads["word"], grads["word_bias"] = steps[:, :HIDDEN], steps[:, HIDDEN]
        back[order] += turned
        back *= 1 - hidden * hidden
        grads["mix"], grads["mix_bias"] = total.T @ back, _sums(back)
        back = back @ m["mix"].T
        grads["place"] = np.stack([_sums(m["embed"].take(near[:, k], 0) * back) for k in range(2 * REACH)])
        # what every place of the text gets from the tokens around it, then added up by word; other places than words get none
        share = np.zeros((len(want) + 2 * REACH, DIMS), np.float32)
        for k, step in enumerate([*range(REACH), *range(REACH + 1, 2 * REACH + 1)]):
            part = back * m["place"][k]
            part[near[:, k] == VOCAB] = 0
            share[step : step + len(want)] += part
        place = np.arange(at - REACH, at + len(want) + REACH)
        inside = (place >= 0) & (place < len(ids))
        word, share = ids[place[inside]], share[inside]
        order = np.argsort(word.astype(np.uint16), kind="stable")
        word = word[order]
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        # only words that occur have a gradient
        rows, embed = word[first], np.add.reduceat(share.take(order, 0), first)
        part, upto = m["embed"][rows], sums["embed"][rows]
        _adagrad(part, upto, embed, len(want), rate)
        m["embed"][rows], sums["embed"][rows] = part, upto
        for name, g in grads.items():
            _adagrad(m[name], sums[name], g, len(want), rate)


def _fit_share(flat: np.ndarray, known: np.ndarray, rate: float):
    """(place in the model, weight times tokens, tokens) of the copy that one partition fits."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = flat.copy()
        m = opened(mine)
        sums, tokens = {k: np.zeros_like(v) for k, v in m.items()}, 0
        for batch in batches:
            for _, data, offs in T.runs(batch.column(0), 1 << 20):
                ids, row = token_ids(data, offs, known)
                learn(m, ids, contexts(ids, row), sums, rate)
                tokens += len(ids)
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(mine))), pa.array(mine.astype(float) * tokens), pa.array(np.full(len(mine), float(tokens)))], names=["place", "sum", "tokens"])

    return rows


def train(docs: DataFrame, known: np.ndarray, share: int = 1, rounds: int = ROUNDS, rate: float = 0.1, doc_id: str = "doc_id", text: str = "text") -> np.ndarray:
    """Averaged weights, learned from all documents, or from one in `share` by hash."""
    flat = start_model()
    place = F.xxhash64(F.col(doc_id), F.octet_length(text))
    picked = docs.where(F.col(text).isNotNull() & (F.pmod(place, F.lit(share)) == 0)).select(F.pmod(F.shiftright(place, 20), F.lit(rounds)).alias("round"), F.col(text).cast("binary").alias("text"))
    for turn in range(rounds):
        own = picked.where(F.col("round") == turn).select("text")
        mean = own.mapInArrow(_fit_share(flat, known, rate), "place long, sum double, tokens double").groupBy("place").agg((F.sum("sum") / F.sum("tokens")).alias("w")).toArrow()
        if len(mean):
            flat = np.zeros(len(flat), np.float32)
            flat[mean["place"].to_numpy()] = mean["w"].to_numpy()
    return flat


def score(text: Column, flat: np.ndarray, known: np.ndarray) -> Column:
    """Struct n_tokens, sum_log_prob, mean_log_prob."""

    def rows(column: pa.Array) -> pa.Array:
        m = opened(flat)
        n_tokens, total = np.zeros(len(column), np.int64), np.zeros(len(column))
        for first, data, offs in T.runs(column, 1 << 20):
            n = len(offs) - 1
            ids, row = token_ids(data, offs, known)
            got = log_chances(m, ids, contexts(ids, row))
            n_tokens[first : first + n] = np.bincount(row, minlength=n)
            total[first : first + n] = np.bincount(row, weights=got, minlength=n)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = pa.array(total / n_tokens, mask=n_tokens == 0)
        return pa.StructArray.from_arrays([pa.array(n_tokens), pa.array(total), mean], names=["n_tokens", "sum_log_prob", "mean_log_prob"])

    return F.arrow_udf(rows, "n_tokens long, sum_log_prob double, mean_log_prob double")(F.coalesce(text, F.lit("")).cast("binary"))
