"""Lexical retrieval packing: BM25 neighbours of a seed document fill its window.

Document frequencies come from all documents: words are hashed to 2^DF_BITS buckets and counted with
partial aggregation, so the table that tasks get has a fixed size. Neighbours are looked for in all
documents: every text posts the rarer quarter of its words (by the counts above, LEAST_TERMS at least), and
these postings nominate, for every text, the one with the highest BM25 score over its TERMS rarest shared
words (posted by at most RARE texts, counted exactly); texts with an equal smallest shingle are tied too,
so large groups of near copies need no pairs. Documents are dealt and sorted by the
components of these ties, wherever they lay in the input. The inverted index is sharded: a shard is a run
of neighbouring rows in this order, of at most SHARD_BYTES text or one longer document, and its
postings, scores and windows live in one task only as long as the shard lasts.
The seed is the first unused document; its BM25 scores rank the unused documents of the shard, which
are appended until the window is full. A document that is cut becomes the seed of the next window.
An open window passes to the next shard of the partition; the last one is split into lengths that are
powers of two, so no sequence needs padding.

Cases: null and empty texts have only their end id; documents without shared words follow in row
order; a text of any length is cut freely; rows with equal ids are packed each; an empty table gives
no rows; further columns are not read. Equal texts are one text for the ties and lie side by side; a
component that is longer than a shard or meets the end of a partition is cut. Where partitions are cut
follows a sample of the order, so another run may cut sequences elsewhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ids as I
from . import text as T
from .common import materialise
from ..functions.components import components

DF_BITS = 18
SHARD_BYTES = 2 << 20
RARE = 64
TERMS = 8
LEAST_TERMS = 64
SHINGLE = 3
PART_WORDS = 2_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word, letter case of ASCII ignored."""
    starts, ends, row = T.words(data, offs)
    return T.hashes(data + T.UPPER[data].astype(np.uint8) * np.uint8(32), starts, ends), row


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, documents with it) of one task; bucket -1 counts documents, -2 words."""
    held, n_docs, n_words = np.zeros(1 << DF_BITS, np.int64), 0, 0
    for batch in batches:
        for _, data, offs in T.runs(batch.column(0)):
            h, row = _terms(data, offs)
            n_docs, n_words = n_docs + len(offs) - 1, n_words + len(h)
            bucket = (h >> np.uint64(64 - DF_BITS)).astype(np.int64)
            bounds = np.searchsorted(row, np.arange(len(offs)))
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                # buffered: a bucket that a document names often still rises by one
                held[bucket[lo:hi]] += 1
    seen = np.flatnonzero(held)
    for at in range(0, len(seen) or 1, 1 << 16):
        part = seen[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(part, [-1, -2] if at == 0 else []).astype(np.int64)), pa.array(np.append(held[part], [n_docs, n_words] if at == 0 else []).astype(np.int64))], names=["bucket", "n"])


def term_weights(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, float, int]:
    """BM25 idf of every hash bucket over all documents (0 where it is not positive), the mean length, and the number of documents."""
    table = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")).mapInArrow(_count_terms, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = table["bucket"].to_numpy(), table["n"].to_numpy()
    total = {int(b): int(v) for b, v in zip(bucket[bucket < 0], n[bucket < 0])}
    held = np.zeros(1 << DF_BITS)
    held[bucket[bucket >= 0]] = n[bucket >= 0]
    n_docs = total.get(-1, 0)
    idf = np.log((n_docs - held + 0.5) / (held + 0.5), where=held > 0, out=np.zeros(1 << DF_BITS))
    return np.maximum(idf, 0).astype(np.float32), total.get(-2, 0) / max(n_docs, 1), n_docs


def _postings(idf: np.ndarray, mean: float, k1: float = 1.2, b: float = 0.75):
    """(node, term, part): the share of every word in a BM25 score of its text, without the idf. A row with
    part 0 has the smallest shingle of the text. Words of more than RARE texts of one run are left out, and
    all but the rarer quarter of a text's words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy()
            for first, data, offs in T.runs(batch.column(1)):
                own = node[first : first + len(offs) - 1]
                h, row = _terms(data, offs)
                if not len(h):
                    continue
                length = np.bincount(row, minlength=len(own))
                gram, step = h, np.uint64(0xC2B2AE3D27D4EB4F)
                for k in range(1, min(SHINGLE, len(h))):
                    gram = T.mix(gram[:-1] * step + h[k:])
                whole = np.flatnonzero(row[len(row) - len(gram) :] == row[: len(gram)])
                least = np.full(len(own), np.iinfo(np.uint64).max)
                np.minimum.at(least, row[whole], gram[whole])
                tied = np.flatnonzero(least < np.iinfo(np.uint64).max)
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                at = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])))
                tf = np.diff(np.append(at, len(h)))
                h, row = h[at], row[at]
                term = np.cumsum(np.append(True, h[1:] != h[:-1])) - 1
                # copies in a run are one text
                _, place = np.unique(own, return_inverse=True)
                apart = np.unique(term * len(own) + place[row]) // len(own)
                rare = np.bincount(apart)[term] <= RARE
                h, row, tf = h[rare], row[rare], tf[rare]
                held = np.bincount(row, minlength=len(own))
                order = np.lexsort((h, -idf[(h >> np.uint64(64 - DF_BITS)).astype(np.int64)], row))
                h, row, tf = h[order], row[order], tf[order]
                top = np.arange(len(h)) - (np.cumsum(held) - held)[row] < np.maximum(held // 4, LEAST_TERMS)[row]
                h, row, tf = h[top], row[top], tf[top]
                part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / max(mean, 1e-9)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(own[row], own[tied])), pa.array(np.append(h, least[tied]).view(np.int64)), pa.array(np.append(part, np.zeros(len(tied))).astype(np.float32))],
                    names=["node", "term", "part"],
                )

    return rows


def neighbours(texts: DataFrame, idf: np.ndarray, mean: float, n_docs: int) -> DataFrame:
    """(node, hub, best): what ties a text to others of the whole table; null where nothing does.

    texts: node (hash of the text), text (binary). hub is the smallest text with the same smallest
    shingle, best the text with the highest score over the rarest shared words.
    """
    spread = texts.mapInArrow(_postings(idf, mean), "node long, term long, part float").repartition("term")
    posts = spread.groupBy("term", "node").agg(F.max("part").alias("part"))
    # both sides of the join lie by term already; only what ties texts is written
    held = posts.groupBy("term").agg(F.count(F.when(F.col("part") > 0, 1)).alias("n"), F.count(F.when(F.col("part") == 0, 1)).alias("grams"))
    rare = F.col("n").between(2, RARE)
    tying = posts.join(held.where(rare | (F.col("grams") > 1)), "term").where(((F.col("part") > 0) & rare) | ((F.col("part") == 0) & (F.col("grams") > 1)))
    tying = materialise(tying.drop("grams"), "tying-terms")
    shared = tying.where("part > 0")
    picked = shared.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "term"))), 1, TERMS).alias("t")).select(F.col("node").alias("a"), F.explode("t.term").alias("term"))
    scored = picked.join(shared, "term").where("a <> node").groupBy("a", "node").agg(F.sum(F.log((F.lit(n_docs) + 1.0) / F.col("n")) * F.col("part")).alias("score"))
    best = scored.groupBy("a").agg(F.max_by("node", F.struct("score", "node")).alias("best")).withColumnRenamed("a", "node")
    grams = tying.where("part = 0")
    hubs = grams.groupBy("term").agg(F.min("node").alias("hub"))
    return grams.join(hubs, "term").select("node", "hub").join(best, "node", "full_outer")


def routed(docs: DataFrame, idf: np.ndarray, mean: float, n_docs: int) -> DataFrame:
    """doc_id, text in an order in which ties of the whole table lie side by side, over partitions of about PART_WORDS words."""
    named = docs.withColumn("node", F.xxhash64("text"))
    ties = materialise(neighbours(named.select("node", "text"), idf, mean, n_docs), "ties")
    edges = ties.select("node", F.explode(F.array("hub", "best")).alias("to")).where("to <> node").select(F.greatest("node", "to").alias("a"), F.least("node", "to").alias("b"))
    places = ties.join(components(edges), "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.coalesce("hub", F.least("node", "best")).alias("hub"))
    order = [F.coalesce("root", "node"), F.coalesce("hub", "node"), F.col("node"), F.col("doc_id")]
    parts = max(1, round(mean * n_docs / PART_WORDS))
    return named.join(places, "node", "left").repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")


class Index:
    """BM25 postings of one shard. Words of one document only link nothing and are left out."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, idf: np.ndarray, mean: float, k1: float = 1.2, b: float = 0.75):
        h, row = _terms(data, offs)
        self.n = len(offs) - 1
        length = np.bincount(row, minlength=self.n)
        weight = idf[(h >> np.uint64(64 - DF_BITS)).astype(np.int64)]
        h, row, weight = h[weight > 0], row[weight > 0], weight[weight > 0]
        order = np.argsort(h, kind="stable")  # rows rise already
        h, row, weight = h[order], row[order], weight[order]
        fresh = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])) if len(h) else np.zeros(0, bool)
        first = np.flatnonzero(fresh)
        tf = np.diff(np.append(first, len(h)))
        h, row, weight = h[first], row[first], weight[first]
        new = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
        term = np.cumsum(new) - 1
        shared = np.bincount(term)[term] > 1 if len(term) else np.zeros(0, bool)
        row, tf, weight, term = row[shared], tf[shared], weight[shared], term[shared]
        self.rows = row
        self.value = weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / max(mean, 1e-9)))
        self.bounds = np.searchsorted(term, np.arange((term[-1] + 2) if len(term) else 1))
        by_row = np.argsort(row, kind="stable")
        self.terms, self.row_bounds = term[by_row], np.searchsorted(row[by_row], np.arange(self.n + 1))

    def ranked(self, seed: int) -> np.ndarray:
        """Rows by falling BM25 score against the words of the seed; ties in row order; scores of 0 are left out."""
        terms = self.terms[self.row_bounds[seed] : self.row_bounds[seed + 1]]
        lo, size = self.bounds[terms], self.bounds[terms + 1] - self.bounds[terms]
        if not size.sum():
            return np.zeros(0, np.int64)
        at = np.arange(size.sum()) + np.repeat(lo - np.append(0, np.cumsum(size)[:-1]), size)
        score = np.bincount(self.rows[at], weights=self.value[at], minlength=self.n)
        score[seed] = 0
        return np.argsort(-score, kind="stable")[: np.count_nonzero(score)]


class Window:
    """The open sequence of one task."""

    def __init__(self, most: int, part: int):
        self.most, self.next, self.pieces, self.filled = most, part << 40, [], 0
        self.rows: list[tuple] = []

    def place(self, doc_id, ids: np.ndarray) -> bool:
        """Appends a document, cut where windows end; true if the last window is open with it at the end."""
        at, n = 0, len(ids)
        while at < n:
            take = min(self.most - self.filled, n - at)
            self.pieces.append((doc_id, at, ids[at : at + take], n))
            self.filled, at = self.filled + take, at + take
            if self.filled == self.most:
                self.close()
        return self.filled > 0

    def close(self) -> None:
        offset = 0
        for doc_id, start, ids, n in self.pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), n, self.next, offset))
            offset += len(ids)
        self.next, self.pieces, self.filled = self.next + 1, [], 0

    def finish(self) -> None:
        """Splits what is left into sequences whose lengths are powers of two."""
        pieces, left = self.pieces, self.filled
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            self.pieces = []
            while room:
                doc_id, start, ids, n = pieces.pop(0)
                if len(ids) > room:
                    pieces.insert(0, (doc_id, start + room, ids[room:], n))
                    ids = ids[:room]
                self.pieces.append((doc_id, start, ids, n))
                room -= len(ids)
            self.close()

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [[]] * 7
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def fill(window: Window, index: Index, docs: list[tuple]) -> None:
    """Packs all documents (id, ids) of a shard."""
    used = np.zeros(len(docs), bool)
    seed, first = -1, 0
    near: Iterator[int] = iter(())
    while True:
        pick = next((r for r in near if not used[r]), -1) if seed >= 0 else -1
        fresh = pick < 0
        if fresh:
            while first < len(docs) and used[first]:
                first += 1
            if first == len(docs):
                return
            pick = first
        used[pick] = True
        whole = len(docs[pick][1]) + window.filled < window.most
        if not window.place(*docs[pick]):
            seed = -1
        elif fresh or not whole:
            # a new seed, or the cut document that starts the open window
            seed, near = pick, iter(index.ranked(pick).tolist())


def pack_rows(tokenizer: str, end: int, most: int, idf: np.ndarray, mean: float, shard_bytes: int = SHARD_BYTES):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window = Window(most, TaskContext.get().partitionId())
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, data, offs in T.runs(batch.column(1), shard_bytes):
                ids, bounds = I.with_end(*I.encoder(tokenizer, True).run(data, offs), end)
                ids = ids.astype("<u4")
                n = len(offs) - 1
                fill(window, Index(data, offs, idf, mean), [(doc_ids[first + i], ids[bounds[i] : bounds[i + 1]]) for i in range(n)])
                yield window.batch()
        window.finish()
        yield window.batch()

    return rows


def pack(docs: DataFrame, tokenizer: str, end: int = 0, most: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence."""
    idf, mean, n_docs = term_weights(docs, text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return routed(rows, idf, mean, n_docs).mapInArrow(pack_rows(tokenizer, end, most, idf, mean), SCHEMA)
