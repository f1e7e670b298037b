"""MinHash near-dedup with SetSketch registers.

A document is the set of its distinct five-word shingles. A register holds the smallest of its
elements' exponential hash values on an exponential scale: K = floor(1 - log_b(min x)), cut to 16
bits. Registers of a union are the elementwise maxima, so sketches of parts merge; two registers are
equal with a chance close to the Jaccard similarity, so bands of BAND registers are the keys of a
locality-sensitive search. The joint likelihood of the greater, smaller and equal registers and of
the known set sizes estimates the similarity of a pair; a pair whose estimate lies within five
standard deviations of the limit, or above it, is decided on the full sets.

Equal sets collapse to one node first. Links are then found in two steps, neither of which emits
the pairs of a group:

1. every member of a bucket (equal registers in one band) meets the bucket's smallest node, and
   confirmed pairs give components;
2. only buckets that hold several components go on: their members are compared across components
   inside tasks, in blocks of bounded size, and a task reports a spanning forest of confirmed pairs.

So all pairs of every bucket are decided, but for those already connected. A pair at the limit of
0.85 shares no bucket with a chance of (1 - 0.85 ** 5) ** 32, about 7e-9.

Cases: null, empty and wordless texts have an empty set, are linked with nothing and are kept; with
fewer words than a shingle the whole sequence is the one element; equal rows give equal rows; rows
that repeat an id with other texts are one document; a null id takes part, loses to any other as
component id, and of a component without ids one class of equal sets is kept; an empty table gives
an empty result; further columns are not read. Shingles are compared by 64-bit hashes, equal sets
by 128 bits.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import materialise
from ..functions.components import components

SHINGLE = 5
BANDS, BAND = 32, 5
REGISTERS = BANDS * BAND
BASE, RATE = 1.001, 20.0
TOP = (1 << 16) - 1
#: Rows of a block in the comparison inside buckets.
BLOCK = 1_024
#: Nodes of rows without an id lie above all ids.
LOOSE = 1 << 62

_seeds = np.random.Generator(np.random.PCG64(85)).integers(1, 1 << 63, (REGISTERS + SHINGLE + 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TURN, _PLACE, _LENGTH, _SECOND = _seeds[:REGISTERS], _seeds[REGISTERS:-2], _seeds[-2], _seeds[-1]


def shingles(data: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of every row of a run, sorted within a row, and the row offsets."""
    rows = len(offs) - 1
    low = data + np.uint8(32) * T.UPPER[data]
    starts, ends, row = T.words(low, offs)
    word = T.hashes(low, starts, ends)
    held = np.bincount(row, minlength=rows)
    first = np.concatenate(([0], np.cumsum(held)))[:-1]
    n = len(word)
    total = np.zeros(n, np.uint64)
    for j in range(min(size, n)):  # a row with fewer words has one element, all its words
        total[: n - j] += np.where(row[j:] == row[: n - j], word[j:] * _PLACE[j], np.uint64(0))
    span = np.minimum(held, size)
    at = np.flatnonzero(np.arange(n) - first[row] <= (held - span)[row])
    value, owner = T.mix(total[at] + span[row[at]].astype(np.uint64) * _LENGTH), row[at]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[fresh], owner[fresh]
    return value, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=rows))))


def registers_of(value: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(rows, REGISTERS) 16-bit registers; those of an empty set are 0."""
    out = np.zeros((len(offs) - 1, REGISTERS), np.uint16)
    full = np.flatnonzero(offs[1:] > offs[:-1])
    if len(full):
        begin = offs[:-1][full]
        for i, turn in enumerate(_TURN):
            least = np.minimum.reduceat(value * turn, begin)
            x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
            out[full, i] = np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / math.log(BASE)), 0, TOP)
    return out


def sketch(text: Column) -> Column:
    """size (long), low and high (the set's 128-bit digest), registers (binary, big-endian 16-bit)."""
    kind = pa.struct([("size", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("registers", pa.binary())])

    def rows(column: pa.Array) -> pa.Array:
        size, low, high, regs = [], [], [], []
        for _, data, offs in T.runs(column):
            value, cut = shingles(data, offs)
            totals = []
            for v in (T.mix(value), T.mix(value ^ _SECOND)):
                run = np.concatenate(([np.uint64(0)], np.cumsum(v, dtype=np.uint64)))
                totals.append((run[cut[1:]] - run[cut[:-1]]).view(np.int64))
            size.append(np.diff(cut))
            low.append(totals[0])
            high.append(totals[1])
            regs += [r.tobytes() for r in registers_of(value, cut).astype(">u2")]
        flat = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
        return pa.StructArray.from_arrays([flat(size), flat(low), flat(high), pa.array(regs, pa.binary())], fields=list(kind))

    return F.arrow_udf(rows, "size long, low long, high long, registers binary")(text.cast("binary"))


def shingle_set(text: Column) -> Column:
    """The distinct shingle hashes of a text as an array of longs, in unsigned order."""

    def rows(column: pa.Array) -> pa.Array:
        values, counts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
        for _, data, offs in T.runs(column):
            value, cut = shingles(data, offs)
            values.append(value)
            counts.append(np.diff(cut))
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)), pa.int32()), pa.array(np.concatenate(values).view(np.int64)))

    return F.arrow_udf(rows, "array<long>")(text.cast("binary"))


def merge(sketches: np.ndarray) -> np.ndarray:
    """Registers of the union of sets: the elementwise maxima of theirs."""
    return sketches.max(axis=0)


def _apart(x: np.ndarray) -> np.ndarray:
    """Chance that a register exceeds another by the share x of the elements."""
    return -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)


def likelihood_estimate(above: np.ndarray, below: np.ndarray, size: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Similarity of greatest joint likelihood, from the counts of greater and smaller registers and the set sizes."""
    u, v = size / (size + other), other / (size + other)
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    same = REGISTERS - above - below
    slope = (BASE - 1) / BASE / math.log(BASE)
    for _ in range(30):  # the likelihood is concave: its derivative is bisected
        j = (lo + hi) / 2
        x, y = np.maximum(u - v * j, 0), np.maximum(v - u * j, 0)
        p, q = np.maximum(_apart(x), 1e-12), np.maximum(_apart(y), 1e-12)
        dp, dq = -v * slope / (1 - x * (BASE - 1) / BASE), -u * slope / (1 - y * (BASE - 1) / BASE)
        rise = above * dp / p + below * dq / q - same * (dp + dq) / np.maximum(1 - p - q, 1e-12)
        lo, hi = np.where(rise > 0, j, lo), np.where(rise > 0, hi, j)
    return (lo + hi) / 2


def _least_estimate(percent: int) -> float:
    limit = percent / 100
    return limit - 5 * math.sqrt(limit * (1 - limit) / REGISTERS)


def _hopeful(percent: int):
    """Whether the estimate of a pair leaves the limit possible."""
    least = _least_estimate(percent)

    def rows(one: pa.Array, two: pa.Array, size: pa.Array, other: pa.Array) -> pa.Array:
        a, b = _register_matrix(one), _register_matrix(two)
        got = likelihood_estimate((a > b).sum(1), (a < b).sum(1), size.to_numpy().astype(float), other.to_numpy().astype(float))
        return pa.array(got >= least)

    return F.arrow_udf(rows, "boolean")


def _register_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u2").astype(np.uint16).reshape(-1, REGISTERS)


def hub_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs whose full sets reach the limit. sets: node, size, registers, items."""
    side = lambda name, p: sets.select(F.col("node").alias(name), *[F.col(c).alias(p + c) for c in ("size", "registers", "items")])
    met = pairs.join(side("a", "a_"), "a").join(side("b", "b_"), "b").where(F.least("a_size", "b_size") * 100 >= F.greatest("a_size", "b_size") * percent)
    met = met.where(_hopeful(percent)("a_registers", "b_registers", "a_size", "b_size"))
    shared = F.size(F.array_intersect("a_items", "b_items")).cast("long")
    return met.where(shared * 100 >= (F.col("a_size") + F.col("b_size") - shared) * percent).select("a", "b")


class _Joined:
    """Union-find over the rows of a task, begun from the components that are known."""

    def __init__(self, roots: np.ndarray):
        self.up = np.unique(roots, return_inverse=True)[1]

    def link(self, x: int, y: int) -> None:
        a, b = self.up[x], self.up[y]
        self.up[self.up == max(a, b)] = min(a, b)


def compare(sizes: np.ndarray, regs: np.ndarray, flat: np.ndarray, cut: np.ndarray, roots: np.ndarray, homes: np.ndarray, asks: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Confirmed pairs that connect what pairs of (asks, homes) connect, beyond the known components.

    Rows closest to the registers most rows share come first: in a group of near copies one of them
    is linked with nearly all others, and pairs inside a component need no comparison.
    """
    joined, links, least = _Joined(roots), [], _least_estimate(percent)
    usual = np.median(regs, axis=0).astype(np.uint16)
    for i in asks[np.argsort(-(regs[asks] == usual).sum(1), kind="stable")].tolist():
        near = homes[(joined.up[homes] != joined.up[i]) & (100 * np.minimum(sizes[homes], sizes[i]) >= percent * np.maximum(sizes[homes], sizes[i]))]
        if not len(near):
            continue
        got = likelihood_estimate((regs[near] > regs[i]).sum(1), (regs[near] < regs[i]).sum(1), sizes[near].astype(float), np.full(len(near), float(sizes[i])))
        near = near[got >= least]
        own = flat[cut[i] : cut[i + 1]]
        for at in range(0, len(near), 256):
            some = near[at : at + 256]
            some = some[joined.up[some] != joined.up[i]]
            if not len(some):
                continue
            items = np.concatenate([flat[cut[k] : cut[k + 1]] for k in some.tolist()])
            place = np.minimum(np.searchsorted(own, items), len(own) - 1)
            shared = np.add.reduceat((own[place] == items).astype(np.int64), np.concatenate(([0], np.cumsum(sizes[some])))[:-1])
            for k in some[100 * shared >= percent * (sizes[some] + sizes[i] - shared)].tolist():
                if joined.up[k] != joined.up[i]:
                    joined.link(i, k)
                    links.append((i, k))
    return links


def _bucket_links(percent: int):
    """Links of every (bucket, one, two) of a group of tasks."""

    def rows(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        order = np.lexsort(tuple(table.column(c).to_numpy() for c in ("node", "two", "one", "bucket")))
        table = table.take(pa.array(order)).combine_chunks()
        node, bucket, one, two, block, root, size = (table.column(c).to_numpy() for c in ("node", "bucket", "one", "two", "block", "root", "size"))
        items = table.column("items").combine_chunks()
        regs = _register_matrix(table.column("registers").combine_chunks())
        flat, cut = items.flatten().to_numpy().view(np.uint64), np.concatenate(([0], np.cumsum(size)))
        edges = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
        links = []
        for lo, hi in zip(edges.tolist(), np.append(edges[1:], len(node)).tolist()):
            homes, asks = np.flatnonzero(block[lo:hi] == one[lo]), np.flatnonzero(block[lo:hi] == two[lo])
            found = compare(size[lo:hi], regs[lo:hi], flat, cut[lo : hi + 1], root[lo:hi], homes, asks, percent)
            links += [(node[lo + x], node[lo + y]) for x, y in found]
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return rows


def crossing_links(members: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK, group: int = 4_096) -> DataFrame:
    """(a, b): links between components that meet in a bucket. members: node, bucket, n (its rows), root.

    Buckets of up to `block` rows are dealt over groups of about `group` rows; a larger one is cut into
    blocks, and a task compares two of them or one with itself.
    """
    met = members.withColumn("blocks", F.ceil(F.col("n") / block).cast("long")).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    pair = F.least("block", "other"), F.greatest("block", "other")
    groups = F.lit(max(1, members.count() // group)).cast("long")
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("bucket"), groups)).otherwise(F.xxhash64("bucket", *pair))
    dealt = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "node", "bucket", "root", "block", pair[0].alias("one"), pair[1].alias("two"), task.alias("task")
    )
    return dealt.join(sets, "node").groupBy("task").applyInArrow(_bucket_links(percent), "a long, b long")


def near_groups(docs: DataFrame, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row: links at a similarity of percent / 100 or more."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    body = F.xxhash64("text").alias("body")
    drawn = materialise(rows.select("doc_id", body, sketch(F.col("text")).alias("s")).select("doc_id", "body", "s.*"), "sketches")
    # equal sets are one node, named by its smallest id
    whole = ["low", "high", "size"]
    named = F.min(F.struct(F.col("doc_id").isNull().alias("loose"), "doc_id", "body")).alias("named")
    first = drawn.where("size > 0").groupBy(*whole).agg(named, F.first("registers").alias("registers"))
    node = F.coalesce("named.doc_id", F.lit(LOOSE) + F.shiftrightunsigned("low", 2))
    nodes = materialise(first.select(*whole, node.alias("node"), "registers", "named.doc_id", "named.body"), "distinct-sets")

    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("registers", 2 * BAND * i + 1, 2 * BAND)) for i in range(BANDS)])
    keyed = materialise(nodes.select("node", F.explode(bands).alias("bucket")), "bands")
    shared = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub")).where("n > 1")
    members = materialise(keyed.join(shared, "bucket"), "shared-buckets")
    pairs = materialise(members.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "hub-pairs")

    # the full sets of nodes that have a candidate, from one text of each
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = nodes.join(asked, "node", "left_semi").withColumnsRenamed({"doc_id": "id_", "body": "body_"})
    texts = rows.withColumn("body", body).join(wanted, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("body") == F.col("body_")))
    once = texts.groupBy("node", *whole).agg(F.first("registers").alias("registers"), F.first("text").alias("text"))
    sets = materialise(once.select("node", "size", "registers", shingle_set(F.col("text")).alias("items")), "shingle-sets")

    near = materialise(hub_links(pairs, sets, percent), "hub-links")
    known = components(near)
    rooted = materialise(members.join(known, "node", "left").select("node", "bucket", "n", F.coalesce("root", "node").alias("root")), "rooted")
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket")
    open_buckets = materialise(rooted.join(mixed, "bucket", "left_semi"), "open-buckets")
    links = near.unionByName(crossing_links(open_buckets, sets, percent))
    found = materialise(nodes.join(components(links), "node", "left").select(*whole, "node", F.coalesce("root", "node").alias("root")), "roots")
    out = drawn.join(found, whole, "left")
    root = F.when(F.col("size") == 0, F.col("doc_id")).when(F.col("root") < LOOSE, F.col("root"))
    kept = F.when(F.col("size") == 0, F.lit(True)).when(F.col("root") >= LOOSE, F.col("root") == F.col("node")).otherwise(F.coalesce(F.col("doc_id") == F.col("root"), F.lit(False)))
    return out.select("doc_id", F.col("size").alias("n_shingles"), root.alias("component_id"), kept.alias("kept"))
