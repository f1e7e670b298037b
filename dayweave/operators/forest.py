"""Random forests whose trees are grown, kept and walked by tasks; the driver holds none of their nodes.

Spark's forest finds the splits of all trees in the driver, keeps every node there and sends the whole model to
every task. Here the columns are cut into bins once, a task grows a group of trees on the binned rows, and
the trees are a table on shared storage. To score, a block of rows meets a group of trees in a task; what the groups say of a
row is added up in the order of the groups, so the sum does not depend on the tasks.

Trees follow Spark's: Poisson bootstrap, ceil(sqrt(columns)) columns a node drawn anew, Gini gain above 0,
`minInstancesPerNode` drawn rows on either side, leaves of one prediction below a node merged. A task holds one byte for each
row and column, and about 40 bytes for each row besides.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasProbabilityCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, scratch_path

#: Parameters of an estimator that `grow` knows.
KNOWN = {"numTrees", "maxDepth", "minInstancesPerNode", "subsamplingRate", "seed"}
BINS = 32
#: Trees of a task.
GROUP = 25
#: Most rows and bytes of output of a block of rows that a group of trees walks over in one task, and rows walked at a time.
BLOCK_ROWS, BLOCK_BYTES, CHUNK = 1 << 18, 64 << 20, 8_192
#: Most nodes whose sums are held at a time, and rows added to them at a time.
NODES, PIECE = 256, 1 << 15
#: A gain of at most this share of a node's sum of squares is rounding.
LEAST_GAIN = 1e-12

TREES = "forest int, grp int, tree int, feature binary, cut binary, child binary, counts binary"


# --- one tree -----------------------------------------------------------------------------------------


class Tree:
    """Nodes by level: split column (−1 in leaves), its last bin to the left, left child (the right one follows it), class sums."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, child: np.ndarray, counts: np.ndarray):
        self.feature, self.cut, self.child, self.counts = feature, cut, child, counts
        self.share = counts / counts.sum(1, keepdims=True)

    def bytes(self) -> list[bytes]:
        whole = (self.counts == np.floor(self.counts)).all() and self.counts.max(initial=0) < 1 << 24
        return [v.astype(t).tobytes() for v, t in ((self.feature, "<i4"), (self.cut, "u1"), (self.child, "<i4"), (self.counts, "<f4" if whole else "<f8"))]

    @classmethod
    def read(cls, feature: bytes, cut: bytes, child: bytes, counts: bytes, classes: int) -> Tree:
        f = np.frombuffer(feature, "<i4").astype(np.int64)
        kind = "<f4" if len(counts) == 4 * classes * len(f) else "<f8"
        return cls(f, np.frombuffer(cut, "u1"), np.frombuffer(child, "<i4").astype(np.int64), np.frombuffer(counts, kind).astype(float).reshape(-1, classes))

    def down(self, x: np.ndarray, at: np.ndarray, column: np.ndarray | None = None, value: np.ndarray | None = None) -> np.ndarray:
        """The leaves that rows of bins reach from the nodes `at`; `column` of a row counts as `value` there."""
        at, going = at.copy(), np.flatnonzero(self.feature[at] >= 0)
        while len(going):
            here = at[going]
            f = self.feature[here]
            v = x[going, f]
            if column is not None:
                v = np.where(f == column[going], value[going], v)
            after = self.child[here] + (v > self.cut[here])
            at[going] = after
            going = going[self.feature[after] >= 0]
        return at

    def steps(self, x: np.ndarray):
        """(rows, their node, its column, the next node) of every level of the walk of all rows."""
        at, going = np.zeros(len(x), np.int64), np.arange(len(x) if self.feature[0] >= 0 else 0)
        while len(going):
            here = at[going]
            f = self.feature[here]
            after = self.child[here] + (x[going, f] > self.cut[here])
            yield going, here, f, after
            at[going] = after
            going = going[self.feature[after] >= 0]


def _best(codes: np.ndarray, rows: np.ndarray, label: np.ndarray, w: np.ndarray, bag: np.ndarray | None, sizes: np.ndarray, picked: np.ndarray, bins: int, classes: int, least: int):
    """Best split of nodes whose rows stand together: (gain, column, bin, class sums on the left and on both sides).

    bag: drawn copies of a row where its weight is something else. picked: (nodes, drawn columns).
    """
    k, m = picked.shape
    wide, width = k * m, codes.shape[1]
    flat, at = codes.reshape(-1), np.repeat(np.arange(k), sizes)
    held, drawn = np.zeros(bins * classes * wide), np.zeros(bins * wide if bag is not None else 0)
    for lo in range(0, len(rows), PIECE):
        own = slice(lo, lo + PIECE)
        a = at[own]
        v = flat.take((rows[own] * width)[:, None] + picked[a]).astype(np.int64)
        slot = a[:, None] * m + np.arange(m)
        held += np.bincount(((v * classes + label[own, None]) * wide + slot).ravel(), np.repeat(w[own], m), len(held))
        if bag is not None:
            drawn += np.bincount((v * wide + slot).ravel(), np.repeat(bag[own], m), len(drawn))
    # sums of all bins up to one, which lie on the left of a split after it
    held, drawn = held.reshape(bins, classes, wide), drawn.reshape(-1, wide)
    for b in range(1, bins):
        held[b] += held[b - 1]
        if bag is not None:
            drawn[b] += drawn[b - 1]
    left, whole = held[:-1], held[-1]
    size, total = left.sum(1), whole.sum(0)
    some = size if bag is None else drawn[:-1]
    rest = (total if bag is None else drawn[-1]) - some
    with np.errstate(divide="ignore", invalid="ignore"):
        score = sum(left[:, c] ** 2 for c in range(classes)) / size + sum((whole[c] - left[:, c]) ** 2 for c in range(classes)) / (total - size)
    score[(some < least) | (rest < least)] = -np.inf
    score[np.isnan(score)] = -np.inf
    bin_ = score.argmax(0)
    top = np.take_along_axis(score, bin_[None], 0)[0].reshape(k, m)
    slot = top.argmax(1) + np.arange(k) * m
    both = whole[:, slot].T
    base = (both**2).sum(1) / both.sum(1)
    gain = np.where(np.isfinite(top.reshape(-1)[slot]), top.reshape(-1)[slot] - base * (1 + LEAST_GAIN), -np.inf)
    return gain, picked.reshape(-1)[slot], bin_[slot], left[bin_[slot], :, slot], both


def grow_tree(codes: np.ndarray, y: np.ndarray, weight: np.ndarray | None, classes: int, bins: int, rng: np.random.Generator,
              rate: float = 1.0, depth: int = 20, least: int = 1, draw: int | None = None) -> Tree:
    """A tree of a bootstrap of the rows. codes: (rows, columns) bins, one byte each; draw: columns tried at a node."""
    n, width = codes.shape
    draw = draw or math.ceil(math.sqrt(width))
    bag = rng.poisson(rate, n)
    rows = np.flatnonzero(bag)
    label, bag = y[rows], bag[rows].astype(float)
    w = bag if weight is None else bag * weight[rows]
    counts = [np.bincount(label, w, classes)[None]]
    feature, cut, child, starts = [np.full(1, -1)], [np.zeros(1, int)], [np.full(1, -1)], [0]
    open_, sizes = np.zeros(1, int), np.array([len(rows)])
    if bag.sum() < 2 * least or (counts[0] > 0).sum() < 2 or bins < 2:
        open_ = open_[:0]
    for level in range(depth):
        if not len(open_):
            break
        ends = np.cumsum(sizes)
        parts, lo = [], 0
        while lo < len(open_):
            first = ends[lo] - sizes[lo]
            hi = min(lo + NODES, max(lo + 1, int(np.searchsorted(ends, first + PIECE, side="right"))))
            picked = np.argpartition(rng.random((hi - lo, width)), draw - 1, axis=1)[:, :draw] if draw < width else np.tile(np.arange(width), (hi - lo, 1))
            own = slice(first, ends[hi - 1])
            parts.append(_best(codes, rows[own], label[own], w[own], None if weight is None else bag[own], sizes[lo:hi], picked, bins, classes, least))
            lo = hi
        gain, column, bin_, left, both = (np.concatenate(p) for p in zip(*parts))
        split = np.flatnonzero(gain > 0)
        if not len(split):
            break
        starts.append(starts[-1] + len(feature[-1]))
        feature[-1][open_[split]], cut[-1][open_[split]], child[-1][open_[split]] = column[split], bin_[split], starts[-1] + 2 * np.arange(len(split))
        below = np.empty((2 * len(split), classes))
        below[0::2], below[1::2] = left[split], both[split] - left[split]
        counts.append(below)
        for held, none in ((feature, -1), (cut, 0), (child, -1)):
            held.append(np.full(len(below), none))
        # rows of the children that stay open, those of one child together
        turn = np.full(len(open_), -1)
        turn[split] = np.arange(len(split))
        at = np.repeat(np.arange(len(open_)), sizes)
        to = 2 * turn[at] + (codes[rows, column[at]] > bin_[at])
        drawn = np.bincount(to[to >= 0], bag[to >= 0], len(below))
        more = (drawn >= 2 * least) & ((below > 0).sum(1) > 1)
        kept = np.flatnonzero((to >= 0) & more[to])
        kept = kept[np.argsort(to[kept], kind="stable")]
        open_ = np.flatnonzero(more)
        sizes = np.bincount(to[kept], minlength=len(below))[open_]
        rows, label, w, bag = (v[kept] for v in (rows, label, w, bag))
    return _merged(*(np.concatenate(v) for v in (feature, cut, child, counts)), [*starts, sum(map(len, feature))])


def _merged(feature, cut, child, counts, starts) -> Tree:
    """The tree with pairs of leaves of one prediction merged into their node, from below; starts: first node of each level."""
    said = counts.argmax(1)
    for lo, hi in reversed(list(zip(starts, starts[1:]))):
        inner = lo + np.flatnonzero(feature[lo:hi] >= 0)
        one = child[inner]
        same = inner[(feature[one] < 0) & (feature[one + 1] < 0) & (said[one] == said[one + 1])]
        feature[same], cut[same], child[same] = -1, 0, -1
    alive = np.zeros(len(feature), bool)
    alive[0] = True
    for lo, hi in zip(starts, starts[1:]):
        inner = lo + np.flatnonzero(alive[lo:hi] & (feature[lo:hi] >= 0))
        alive[child[inner]] = alive[child[inner] + 1] = True
    place = np.cumsum(alive) - 1
    return Tree(feature[alive], cut[alive], np.where(feature[alive] >= 0, place[child[alive]], -1), counts[alive])


# --- bins -----------------------------------------------------------------------------------------------


def edges_of(df: DataFrame, column: str, width: int) -> list[list[float]]:
    """Upper bounds of the bins of every column: all its values if they are few, quantiles else."""

    def few(batches):
        seen = [np.zeros(0)] * width
        for batch in batches:
            x = _doubles(batch.column(0), width)
            seen = [s if len(s) > BINS else np.unique(np.concatenate([s, x[:, i]]))[: BINS + 1] for i, s in enumerate(seen)]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([s.tolist() for s in seen], pa.list_(pa.float64()))], names=["c", "v"])

    if not width:
        return []
    x = df.select(vector_to_array(column).alias("x"))
    held = x.mapInArrow(few, "c int, v array<double>").groupBy("c").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("v")))), 1, BINS + 1).alias("v"))
    values = {r.c: r.v for r in held.collect()}
    many = [i for i in range(width) if len(values.get(i, [])) > BINS]
    got = x.select(*[F.col("x")[i].alias(f"c{i}") for i in many]).approxQuantile([f"c{i}" for i in many], [j / BINS for j in range(1, BINS)], 0.001) if many else []
    cuts = dict(zip(many, got))
    middle = lambda v: [(a + b) / 2 if math.isfinite(a) and math.isfinite(b) and a <= (a + b) / 2 < b else a for a, b in zip(v, v[1:])]
    return [sorted(set(cuts[i])) if i in cuts else middle(sorted(values.get(i, []))) for i in range(width)]


def _doubles(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width) if len(column) else np.zeros((0, width))


def binned(x: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """(rows, columns) bins: a value up to an edge lies in its bin, so bins up to b are the values up to edge b."""
    out = np.zeros((len(x), len(edges)), np.uint8)
    for i, e in enumerate(edges):
        out[:, i] = np.searchsorted(e, x[:, i], side="left")
    return out


def bin_column(column: str, edges: list[list[float]]) -> Column:
    """A vector column as bytes, one for each of its columns."""
    width = len(edges)

    def cut(c: pa.Array) -> pa.Array:
        codes = binned(_doubles(c, width), edges)
        return pa.array([r.tobytes() for r in codes], pa.binary())

    return F.arrow_udf(cut, "binary")(vector_to_array(column))


def _codes(column: pa.ChunkedArray, width: int) -> np.ndarray:
    parts = [np.zeros((0, width), np.uint8)]
    for c in column.chunks:
        c = c.cast(pa.large_binary())
        if len(c):
            ends = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
            parts.append(np.frombuffer(c.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].reshape(len(c), width))
    return np.concatenate(parts)


# --- tasks ----------------------------------------------------------------------------------------------


def spread_keys(spark: SparkSession, n: int) -> list[int]:
    """n keys that a shuffle over n partitions deals one to each."""
    found = spark.range(20 * n + 100).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id"))
    taken = {r.p: r.id for r in found.collect()}
    return [taken.get(p, -1 - p) for p in range(n)]


def grow(rows: DataFrame, forests: list[dict], classes: int, features: str = "features", weight: str | None = None) -> list[GrownForest]:
    """One forest for each set of parameters, all on the same rows (features, label from 0, weight), by one task a group of trees."""
    spark = rows.sparkSession
    first = rows.select(F.size(vector_to_array(features)).alias("n")).first()
    width = first.n if first else 0
    edges = edges_of(rows, features, width)
    bins, draw = max((len(e) for e in edges), default=0) + 1, lambda p: width if p["numTrees"] == 1 else None
    given = F.col(weight).cast("double") if weight else F.lit(None).cast("double")
    held = materialise(rows.select(F.monotonically_increasing_id().alias("row"), bin_column(features, edges).alias("codes") if width else F.lit(b"").alias("codes"), F.col("label").cast("int").alias("label"), given.alias("weight")), "forest-rows")
    groups = [(f, g, p["numTrees"], p) for f, p in enumerate(forests) for g in range(-(-p["numTrees"] // GROUP))]
    keys = spread_keys(spark, len(groups))
    asked = dict(zip(keys, groups))

    def trees(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        f, g, many, p = asked[key[0].as_py()]
        order = np.argsort(table["row"].to_numpy())
        codes, y = _codes(table["codes"], width)[order], table["label"].to_numpy()[order].astype(np.int64)
        w = table["weight"].to_numpy()[order].astype(float) if weight else None
        del table
        out = []
        for t in range(g * GROUP, min(many, (g + 1) * GROUP)):
            rng = np.random.default_rng([p.get("seed", 42) & (1 << 62) - 1, t])
            tree = grow_tree(codes, y, w, classes, bins, rng, p.get("subsamplingRate", 1.0), p.get("maxDepth", 5), p.get("minInstancesPerNode", 1), draw(p))
            out.append([f, g, t, *tree.bytes()])
        kinds = [pa.int32()] * 3 + [pa.binary()] * 4
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[c.split()[0] for c in TREES.split(", ")])

    dealt = held.withColumn("key", F.explode(F.array(*map(F.lit, keys)))).repartition(len(keys), "key")
    path = scratch_path(spark, "forest")
    dealt.groupBy("key").applyInArrow(trees, TREES).write.parquet(path)
    return [GrownForest(path=path, edges=json.dumps(edges), numClasses=classes, forest=f, numTrees=p["numTrees"], featuresCol=features) for f, p in enumerate(forests)]


def over_trees(models: list[GrownForest], rows: DataFrame, kernel, width: int, extra: str = "") -> DataFrame:
    """(forest, row, v): the sums over all trees of a forest of what a kernel adds for a row, `width` numbers.

    models: forests grown on the same rows. rows: written, with row, codes and the columns named in `extra`.
    kernel(tree, codes, extra columns, out) adds to out, an array (rows, width).
    """
    spark = rows.sparkSession
    columns, classes, many = models[0].width(), models[0].getOrDefault("numClasses"), rows.count()
    blocks = max(1, -(-many // max(1_024, min(BLOCK_ROWS, BLOCK_BYTES // (8 * width)))))
    groups = [(m.getOrDefault("forest"), g) for m in models for g in range(-(-m.getOrDefault("numTrees") // GROUP))]
    keys = spread_keys(spark, blocks * len(groups))
    lists = F.array(*[F.array(*map(F.lit, keys[b * len(groups) : (b + 1) * len(groups)])) for b in range(blocks)])
    named = [c for c in extra.split(", ") if c]

    def walk(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        x, row = _codes(left["codes"], columns), left["row"].to_numpy()
        more = [_codes(left[c], columns) if pa.types.is_binary(left[c].type) or pa.types.is_large_binary(left[c].type) else left[c].to_numpy() for c in named]
        out = np.zeros((len(x), width))
        if len(x):
            held = right.sort_by("tree").to_pylist()
            for r in held:
                tree = Tree.read(r["feature"], r["cut"], r["child"], r["counts"], classes)
                for lo in range(0, len(x), CHUNK):
                    own = slice(lo, lo + CHUNK)
                    kernel(tree, x[own], [m[own] for m in more], out[own])
        f, g = (right["forest"][0].as_py(), right["grp"][0].as_py()) if len(right) else (0, 0)
        v = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), pa.array(out.ravel()))
        return pa.table([pa.array(np.full(len(x), f, np.int32)), pa.array(np.full(len(x), g, np.int32)), pa.array(row), v], names=["forest", "grp", "row", "v"])

    spread = rows.select("row", "codes", *named, F.explode(F.get(lists, F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))).alias("key")).repartition(len(keys), "key")
    turn = F.create_map(*[F.lit(v) for i, (f, g) in enumerate(groups) for v in (f * 1_000_000 + g, i)])[F.col("forest") * 1_000_000 + F.col("grp")]
    trees = spark.read.schema(TREES).parquet(models[0].getOrDefault("path")).withColumn("key", F.explode(F.transform(lists, lambda own: F.get(own, turn)))).where("key is not null").repartition(len(keys), "key")
    said = spread.groupBy("key").cogroup(trees.groupBy("key")).applyInArrow(walk, "forest int, grp int, row long, v array<double>")
    if len(groups) == len(models):
        return said.drop("grp")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("grp", "v"))), lambda e: e["v"])
    total = F.aggregate(parts, F.array_repeat(F.lit(0.0), width), lambda a, v: F.zip_with(a, v, lambda p, q: p + q))
    return said.groupBy("forest", "row").agg(total.alias("v"))


def votes(tree: Tree, x: np.ndarray, more: list, out: np.ndarray) -> None:
    """Kernel: the class shares of the leaves, by class."""
    out += tree.share[tree.down(x, np.zeros(len(x), np.int64))]


def paths(tree: Tree, x: np.ndarray, more: list, out: np.ndarray) -> None:
    """Kernel: the changes of the share of a row's class along its path, by column, and that of the root."""
    (label,) = more
    for going, here, column, after in tree.steps(x):
        out[going, column] += tree.share[after, label[going]] - tree.share[here, label[going]]
    out[:, -1] += tree.share[0, label]


def _replaced(tree: Tree, x: np.ndarray, other: np.ndarray):
    """(rows, column, leaf reached, leaf of the row as it is) for every row and column of its path that ends elsewhere with the other row's value there.

    Up to the first node that sends the other value to the other side the walk is that of the row itself; only the rest is walked anew.
    """
    found, done, end = [], np.zeros(x.shape, bool), np.zeros(len(x), np.int64)
    for going, here, column, after in tree.steps(x):
        end[going] = after
        v = other[going, column]
        aside = tree.child[here] + (v > tree.cut[here])
        new = np.flatnonzero((aside != after) & ~done[going, column])
        done[going[new], column[new]] = True
        found.append((going[new], column[new], tree.down(x[going[new]], aside[new], column[new], v[new])))
    for rows, column, leaf in found:
        yield rows, column, leaf, end[rows]


def replaced_votes(tree: Tree, x: np.ndarray, more: list, out: np.ndarray) -> None:
    """Kernel: by column and class, how the votes change when the other row's value stands in the column."""
    classes = tree.share.shape[1]
    wide = out.reshape(len(x), -1, classes)
    for rows, column, leaf, end in _replaced(tree, x, more[0]):
        wide[rows, column] += tree.share[leaf] - tree.share[end]


def replaced_share(tree: Tree, x: np.ndarray, more: list, out: np.ndarray) -> None:
    """Kernel: by column, how the votes for a row's class change when the other row's value stands in the column."""
    other, label = more
    for rows, column, leaf, end in _replaced(tree, x, other):
        out[rows, column] += tree.share[leaf, label[rows]] - tree.share[end, label[rows]]


# --- the model --------------------------------------------------------------------------------------------


class TreeGroup:
    """A group of trees of a grown forest."""

    def __init__(self, model: GrownForest, group: int):
        self.model, self.group = model, group

    @property
    def getNumTrees(self) -> int:
        return min(GROUP, self.model.getOrDefault("numTrees") - self.group * GROUP)

    @property
    def toDebugString(self) -> str:
        """The trees as text; this group's nodes reach the driver."""
        edges, lines = json.loads(self.model.getOrDefault("edges")), [f"TreeGroup with {self.getNumTrees} trees"]
        for number, tree in self.model.trees(self.group):
            lines.append(f"  Tree {number}:")
            todo = [(0, "    ")]
            while todo:
                at, pad = todo.pop()
                f = tree.feature[at]
                lines.append(f"{pad}Predict: {int(tree.counts[at].argmax())}.0" if f < 0 else f"{pad}feature {f} <= {edges[f][tree.cut[at]]}")
                todo += [] if f < 0 else [(tree.child[at] + 1, pad + " "), (tree.child[at], pad + " ")]
        return "\n".join(lines)


class GrownForest(Model, HasFeaturesCol, HasProbabilityCol, DefaultParamsReadable, DefaultParamsWritable):
    """A forest whose trees are a table; `copy_trees` takes them along where the model is saved."""

    path = Param(Params._dummy(), "path", "folder of the trees", TypeConverters.toString)
    edges = Param(Params._dummy(), "edges", "upper bounds of the bins by column, as JSON", TypeConverters.toString)
    numClasses = Param(Params._dummy(), "numClasses", "number of classes", TypeConverters.toInt)
    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    forest = Param(Params._dummy(), "forest", "number of the forest in its folder", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, path="", edges="[]", numClasses=2, numTrees=0, forest=0, featuresCol="features", probabilityCol="probability"):
        super().__init__()
        self._setDefault(path="", edges="[]", numClasses=2, numTrees=0, forest=0, featuresCol="features", probabilityCol="probability")
        self._set(**self._input_kwargs)

    def groups(self) -> list[TreeGroup]:
        return [TreeGroup(self, g) for g in range(-(-self.getOrDefault("numTrees") // GROUP))]

    def table(self) -> DataFrame:
        return SparkSession.active().read.schema(TREES).parquet(self.getOrDefault("path")).where(F.col("forest") == self.getOrDefault("forest"))

    def trees(self, group: int | None = None) -> list[tuple[int, Tree]]:
        """The trees (of a group) with their numbers, in the driver."""
        got = self.table() if group is None else self.table().where(F.col("grp") == group)
        return [(r.tree, Tree.read(r.feature, r.cut, r.child, r.counts, self.getOrDefault("numClasses"))) for r in got.orderBy("tree").collect()]

    def copy_trees(self, path: str) -> None:
        self.table().write.parquet(path)

    def width(self) -> int:
        return len(json.loads(self.getOrDefault("edges")))

    def codes(self) -> Column:
        """The features as bytes of bins."""
        edges = json.loads(self.getOrDefault("edges"))
        return bin_column(self.getFeaturesCol(), edges) if edges else F.lit(b"")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        classes, trees = self.getOrDefault("numClasses"), self.getOrDefault("numTrees")
        if dataset.isStreaming:
            return dataset.withColumn(self.getProbabilityCol(), array_to_vector(self._here()))
        # columns without a type cannot be written
        empty = [c for c, kind in dataset.dtypes if kind == "void"]
        held = materialise(dataset.drop(*empty).withColumns({"_row": F.monotonically_increasing_id(), "_codes": self.codes()}), "scored-rows")
        said = over_trees([self], held.select(F.col("_row").alias("row"), F.col("_codes").alias("codes")), votes, classes)
        share = F.transform("v", lambda v: v / trees)
        got = held.drop("_codes").join(said.select(F.col("row").alias("_row"), array_to_vector(share).alias(self.getProbabilityCol())), "_row")
        return got.select(*[F.lit(None).alias(c) if c in empty else F.col(f"`{c}`") for c in dataset.columns], self.getProbabilityCol())

    def _here(self) -> Column:
        """Class shares row by row, for a stream; the trees go through the driver to every task."""
        edges, classes, held = json.loads(self.getOrDefault("edges")), self.getOrDefault("numClasses"), self.trees()

        def score(column: pa.Array) -> pa.Array:
            x = binned(_doubles(column, len(edges)), edges)
            out = np.zeros((len(x), classes))
            for _, tree in held:
                votes(tree, x, [], out)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * classes), pa.array((out / len(held)).ravel()))

        return F.arrow_udf(score, "array<double>")(vector_to_array(self.getFeaturesCol()))
