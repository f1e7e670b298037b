"""Hard-negative mining by coordinate pruning in length buckets.

The rows are dealt to shards and the queries (anchors) to groups, both of a bounded number of rows; a
task has one shard and one group. For positives both hold rows of the same labels. Inside a task a shard
is sorted by label and length and cut into buckets. A bucket holds a sorted list of every coordinate of its normalised rows. For an anchor and
a least score, the score divided by both lengths bounds the cosine from below, which leaves an interval of
feasible values for each coordinate; the intervals of the anchor's FOCUS largest coordinates are looked up
in the sorted lists, rows in all of them are candidates, and candidates are verified by exact inner
products of integers. A bucket whose length bound is too small is skipped. Where intervals exclude
little, the whole bucket is verified at once.

Positives first: the best rows of the anchor's own label, with the running k-th score as the least
score. Their scores then bound the negatives from both sides. A task returns at most k rows for
each anchor (positives) or each anchor and positive (negatives), and the best over all tasks stay. With many
shards a first wave over the square root of their number gives every anchor a k-th score that the
other shards must reach, so the rows handed on grow with that root only.

Cases: rows with a null label or vector, or a null or non-finite component, take no part, nor do
vectors of a squared length of 2^60 or more after scaling, whose scores do not fit; shorter vectors
count as filled up with zeros; several rows of one id are one row, the one with the smallest label
and vector; rows without an id take part under distinct hidden ids above all others, equal ones once;
anchors without positives or without negatives in range have no rows; a positive with a negative
score has none; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialise
from .vector_codes import scaled, usable
from ..session import broadcast_if_small

POSITIVES = NEGATIVES = 5
FOCUS = 3
BUCKET = 2_048
#: Rows of a shard and anchors of a group; a table has at least SHARDS shards, and from WAVES on they are searched in two waves.
SHARD, GROUP, SHARDS, WAVES = 131_072, 32_768, 8, 16
#: Ids of rows without one lie above all others.
LOOSE = 1 << 62
LONGEST = 1 << 60


def prepare(vectors: DataFrame, vec_id: str, vector: str, label: str | Column) -> DataFrame:
    """id, label, v (array of longs), norm (squared length): rows that take part, one for each id."""
    label = F.col(label) if isinstance(label, str) else label
    good = vectors.where(usable(vector) & label.isNotNull()).select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), scaled(vector).alias("v"))
    real = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    good = good.where(real < float(LONGEST)).withColumn("id", F.coalesce("id", F.lit(LOOSE) + F.shiftrightunsigned(F.xxhash64("label", "v"), 2)))
    one = good.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.*")
    return one.withColumn("norm", F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x))


class Bucket:
    """Rows of one label and of similar length; sorted lists of coordinates are made when first asked for."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, norm: np.ndarray, label: int):
        self.ids, self.points, self.label = ids, points, label
        self.length = np.sqrt(norm.astype(np.float64))
        self.longest, self.shortest = float(self.length.max()), float(self.length.min())
        self.unit = points / np.maximum(self.length, 1e-300)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = order, self.unit[order, f]
        return self.lists[f]

    def candidates(self, unit: np.ndarray, length: float, least: float, focus: np.ndarray) -> np.ndarray | None:
        """Rows that may reach the least score with the query; None for all of them."""
        if least <= 0:
            return None
        bound = least / (length * self.longest) if length * self.longest > 0 else np.inf
        if bound > 1 + 1e-9:
            return np.zeros(0, np.int64)
        bound = min(bound, 1.0)
        # the angle to a coordinate's axis differs from the query's by the angle of the bound at most
        wide, q = np.arccos(bound), np.arccos(np.clip(unit[focus], -1, 1))
        low, high = np.cos(np.minimum(q + wide, np.pi)) - 1e-9, np.cos(np.maximum(q - wide, 0.0)) + 1e-9
        spans = []
        for f, lo, hi in zip(focus.tolist(), low.tolist(), high.tolist()):
            order, values = self.sorted_list(f)
            spans.append((order, int(np.searchsorted(values, lo, "left")), int(np.searchsorted(values, hi, "right"))))
        spans.sort(key=lambda s: s[2] - s[1])
        if spans[0][2] - spans[0][1] > len(self.ids) // 2:
            return None
        seen = np.zeros(len(self.ids), np.int8)
        for order, lo, hi in spans:
            seen[order[lo:hi]] += 1
        return np.flatnonzero(seen == len(spans))

    def scores(self, queries: np.ndarray, rows: np.ndarray | None, exact_in_doubles: bool) -> np.ndarray:
        own = self.points if rows is None else self.points[rows]
        if exact_in_doubles:  # all partial sums stay below 2^53
            return (queries.astype(np.float64) @ own.T.astype(np.float64)).astype(np.int64)
        return queries @ own.T


def cut_buckets(ids: np.ndarray, points: np.ndarray, norm: np.ndarray, label: np.ndarray, size: int = BUCKET) -> list[Bucket]:
    order = np.lexsort((ids, -norm, label))
    ids, points, norm, label = ids[order], points[order], norm[order], label[order]
    edges = np.flatnonzero(np.append(True, label[1:] != label[:-1])).tolist() if len(ids) else []
    out = []
    for lo, hi in zip(edges, edges[1:] + [len(ids)]):
        for at in range(lo, hi, size):
            upto = min(hi, at + size)
            out.append(Bucket(ids[at:upto], points[at:upto], norm[at:upto], int(label[at])))
    return out


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    if len(ids) > 8 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def mine_positives(buckets: list[Bucket], anchor: np.ndarray, label: np.ndarray, points: np.ndarray, norm: np.ndarray, bound: list[int | None], k: int, exact: bool):
    """(anchor, id, score): the k best rows of each anchor's label in these buckets that reach its bound; longest buckets first."""
    length = np.sqrt(norm.astype(np.float64))
    unit = points / np.maximum(length, 1e-300)[:, None]
    for a in np.unique(label).tolist():
        own = [b for b in buckets if b.label == a]
        mine = np.flatnonzero(label == a)
        held = {i: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for i in mine.tolist()}
        for b in sorted(own, key=lambda b: -b.longest):
            least = [max(held[i][1].min() if len(held[i][1]) >= k else -np.inf, -np.inf if bound[i] is None else bound[i]) for i in mine.tolist()]
            whole, part = _sift(b, mine, unit, length, least)
            for some, rows in [(whole, None)] * bool(len(whole)) + [(np.array([i]), r) for i, r in part]:
                got = b.scores(points[some], rows, exact)
                ids = b.ids if rows is None else b.ids[rows]
                for i, s in zip(some.tolist(), got):
                    other = ids != anchor[i] if bound[i] is None else (ids != anchor[i]) & (s >= bound[i])
                    x, y = np.concatenate((held[i][0], ids[other])), np.concatenate((held[i][1], s[other]))
                    top = best(x, y, k)
                    held[i] = x[top], y[top]
        for i, (ids, scores) in held.items():
            yield from ((anchor[i], x, y) for x, y in zip(ids.tolist(), scores.tolist()))


def _sift(b: Bucket, queries: np.ndarray, unit: np.ndarray, length: np.ndarray, least: list[float]) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Queries that verify the whole bucket, and the candidates of the others."""
    whole, part = [], []
    if len(queries):
        focus = np.argsort(-np.abs(unit[queries]), axis=1, kind="stable")[:, :FOCUS]
        for q, (i, t) in enumerate(zip(queries.tolist(), least)):
            rows = b.candidates(unit[i], length[i], t, focus[q])
            if rows is None:
                whole.append(i)
            elif len(rows):
                part.append((i, rows))
    return np.array(whole, np.int64), part


def lowest(score: int) -> int:
    """Smallest negative score that is 80 % of a positive score or more."""
    return -((-4 * score) // 5)


def mine_negatives(buckets: list[Bucket], anchor: np.ndarray, label: np.ndarray, points: np.ndarray, norm: np.ndarray, positives: list[list[tuple[int, int, int | None]]], k: int, exact: bool):
    """(anchor, positive, positive score, id, score): for each positive (id, score, bound) the k best rows of other labels in its range."""
    length = np.sqrt(norm.astype(np.float64))
    unit = points / np.maximum(length, 1e-300)[:, None]
    held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    ranges = [[(p, s, lowest(s) if bound is None else max(lowest(s), bound)) for p, s, bound in own if s >= 0] for own in positives]

    def least(i: int) -> float:
        # below the k-th score found for a positive nothing can enter any more
        return min((max(lo, held[i, p][1].min()) if (i, p) in held and len(held[i, p][1]) >= k else lo) for p, _, lo in ranges[i])

    for b in sorted(buckets, key=lambda b: -b.longest):
        asked = np.array([i for i in range(len(anchor)) if ranges[i] and label[i] != b.label], np.int64)
        whole, part = _sift(b, asked, unit, length, [least(i) for i in asked.tolist()])
        for some, rows in [(whole, None)] * bool(len(whole)) + [(np.array([i]), r) for i, r in part]:
            got = b.scores(points[some], rows, exact)
            ids = b.ids if rows is None else b.ids[rows]
            for i, s in zip(some.tolist(), got):
                floor, ceiling = min(lo for _, _, lo in ranges[i]), max(hi for _, hi, _ in ranges[i])
                near = np.flatnonzero((s >= floor) & (s <= ceiling))
                if not len(near):
                    continue
                for p, hi, lo in ranges[i]:
                    fit = near[(s[near] >= lo) & (s[near] <= hi)]
                    if len(fit):
                        x, y = held.get((i, p), (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                        x, y = np.concatenate((x, ids[fit])), np.concatenate((y, s[fit]))
                        top = best(x, y, k)
                        held[i, p] = x[top], y[top]
    score = [{p: s for p, s, _ in own} for own in positives]
    for (i, p), (ids, scores) in held.items():
        yield from ((anchor[i], p, score[i][p], x, y) for x, y in zip(ids.tolist(), scores.tolist()))


def _points(column: pa.Array) -> np.ndarray:
    """Matrix of integer vectors, shorter ones filled up with zeros."""
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), int(size.max(initial=0))), np.int64)
    at = np.repeat(np.arange(len(column)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[at] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _fit(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = max(a.shape[1], b.shape[1])
    fill = lambda x: np.pad(x, ((0, 0), (0, n - x.shape[1])))
    return fill(a), fill(b)


POSITIVE_SCHEMA = "anchor long, positive long, positive_score long"
NEGATIVE_SCHEMA = "anchor long, positive long, positive_score long, negative long, negative_score long"


def _task(negatives: bool, k: int, size: int):
    """One shard against one group of anchors."""
    names = (NEGATIVE_SCHEMA if negatives else POSITIVE_SCHEMA).replace(" long", "").split(", ")

    def rows(stored: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if stored.num_rows and asked.num_rows:
            stored, asked = stored.combine_chunks(), asked.sort_by("id").combine_chunks()
            ids, label, norm = (stored.column(c).to_numpy() for c in ("id", "label", "norm"))
            points, queries = _fit(_points(stored.column("v").combine_chunks()), _points(asked.column("v").combine_chunks()))
            buckets = cut_buckets(ids, points, norm, label, size)
            anchor, own, length = (asked.column(c).to_numpy() for c in ("id", "label", "norm"))
            exact = float(norm.max()) * float(length.max()) < 2.0**104
            if negatives:
                wanted = [[(p["positive"], p["positive_score"], p["bound"]) for p in r] for r in asked.column("positives").to_pylist()]
                out = list(mine_negatives(buckets, anchor, own, queries, length, wanted, k, exact))
            else:
                out = list(mine_positives(buckets, anchor, own, queries, length, asked.column("bound").to_pylist(), k, exact))
        columns = zip(*out) if out else [[]] * len(names)
        return pa.table({n: pa.array(list(map(int, c)), pa.int64()) for n, c in zip(names, columns)})

    return rows


def _ranked(found: DataFrame, keys: list[str], name: str, k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(f"{name}_score").desc(), name)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _meet(rows: DataFrame, anchors: DataFrame, keys: list[str], task, schema: str) -> DataFrame:
    """Every shard with every group: rows go to all groups of their key, anchors to all shards. Both carry n_shards, n_groups, shard, group."""
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    fresh = lambda df: df.toDF(*df.columns).groupBy(*keys, "shard", "group")
    dealt, asked = rows.withColumn("group", all_of("n_groups")), anchors.withColumn("shard", all_of("n_shards"))
    return fresh(dealt).cogroup(fresh(asked)).applyInArrow(task, schema)


def hard_negatives(
    vectors: DataFrame, anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str | Column = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, shard: int = SHARD, group: int = GROUP, bucket: int = BUCKET, waves: int = WAVES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchor: predicate on the column id. For each anchor and each of its best rows of the same label, the best
    rows of other labels with 80 to 100 % of the positive's score, best first.
    """
    rows = materialise(prepare(vectors, vec_id, vector, label), "vectors")
    anchors = rows.where((F.col("id") < LOOSE) & anchor)
    n, asked = rows.count(), anchors.count()
    each = min(shard, max(1, -(-n // SHARDS)))
    place = lambda n_parts: F.pmod(F.xxhash64("id"), F.col(n_parts))
    parts = lambda n_rows, most: F.ceil(F.col(n_rows) / most).cast("long")

    # positives: shards and groups of one label; labels of one shard and one group share tasks
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count(F.when((F.col("id") < LOOSE) & anchor, 1)).alias("a")).where("a > 0")
    cut = counts.select("label", parts("n", each).alias("n_shards"), parts("a", group).alias("n_groups"))
    cut = cut.withColumn("alone", (F.col("n_shards") > 1) | (F.col("n_groups") > 1))
    cut = materialise(cut.withColumn("home", F.when(F.col("alone"), F.col("label")).otherwise(F.pmod(F.xxhash64("label"), F.lit(max(1, n // each))))), "label-parts")
    mine = rows.join(broadcast_if_small(cut), "label").withColumn("shard", place("n_shards"))
    theirs = anchors.join(broadcast_if_small(cut), "label").withColumn("group", place("n_groups")).withColumn("bound", F.lit(None).cast("long"))
    keys = ["alone", "home"]
    run = lambda some, who: _meet(some, who, keys, _task(False, positives, bucket), POSITIVE_SCHEMA)
    early = F.when(F.col("n_shards") < waves, F.lit(True)).otherwise(F.col("shard") < F.ceil(F.sqrt("n_shards")))
    found = run(mine.where(early), theirs)
    if cut.where(F.col("n_shards") >= waves).head(1):
        found = materialise(_ranked(found, ["anchor"], "positive", positives).drop("rank"), "first-positives")
        kth = found.groupBy("anchor").agg(F.min("positive_score").alias("kth"), F.count(F.lit(1)).alias("have"))
        known = theirs.where(F.col("n_shards") >= waves).join(kth, F.col("id") == F.col("anchor"), "left")
        known = known.withColumn("bound", F.when(F.col("have") >= positives, F.col("kth"))).drop("anchor", "kth", "have")
        found = found.unionByName(run(mine.where(~early), known))
    best_of_label = materialise(_ranked(found, ["anchor"], "positive", positives).drop("rank"), "positives")

    # negatives: every shard with every group
    n_shards, n_groups = max(1, -(-n // each)), max(1, -(-asked // group))
    spread = lambda df: df.withColumn("n_shards", F.lit(n_shards).cast("long")).withColumn("n_groups", F.lit(n_groups).cast("long"))
    stored = spread(rows).withColumn("shard", place("n_shards"))
    have = best_of_label.withColumn("bound", F.lit(None).cast("long"))

    def mine_shards(some: DataFrame, have: DataFrame) -> DataFrame:
        listed = have.groupBy("anchor").agg(F.collect_list(F.struct("positive", "positive_score", "bound")).alias("positives"))
        who = spread(anchors.join(listed, F.col("id") == F.col("anchor")).drop("anchor")).withColumn("group", place("n_groups"))
        return _meet(some, who, [], _task(True, negatives, bucket), NEGATIVE_SCHEMA)

    first = int(np.ceil(np.sqrt(n_shards))) if n_shards >= waves else n_shards
    got = mine_shards(stored.where(F.col("shard") < first), have)
    if first < n_shards:
        got = materialise(_ranked(got, ["anchor", "positive"], "negative", negatives).drop("rank"), "first-negatives")
        kth = got.groupBy("anchor", "positive").agg(F.min("negative_score").alias("kth"), F.count(F.lit(1)).alias("have"))
        have = have.join(kth, ["anchor", "positive"], "left").withColumn("bound", F.when(F.col("have") >= negatives, F.col("kth"))).drop("kth", "have")
        got = got.unionByName(mine_shards(stored.where(F.col("shard") >= first), have))
    shown = lambda c: F.when(F.col(c) < LOOSE, F.col(c))
    return _ranked(got, ["anchor", "positive"], "negative", negatives).select(
        F.col("anchor").alias("anchor_id"), shown("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        shown("negative").alias("negative_id"), "positive_score", "negative_score",
    )
