"""Product codes of vectors, with metric trees over the parts.

A vector is cut into PARTS consecutive parts and each part is coded by the nearest of ENTRIES entries
of its position's codebook. Vectors travel in blocks of at most BLOCK rows. For every block and part
an anchors hierarchy is built once: about sqrt(n) anchors take their points from one another (a new
anchor is the point farthest from its owner; it looks only at owners whose radius it can undercut),
the anchors' balls are joined upwards two by two into the smallest enclosing ball, and large anchors are
divided downwards in the same way, so the tree grows from the middle out. Balls cache the sum and
the number of their points. The trees are written once and read by every round.

In a round a ball inherits its parent's candidate entries as a bit mask. An entry is struck off once the
ball lies wholly on the nearer side of the bisector with the entry nearest to the ball's centre; with one
candidate left the cached sum and number go to it, and the points of a leaf are compared with its candidates.
Assignments are exact: distances are of integers, bisectors keep a margin, ties go to the lower index.

Rounds exchange only one row per task, part and entry (sums and counts); the driver holds the codebooks,
PARTS * ENTRIES entries at any size of the table.

Cases: null vectors and those with null or non-finite components are dropped; so are vectors of another
dimension than that of the smallest id and those with a scaled component of 2^27 or more, whose errors do not
fit; a dimension that PARTS does not divide is filled up with zeros; fewer rows than ENTRIES give smaller
codebooks; equal ids are rows of their own, ordered by vector, null ids come last; null labels are one
label; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from ..session import broadcast_if_small

PARTS, ENTRIES, ROUNDS = 16, 64, 2
BLOCK, LEAF = 4_096, 48
MOST = 1 << 27

TREE_SCHEMA = "rows long, vec_ids array<long>, labels array<int>, points binary, trees array<struct<order binary, first binary, last binary, left binary, sums binary, centre binary, radius binary>>"


def scaled(vector: str) -> Column:
    """Components as floor(256 * x)."""
    return F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * 256))


def usable(vector: str) -> Column:
    """No component is null, not a number or infinite."""
    fine = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(fine, F.lit(False))


class Tree:
    """Balls of one block and part; the children of ball i are left[i] and left[i] + 1, 0 marks a leaf.

    order: points so that a ball is the stretch first[i] .. last[i] of it.
    """

    FIELDS = {"order": np.int32, "first": np.int32, "last": np.int32, "left": np.int32, "sums": np.int64, "centre": np.float64, "radius": np.float64}

    @classmethod
    def of(cls, points: np.ndarray, leaf: int = LEAF) -> Tree:
        self = cls()
        shape = _grow(points.astype(np.float64), np.arange(len(points)), leaf)
        order: list[np.ndarray] = []
        first, last, left = [0], [0], [0]
        stack, filled = [(shape, 0)], 0
        while stack:  # leaves are laid down from left to right, children side by side
            ball, at = stack.pop()
            first[at], last[at] = filled, filled + ball.n
            if ball.kids is None:
                order.append(ball.own)
                filled += ball.n
            else:
                left[at] = len(first)
                first += [0, 0]
                last += [0, 0]
                left += [0, 0]
                stack += [(ball.kids[1], left[at] + 1), (ball.kids[0], left[at])]
        self.order = np.concatenate(order).astype(np.int32) if order else np.zeros(0, np.int32)
        self.first, self.last, self.left = (np.array(x, np.int32) for x in (first, last, left))
        total = np.concatenate((np.zeros((1, points.shape[1]), np.int64), np.cumsum(points[self.order], axis=0)))
        self.sums = total[self.last] - total[self.first]
        self.centre = self.sums / np.maximum(self.last - self.first, 1)[:, None]
        self.radius = np.zeros(len(first))
        for at in range(len(first)):
            own = points[self.order[self.first[at] : self.last[at]]] - self.centre[at]
            self.radius[at] = np.sqrt((own * own).sum(1).max(initial=0.0))
        return self

    def packed(self) -> dict[str, bytes]:
        return {name: np.ascontiguousarray(getattr(self, name), kind).tobytes() for name, kind in self.FIELDS.items()}

    @classmethod
    def unpacked(cls, fields: dict[str, bytes], width: int) -> Tree:
        self = cls()
        for name, kind in cls.FIELDS.items():
            flat = np.frombuffer(fields[name], kind)
            setattr(self, name, flat.reshape(-1, width) if name in ("sums", "centre") else flat)
        return self

    def assign(self, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(entry of every point, sums and counts of every entry, balls that were owned whole)."""
        n, k = len(points), len(entries)
        code, sums, counts, whole = np.zeros(n, np.int64), np.zeros_like(entries), np.zeros(k, np.int64), 0
        real = entries.astype(np.float64)
        gap = np.sqrt(((real[:, None] - real[None]) ** 2).sum(-1))
        balls, open_ = np.zeros(1 if n else 0, np.int64), np.ones((1 if n else 0, k), bool)
        while len(balls):
            d = ((self.centre[balls, None] - real[None]) ** 2).sum(-1)
            best = np.where(open_, d, np.inf).argmin(1)
            near = d[np.arange(len(balls)), best]
            # distance of the centre to the bisector with the nearest entry; a margin covers rounding
            far = d - near[:, None] > 2 * gap[best] * self.radius[balls, None] * (1 + 1e-9) + 1e-7 * (1 + d)
            open_ = open_ & ~far
            open_[np.arange(len(balls)), best] = True
            owned, leaf = open_.sum(1) == 1, self.left[balls] == 0
            np.add.at(sums, best[owned], self.sums[balls[owned]])
            np.add.at(counts, best[owned], (self.last - self.first)[balls[owned]])
            whole += int(owned.sum())
            for at, entry in zip(balls[owned].tolist(), best[owned].tolist()):
                code[self.order[self.first[at] : self.last[at]]] = entry
            ends = np.flatnonzero(leaf & ~owned)
            if len(ends):
                held = (self.last - self.first)[balls[ends]]
                who = np.repeat(ends, held)
                at = self.order[np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held) + np.repeat(self.first[balls[ends]], held)]
                dist = ((points[at, None] - entries[None]) ** 2).sum(-1)
                got = np.where(open_[who], dist, np.iinfo(np.int64).max).argmin(1)
                code[at] = got
                np.add.at(sums, got, points[at])
                np.add.at(counts, got, 1)
            deeper = ~leaf & ~owned
            balls, open_ = np.concatenate((self.left[balls[deeper]], self.left[balls[deeper]] + 1)).astype(np.int64), np.concatenate((open_[deeper], open_[deeper]))
        return code, sums, counts, whole


class _Ball:
    __slots__ = ("own", "n", "kids", "centre", "radius")

    def __init__(self, own, n, kids, centre, radius):
        self.own, self.n, self.kids, self.centre, self.radius = own, n, kids, centre, radius


def _anchors(points: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner of every point, anchor points): every point belongs to its nearest anchor, by stealing."""
    anchors = [0]
    dist = np.sqrt(((points - points[0]) ** 2).sum(1))
    owner = np.zeros(len(points), np.int64)
    while len(anchors) < most:
        new = int(dist.argmax())
        if dist[new] <= 0:
            break
        radius = np.zeros(len(anchors))
        np.maximum.at(radius, owner, dist)
        reach = np.sqrt(((points[anchors] - points[new]) ** 2).sum(1))
        # an owner whose radius is below half the way to the new anchor loses nothing
        rich = np.flatnonzero((2 * radius >= reach)[owner] & (2 * dist >= reach[owner]))
        d = np.sqrt(((points[rich] - points[new]) ** 2).sum(1))
        taken = d < dist[rich]
        dist[rich[taken]], owner[rich[taken]] = d[taken], len(anchors)
        anchors.append(new)
    return owner, np.array(anchors)


def _grow(points: np.ndarray, own: np.ndarray, leaf: int) -> _Ball:
    """The hierarchy over points (rows named by own)."""
    if not len(points):
        return _Ball(own, 0, None, np.zeros(points.shape[1]), 0.0)
    centre = points.mean(0)
    radius = float(np.sqrt(((points - centre) ** 2).sum(1).max()))
    if len(points) <= leaf or radius == 0:
        return _Ball(own, len(points), None, centre, radius)
    owner, anchors = _anchors(points, max(2, int(np.sqrt(len(points)))))
    if len(anchors) < 2:
        return _Ball(own, len(points), None, centre, radius)
    order = np.argsort(owner, kind="stable")
    cut = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(anchors)))))
    balls = [_grow(points[order[a:b]], own[order[a:b]], leaf) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()) if b > a]
    m = len(balls)
    centres = np.array([b.centre for b in balls] + [np.zeros(points.shape[1])] * (m - 1))
    radii = np.array([b.radius for b in balls] + [0.0] * (m - 1))
    alive = np.zeros(2 * m - 1, bool)
    alive[:m] = True
    cost = np.full((2 * m - 1, 2 * m - 1), np.inf)

    def enclose(i: int, others: np.ndarray) -> None:
        away = np.sqrt(((centres[others] - centres[i]) ** 2).sum(1))
        size = np.maximum(np.maximum((away + radii[others] + radii[i]) / 2, radii[others]), radii[i])
        cost[i, others] = cost[others, i] = size
        cost[i, i] = np.inf

    for i in range(m):
        enclose(i, np.arange(m))
    for new in range(m, 2 * m - 1):  # middle-out: the two balls of the smallest enclosing ball become one
        i, j = divmod(int(cost.argmin()), 2 * m - 1)
        a, b = balls[i], balls[j]
        n = a.n + b.n
        centres[new] = (a.centre * a.n + b.centre * b.n) / n
        away = [float(np.sqrt(((centres[new] - x.centre) ** 2).sum())) + x.radius for x in (a, b)]
        radii[new] = max(away)
        balls.append(_Ball(None, n, (a, b), centres[new], radii[new]))
        alive[[i, j]] = False
        cost[[i, j], :] = cost[:, [i, j]] = np.inf
        enclose(new, np.flatnonzero(alive))
        alive[new] = True
    return balls[-1]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _build(width: int, block: int, leaf: int):
    """Blocks of rows with the trees of their parts."""
    schema = pa.schema(
        [("rows", pa.int64()), ("vec_ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int32())), ("points", pa.binary()), ("trees", pa.list_(pa.struct([(k, pa.binary()) for k in Tree.FIELDS])))]
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                some = batch.slice(at, block)
                points = np.zeros((some.num_rows, width * PARTS), np.int64)
                raw = _matrix(some.column(2))
                points[:, : raw.shape[1]] = raw
                trees = [Tree.of(points[:, p * width : (p + 1) * width], leaf).packed() for p in range(PARTS)]
                one = {"rows": some.num_rows, "vec_ids": some.column(0).to_pylist(), "labels": some.column(1).to_pylist(), "points": points.tobytes(), "trees": trees}
                yield pa.RecordBatch.from_pylist([one], schema=schema)

    return rows


def _blocks(batch: pa.RecordBatch, width: int) -> Iterator[tuple[dict, np.ndarray, list[Tree]]]:
    for row in batch.to_pylist():
        points = np.frombuffer(row["points"], np.int64).reshape(-1, width * PARTS)
        yield row, points, [Tree.unpacked(t, width) for t in row["trees"]]


def _round(books: np.ndarray, width: int):
    """Sums and counts of every part and entry over the blocks of a task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for _, points, trees in _blocks(batch, width):
                for p, tree in enumerate(trees):
                    _, s, c, _ = tree.assign(points[:, p * width : (p + 1) * width], books[p])
                    sums[p] += s
                    counts[p] += c
        p, e = np.nonzero(counts)
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * width), pa.array(sums[p, e].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), values, pa.array(counts[p, e])], names=["part", "entry", "sums", "n"])

    return rows


def _codes(books: np.ndarray, width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, points, trees in _blocks(batch, width):
                code = np.stack([tree.assign(points[:, p * width : (p + 1) * width], books[p])[0] for p, tree in enumerate(trees)], 1)
                chosen = books[np.arange(PARTS)[None], code].reshape(len(points), -1)
                error = ((points - chosen) ** 2).sum(1)
                text = [bytes(r).hex() for r in code.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([pa.array(row["vec_ids"], pa.int64()), pa.array(row["labels"], pa.int32()), pa.array(text, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return rows


def learn(trees: DataFrame, start: np.ndarray, width: int, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width) after the rounds."""
    books = start
    for _ in range(rounds):
        got = trees.mapInArrow(_round(books, width), "part int, entry int, sums array<long>, n long")
        each = [F.sum(F.element_at("sums", i + 1)).alias(f"s{i}") for i in range(width)]
        books = books.copy()
        # one row per part and entry: PARTS * ENTRIES at most
        for r in got.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect():
            books[r.part, r.entry] = [r[f"s{i}"] // r.n for i in range(width)]
    return books


def encode(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = BLOCK, leaf: int = LEAF) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every usable vector, and the codebooks they refer to."""
    spark = vectors.sparkSession
    kept = vectors.where(usable(vector)).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("int").alias("label"), scaled(vector).alias("v"))
    # bounded: the first ENTRIES vectors of the order of ids reach the driver
    head = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    dim = len(head[0].v) if head else 0
    width = max(1, -(-dim // PARTS))
    fits = (F.size("v") == dim) & F.forall("v", lambda x: F.abs(x) < MOST)
    kept = kept.where(fits)
    if head and any(len(r.v) != dim or max(map(abs, r.v), default=0) >= MOST for r in head):
        head = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    start = np.zeros((len(head), width * PARTS), np.int64)
    for i, r in enumerate(head):
        start[i, :dim] = r.v
    books = np.ascontiguousarray(start.reshape(len(head), PARTS, width).transpose(1, 0, 2))
    if not len(head):
        return spark.createDataFrame([], "vec_id long, label int, code string, error long"), books
    trees = materialise(kept.mapInArrow(_build(width, block, leaf), TREE_SCHEMA), "part-trees")
    books = learn(trees, books, width)
    return trees.mapInArrow(_codes(books, width), "vec_id long, label int, code string, error long"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' decimal components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds the error summed over the rows of the same label, nulls together."""
    totals = materialise(coded.groupBy(F.col("label").alias("label_")).agg(F.sum("error").alias("label_error")), "label-errors")
    return coded.join(broadcast_if_small(totals), F.col("label").eqNullSafe(F.col("label_"))).drop("label_")
