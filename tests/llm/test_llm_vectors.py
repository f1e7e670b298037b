"""Hard negatives and part codes against brute force."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayweave.llm import hard_negatives as H
from dayweave.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, id long, n int, v string, rank int, shard int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, 0, 1, "x", 2, 3) for i, v, lab in rows], SCHEMA)


def vectors(rows, dims=8, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    out = [(i, rng.normal(size=dims).astype(np.float32).tolist(), int(rng.integers(3))) for i in range(rows)]
    center = rng.normal(size=dims)
    # a crowded spot with small differences and exact repeats
    out += [(rows + i, (center + 0.01 * rng.integers(0, 3, dims)).astype(np.float32).tolist(), int(rng.integers(3))) for i in range(copies)]
    return out


def fit(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, anchors, k=5):
    q = {}
    for i, v, lab in rows:
        if lab is not None and fit(v):
            q[i] = min(q.get(i, (lab, [])), (lab, [math.floor(256 * x) for x in v])) if i in q else (lab, [math.floor(256 * x) for x in v])
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for a in q:
        if not anchors(a):
            continue
        s = sorted(((-score(q[a][1], v), i) for i, (lab, v) in q.items() if i != a and lab == q[a][0]))[:k]
        n = sorted(((-score(q[a][1], v), i) for i, (lab, v) in q.items() if lab != q[a][0]))
        for p, i in s:
            got = [(x, j) for x, j in n if 80 * -p <= 100 * -x <= 100 * -p][:k]
            out |= {(a, i, r + 1, j, -p, -x) for r, (x, j) in enumerate(got)}
    return out


@pytest.mark.parametrize("sizes", [{}, {"shard": 40, "group": 7, "bucket": 16, "waves": 4}, {"shard": 9, "group": 100, "bucket": 4, "waves": 2}])
def test_hard_negatives_against_all_pairs(spark, sizes):
    rows = vectors(400, copies=120)
    got = H.hard_negatives(table(spark, rows), F.col("id") % 10 == 0, **sizes)
    assert {tuple(r) for r in got.collect()} == brute(rows, lambda i: i % 10 == 0)


def test_hard_negatives_of_odd_rows(spark):
    far, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0, 0.0], 1), (2, [1.0, 1.9], 2), (3, [0.0, 0.0], 2), (4, None, 1), (5, [1.0, None], 1), (6, [far, 1.0], 1), (7, [nan, 1.0], 2), (8, [1.0, 2.0], None)]
    rows += [(9, [], 2), (10, [-1.0, -2.0], 1), (20, [0.0, 0.0], 1), (30, [1e30, 1.0], 1), (40, [3.0, 6.0], 1)]
    want = brute([r for r in rows if r[0] != 30], lambda i: i % 10 == 0)
    df = table(spark, rows + [(2, [9.0, 9.0], 2), (1, [1.0, 2.0, 0.0], 1)])
    assert {tuple(r) for r in H.hard_negatives(df, F.col("id") % 10 == 0).collect()} == want
    loose = table(spark, [(0, [1.0, 2.0], 1), (None, [1.0, 1.9], 2), (None, [1.0, 1.9], 2), (None, [1.0, 2.0], 1)])
    assert [tuple(r) for r in H.hard_negatives(loose, F.col("id") % 10 == 0).collect()] == [(0, None, 1, None, 327680, 256 * 256 + 512 * 486)]
    assert H.hard_negatives(table(spark, []), F.col("id") % 10 == 0).count() == 0


def test_feasible_ranges_prune_and_lose_nothing():
    rng = np.random.default_rng(3)
    points = np.floor(256 * rng.normal(size=(3000, 6)) / np.sqrt(6)).astype(np.int64)
    buckets = H.cut_buckets(np.arange(3000), points, (points**2).sum(1), np.zeros(3000, np.int64), 500)
    query = points[(points**2).sum(1).argmax()]
    length = float(np.sqrt((query**2).sum()))
    focus = np.argsort(-np.abs(query))[: H.FOCUS]
    least, kept = 0.9 * length**2, 0
    for b in buckets:
        rows = b.candidates(query / length, length, least, focus)
        found = np.arange(len(b.ids)) if rows is None else rows
        assert set(np.flatnonzero(b.points @ query >= least)) <= set(found.tolist())
        kept += len(found)
    assert kept < 1500 and all(np.all(np.diff(b.length) <= 0) for b in buckets)


def codes(rows, width=4):
    """codes, errors, books by plain assignment."""
    kept = sorted((r for r in rows if fit(r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([[math.floor(256 * c) for c in v] for _, v, _ in kept]).reshape(len(kept), V.PARTS, -1)
    books = x[: V.ENTRIES].transpose(1, 0, 2).copy()
    for turn in range(V.ROUNDS + 1):
        d = ((x[:, :, None] - books[None]) ** 2).sum(-1)
        code = d.argmin(2)
        if turn < V.ROUNDS:
            for p in range(V.PARTS):
                for e in set(code[:, p]):
                    own = x[code[:, p] == e, p]
                    books[p, e] = own.sum(0) // len(own)
    return {r[0]: ("".join(f"{c:02x}" for c in code[i]), int(d[i].min(-1).sum())) for i, r in enumerate(kept)}, books


@pytest.mark.parametrize("n, copies, block, leaf", [(700, 200, 4096, 48), (300, 300, 64, 4), (20, 0, 4096, 48)])
def test_part_codes_against_plain_assignment(spark, n, copies, block, leaf):
    rows = vectors(n, 64, 1, copies) + [(10**6, None, 1), (10**6 + 1, [None] + [1.0] * 63, 2), (10**6 + 2, [float("nan")] * 64, 1)]
    coded, books = V.encode(table(spark, rows).repartition(3), block=block, leaf=leaf)
    want, plain = codes(rows)
    got = V.with_label_error(coded).toPandas()
    assert np.array_equal(books, plain) and V.digest(books) == hashlib.sha256(",".join(str(c) for c in plain.ravel()).encode()).hexdigest()
    assert dict(zip(got.vec_id, zip(got.code, got.error))) == want
    assert got.groupby("label").error.sum().to_dict() == got.groupby("label").label_error.first().to_dict()


def test_part_codes_of_odd_rows(spark):
    even = [1.0] * 32
    rows = [(1, even, None), (1, [2.0] * 32, None), (None, even, 3), (2, [1.0] * 31, 3), (3, [1e20] + [1.0] * 31, 3), (4, [0.5] * 32, 3)]
    coded, books = V.encode(table(spark, rows))
    got = V.with_label_error(coded).collect()
    assert sorted((r.vec_id if r.vec_id is not None else 99, r.label) for r in got if r.label) == [(4, 3), (99, 3)]
    assert len(got) == 4 and all(r.error == 0 and r.label_error == 0 for r in got) and books.shape == (16, 4, 2)
    assert len({r.code for r in got}) == 3
    odd, books = V.encode(table(spark, [(1, [1.0] * 5, 1), (2, [2.0] * 5, 1)]))
    assert books.shape == (16, 2, 1) and odd.count() == 2
    assert V.encode(table(spark, []))[0].count() == 0


def test_trees_own_balls_whole_and_cache_their_sums():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.integers(0, 9, (300, 4)) + 500 * k for k in range(6)])
    tree = V.Tree.of(points)
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    for at in range(len(tree.first)):
        own = points[tree.order[tree.first[at] : tree.last[at]]]
        assert np.array_equal(own.sum(0), tree.sums[at]) and np.sqrt(((own - tree.centre[at]) ** 2).sum(1)).max() <= tree.radius[at] + 1e-9
        if tree.left[at]:
            a, b = tree.left[at], tree.left[at] + 1
            assert (tree.first[a], tree.last[b]) == (tree.first[at], tree.last[at]) and tree.last[a] == tree.first[b]
    entries = np.array([[500 * k + 4] * 4 for k in range(6)])
    code, sums, counts, whole = tree.assign(points, entries)
    assert np.array_equal(code, np.repeat(np.arange(6), 300)) and counts.tolist() == [300] * 6
    # each cluster is owned as a few whole balls, not point by point
    assert whole <= 40 and np.array_equal(sums, points.reshape(6, 300, 4).sum(1))
    packed = V.Tree.unpacked(tree.packed(), 4)
    assert np.array_equal(packed.assign(points, entries)[0], code)
