"""Hierarchical density clusters against a dense reference."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from dayweave.operators import density as D


def dense(x, least):
    """Labels by repeated cutting of the full mutual reachability matrix."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, min(least, n) - 1]
    m = np.maximum(np.maximum(d, core[:, None]), core[None])

    def parts(s, below):
        left, out = set(s), []
        while left:
            todo = [left.pop()]
            one = list(todo)
            while todo:
                i = todo.pop()
                new = [j for j in left if m[i, j] < below]
                left -= set(new)
                todo += new
                one += new
            out.append(sorted(one))
        return out

    def height(s):
        """Smallest distance at which s hangs together."""
        seen, best = {s[0]}, {j: m[s[0], j] for j in s[1:]}
        top = 0.0
        while best:
            j = min(best, key=best.get)
            top = max(top, best.pop(j))
            seen.add(j)
            for k in best:
                best[k] = min(best[k], m[j, k])
        return top

    rate = lambda h: 1 / max(h, D.CLOSEST)

    def grow(s, born):
        """(stability, members, children) of the cluster that begins as s."""
        members, total = list(s), 0.0
        while True:
            h = height(s) if len(s) > 1 else 0.0
            if h == 0:
                return total + len(s) * (rate(0) - born), members, []
            split = parts(s, h)
            large = [p for p in split if len(p) >= least]
            total += sum(len(p) for p in split if len(p) < least or len(large) > 1) * (rate(h) - born)
            if len(large) != 1:
                return total, members, [grow(p, rate(h)) for p in large]
            s = large[0]

    def choose(c):
        total, members, kids = c
        below = [choose(k) for k in kids]
        if not kids or total >= sum(t for t, _ in below):
            return total, [members]
        return sum(t for t, _ in below), [m for _, ms in below for m in ms]

    out = [-1] * n
    for kid in grow(list(range(n)), 0.0)[2]:
        for members in choose(kid)[1]:
            for i in members:
                out[i] = min(members)
    return out


def clouds(seed, copies=0):
    """A tight cloud, a wide one, two near ones inside a third, and scatter."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal((0, 0), 0.05, (40, 2)), rng.normal((6, 0), 0.8, (50, 2)), rng.normal((0, 6), 0.15, (30, 2)), rng.normal((1.2, 6), 0.15, (30, 2)), rng.uniform(-4, 10, (25, 2)), np.tile([[3.0, 3.0]], (copies, 1))])
    return x[rng.permutation(len(x))]


@pytest.mark.parametrize("block", [2000, 40])
def test_clusters_of_differing_density_equal_the_dense_reference(spark, block):
    rows, want = [], {}
    for g, x in (("a", clouds(1)), ("b", clouds(2, copies=15)), ("few", np.array([[0.0, 0.0], [1.0, 1.0]]))):
        base = len(rows)
        got = dense(x, 12)
        rows += [(base + i, g, v.tolist()) for i, v in enumerate(x)]
        want |= {base + i: base + c if c >= 0 else -1 for i, c in enumerate(got)}
    df = spark.createDataFrame(rows, "id long, person string, v array<double>").withColumn("reduced", array_to_vector("v")).repartition(3)
    got = {r.id: r.cluster for r in D.density_tree(df, "id", "person", min_cluster=12, block=block).collect()}
    assert got == want
    # one radius cannot part the near pair and hold the wide cloud together
    assert len({c for i, c in got.items() if i < 175} - {-1}) >= 4 and sum(c < 0 for c in got.values()) > 5


def test_spanning_tree_of_many_blocks_has_the_smallest_weight(spark):
    rng = np.random.default_rng(7)
    edges = {(int(min(a, b)), int(max(a, b))): float(rng.integers(1, 60)) for a, b in rng.integers(0, 150, (2500, 2)) if a != b}
    got = D.boruvka(spark.createDataFrame([("g", a, b, w) for (a, b), w in edges.items()], "grp string, lo long, hi long, w double")).collect()
    up = list(range(150))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    total = n = 0
    for (a, b), w in sorted(edges.items(), key=lambda e: (e[1], e[0])):
        if root(a) != root(b):
            up[root(a)] = root(b)
            total, n = total + w, n + 1
    assert len(got) == n and sum(r.w for r in got) == total and all(edges[r.lo, r.hi] == r.w for r in got)


def test_default_size_follows_the_group(spark):
    x = np.concatenate([np.random.default_rng(3).normal((0, 0), 0.1, (60, 2)), np.random.default_rng(4).normal((5, 5), 0.1, (7, 2)), np.random.default_rng(5).normal((-5, 5), 0.1, (20, 2))])
    df = spark.createDataFrame([(i, "p", v.tolist()) for i, v in enumerate(x)], "id long, person string, v array<double>").withColumn("reduced", array_to_vector("v"))
    got = {r.id: r.cluster for r in D.density_tree(df, "id", "person").collect()}
    # seven rows are below the least size of eight
    assert {got[i] for i in range(60, 67)} == {-1} and sum(got[i] == 0 for i in range(60)) > 40 and len({got[i] for i in range(67, 87)} - {-1}) == 1
    assert D.density_tree(df.where("id < 0"), "id", "person").agg(F.count("*")).first()[0] == 0


@pytest.mark.parametrize("least, lattice", [(75, False), (75, True), (9_000, False)])
def test_core_distances_of_a_large_group_need_few_distances(least, lattice):
    """Two blocks of a group of 3,000: what tasks hand on does not grow with the rank of the core distance."""
    rng = np.random.default_rng(11)
    x = rng.integers(0, 12, (3000, 3)).astype(float) if lattice else rng.normal(0, 1, (3000, 6)) * rng.choice([0.1, 3], (3000, 1))
    n = rng.integers(1, 4, 3000)
    pdf = pd.DataFrame({"no": np.arange(3000), "x": list(x), "n": n, "block": np.arange(3000) % 2, "least": least, "total": n.sum(), "far": (x**2).sum(1).max()})
    pairs = lambda t: [t[t.block.isin(p)].assign(one=min(p), two=max(p)) for p in ((0,), (1,), (0, 1))]
    beside = lambda t, fn, found: pd.concat([b.merge(fn(b, found[found.block == k] if "block" in found else found), on="no") for k, b in t.groupby("block")])
    bordered = beside(pdf, D.borders, pdf.sample(1000, random_state=1)[["x", "n"]])
    narrow = beside(bordered, D.next_borders, pd.concat([D.counts_between(p) for p in pairs(bordered)]))
    near = pd.concat([D.near_rank(p) for p in pairs(narrow)])
    got = beside(narrow, D.ranked_cores, near).sort_values("no")["core"].to_numpy()
    d = np.sqrt(sum((x[:, None, c] - x[None, :, c]) ** 2 for c in range(x.shape[1])))
    order = np.argsort(d, axis=1, kind="stable")
    want = np.take_along_axis(d, order, 1)[np.arange(3000), (np.cumsum(n[order], axis=1) >= min(least, n.sum())).argmax(1)]
    assert (got == want).all()
    # a fortieth of the group for every row would be 225,000
    assert sum(map(len, near["d"])) / 8 < 60_000 or least > 3000


def test_rows_hang_on_neighbours_and_the_rest_is_joined_to_the_smallest_tree():
    x = clouds(5)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, 11]
    m = np.maximum(np.maximum(d, core[:, None]), core[None])
    pdf = pd.DataFrame({"node": np.arange(len(x)), "x": list(x), "core": core, "block": 0, "one": 0, "two": 0, "far": (x**2).sum(1).max()})
    hung = D.hung_on(pdf)
    assert (m[hung.node, hung.to] == hung.core).all() and len(hung) > 0.8 * len(x)
    part = np.arange(len(x))
    for r in hung.sort_values(["core", "node"]).itertuples():
        part[r.node] = part[r.to]
    edges = D.spanning_edges(pdf.assign(part=part))
    whole = D.spanning_edges(pdf.assign(part=pdf.node))
    assert len(edges) + len(hung) == len(x) - 1 == len(whole)
    assert np.isclose(np.sort(np.append(edges.w, hung.core).astype(float)), np.sort(whole.w.astype(float))).all() and (m[edges.lo, edges.hi] == edges.w).all()
