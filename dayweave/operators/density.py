"""Hierarchical density clusters: a spanning tree over mutual reachability and its condensed tree.

Distances are needed between all rows of a group (a person's windows), but never as rows: a group is cut
into blocks, as many at any size, and a task compares two blocks. The core distance of a row is one rank
among its distances: a sample draws borders around the rank, tasks count what lies between them, and only
the distances between the two borders next to the rank are handed on. A row with a neighbour of smaller
core within its own core distance hangs on it: no edge of a row is shorter than its core, so such edges
are part of a spanning tree. Tasks hand on a spanning tree of what is not yet joined. Those trees together
hold the spanning tree of the group; Borůvka rounds, which join every component to its nearest one, find
it. Products of matrices tell which pairs can matter; what counts are distances by differences. Equal
vectors are one node.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.components import components
from ..session import materialise

BLOCK = 2_000
#: Blocks that a large group is cut into, so that a row goes to so many tasks; a block has at most so many rows.
SIDE_BLOCKS, MOST_IN_BLOCK = 16, 200_000
#: Least rows of a sample, rows that one of its rows stands for, borders around the wanted rank.
SAMPLE, STANDS_FOR, BORDERS = 1_024, 64, 32
#: Distances of a matrix that are held at once.
CELLS = 1 << 20
#: Inverse distance of equal rows.
CLOSEST = 1e-12
TASK = ["grp", "one", "two"]
SIZE_SHARE, LEAST_SIZE = 40, 8


def _pairs(points: DataFrame) -> DataFrame:
    """Every pair of blocks of a group as a task (grp, one, two); a block goes to as many tasks as there are blocks."""
    other = points.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return other.withColumns({"one": F.least("block", "_o"), "two": F.greatest("block", "_o")}).drop("_o")


def _sides(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, block = np.stack(pdf["x"].to_numpy()), pdf["block"].to_numpy()
    return x, np.flatnonzero(block == pdf["one"].iloc[0]), np.flatnonzero(block == pdf["two"].iloc[0])


def _distances(x: np.ndarray, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Euclidean distances by differences, so that a pair has one distance in every task."""
    out = np.zeros((len(rows), len(others)))
    for c in range(x.shape[1]):
        out += (x[rows, None, c] - x[None, others, c]) ** 2
    return np.sqrt(out)


def _squares(x: np.ndarray, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distances by a product of matrices, right within _slack."""
    norm = lambda at: (x[at] ** 2).sum(1)
    return norm(rows)[:, None] + norm(others)[None] - 2 * (x[rows] @ x[others].T)


def _slack(x: np.ndarray, far: float) -> float:
    """Above the rounding of _squares and of a distance by differences; far: the largest squared norm of the group."""
    return 64 * (x.shape[1] + 4) * np.finfo(float).eps * far


def _exact(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The distances of _distances, of single pairs."""
    out = np.zeros(len(i))
    for c in range(x.shape[1]):
        out += (x[i, c] - x[j, c]) ** 2
    return np.sqrt(out)


def _chunks(rows: np.ndarray, others: np.ndarray):
    step = max(1, CELLS // max(1, len(others)))
    return (rows[at : at + step] for at in range(0, len(rows), step))


def _turns(pdf: pd.DataFrame):
    """The block whose rows are looked at, its rows and those they meet: one turn inside a block, two between blocks."""
    x, left, right = _sides(pdf)
    one, two = int(pdf["one"].iloc[0]), int(pdf["two"].iloc[0])
    turns = [(one, left, right)] if one == two else [(one, left, right), (two, right, left)]
    return x, [t for t in turns if len(left) and len(right)]


def lone_cores(pdf: pd.DataFrame) -> pd.DataFrame:
    """Core distances of a group of one block."""
    x, n, k = np.stack(pdf["x"].to_numpy()), pdf["n"].to_numpy(), min(pdf["least"].iloc[0], pdf["total"].iloc[0])
    every, core = np.arange(len(x)), np.zeros(len(x))
    for some in _chunks(every, every):
        d = _distances(x, some, every)
        order = np.argsort(d, axis=1, kind="stable")
        core[some] = np.take_along_axis(d, order, 1)[np.arange(len(some)), (np.cumsum(n[order], axis=1) >= k).argmax(1)]
    return pdf[["no"]].assign(core=core)


def borders(points: pd.DataFrame, sample: pd.DataFrame) -> pd.DataFrame:
    """Rising squared distances around the wanted rank of every row, by a sample of its group. They steer the work, not the result."""
    mine, seen = np.stack(points["x"].to_numpy()), np.stack(sample["x"].to_numpy())
    x, n = np.concatenate([mine, seen]), sample["n"].to_numpy()
    others, out = np.arange(len(mine), len(x)), []
    share = min(1.0, points["least"].iloc[0] / points["total"].iloc[0])
    spread = 4 * np.sqrt(share / len(seen))
    want = np.linspace(max(0.0, share - spread), min(1.0, share + spread), BORDERS) * n.sum()
    for some in _chunks(np.arange(len(mine)), others):
        d = _squares(x, some, others)
        order = np.argsort(d, axis=1)
        d, held = np.take_along_axis(d, order, 1), np.cumsum(n[order], axis=1)
        out += [row[np.minimum(np.searchsorted(h, want), len(row) - 1)].tolist() for row, h in zip(d, held)]
    return points[["no"]].assign(borders=out)


def counts_between(pdf: pd.DataFrame) -> pd.DataFrame:
    """(block, held): how many rows lie below the first border of each row, between two borders, beyond the last."""
    pdf = pdf.sort_values("no")
    n, edge, out = pdf["n"].to_numpy(), np.stack(pdf["borders"].to_numpy()), []
    x, turns = _turns(pdf)
    for block, rows, others in turns:
        held = []
        for some in _chunks(rows, others):
            d = _squares(x, some, others)
            i, j = np.nonzero(d < edge[some, -1:])
            value, weight, at = d[i, j], n[others[j]], np.searchsorted(i, np.arange(len(some) + 1))
            for r, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                held.append(np.bincount(np.searchsorted(edge[some[r]], value[lo:hi], side="right"), weight[lo:hi], BORDERS + 1))
        out.append((block, np.array(held, "<i8").tobytes()))
    return pd.DataFrame(out, columns=["block", "held"])


def next_borders(points: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """The two borders next to the wanted rank of every row."""
    points = points.sort_values("no")
    edge, k = np.stack(points["borders"].to_numpy()), min(points["least"].iloc[0], points["total"].iloc[0])
    below = np.zeros((len(points), BORDERS + 1), np.int64)
    for held in counts["held"]:
        below += np.frombuffer(held, "<i8").reshape(below.shape)
    below = np.cumsum(below, axis=1)[:, :BORDERS]
    edge = np.concatenate([np.full((len(edge), 1), -np.inf), edge, np.full((len(edge), 1), np.inf)], axis=1)
    at, every = (below < k).sum(1), np.arange(len(points))
    return points[["no"]].assign(lower=edge[every, at], upper=edge[every, at + 1])


def near_rank(pdf: pd.DataFrame) -> pd.DataFrame:
    """(block, below, place, d, held): rows surely below the borders of each row, and the distances that may lie between them."""
    pdf = pdf.sort_values("no")
    n, lower, upper, out = pdf["n"].to_numpy(), pdf["lower"].to_numpy(), pdf["upper"].to_numpy(), []
    x, turns = _turns(pdf)
    slack = 2 * _slack(x, pdf["far"].iloc[0])
    for block, rows, others in turns:
        below, place, near, held, weight, first = [], [], [], [], n[others].astype(float), 0
        for some in _chunks(rows, others):
            d = _squares(x, some, others)
            short = d < (lower[some] - slack)[:, None]
            below.append(short @ weight)
            i, j = np.nonzero(~short & (d <= (upper[some] + slack)[:, None]))
            real = _exact(x, some[i], others[j])
            order = np.lexsort((real, i))
            i, real, w = i[order], real[order], n[others[j[order]]]
            fresh = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (real[1:] != real[:-1]))) if len(i) else i
            place.append(i[fresh] + first)
            near.append(real[fresh])
            held.append(np.add.reduceat(w, fresh) if len(i) else w)
            first += len(some)
        packed = [np.concatenate(v).astype(t).tobytes() for v, t in ((below, "<i8"), (place, "<i4"), (near, "<f8"), (held, "<i8"))]
        out.append((block, *packed))
    return pd.DataFrame(out, columns=["block", "below", "place", "d", "held"])


def ranked_cores(points: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
    """The distance at the wanted rank of every row of a block."""
    points = points.sort_values("no")
    k = min(points["least"].iloc[0], points["total"].iloc[0])
    below = sum(np.frombuffer(b, "<i8") for b in near["below"])
    place, d, held = (np.concatenate([np.frombuffer(v, t) for v in near[c]]) for c, t in (("place", "<i4"), ("d", "<f8"), ("held", "<i8")))
    order = np.lexsort((d, place))
    place, d, held = place[order], d[order], held[order]
    bounds = np.searchsorted(place, np.arange(len(points) + 1))
    upto = np.cumsum(held)
    core = np.empty(len(points))
    for r, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        core[r] = d[lo + np.searchsorted(upto[lo:hi], k - below[r] + (upto[lo - 1] if lo else 0))]
    return points[["no"]].assign(core=core)


def hung_on(pdf: pd.DataFrame) -> pd.DataFrame:
    """(node, core, to, to_core): for each row the row of smallest core surely within its core distance, if that is smaller than its own."""
    node, core, out = pdf["node"].to_numpy(), pdf["core"].to_numpy(), []
    x, turns = _turns(pdf)
    slack = _slack(x, pdf["far"].iloc[0])
    for _, rows, others in turns:
        others = others[np.lexsort((node[others], core[others]))]
        for some in _chunks(rows, others):
            inside = _squares(x, some, others) <= (core[some] ** 2 - 2 * slack)[:, None]
            at = inside.argmax(1)
            to = others[at]
            less = inside[np.arange(len(some)), at] & ((core[to] < core[some]) | ((core[to] == core[some]) & (node[to] < node[some])))
            out.append(pd.DataFrame({"node": node[some[less]], "core": core[some[less]], "to": node[to[less]], "to_core": core[to[less]]}))
    return pd.concat(out) if out else pd.DataFrame(columns=["node", "core", "to", "to_core"])


def _reach_all(x, core, some, to, slack, best, source) -> None:
    """Lowers best, the shortest reach of the rows `to` from the joined ones, by that from `some`."""
    for part in _chunks(to, some):
        for members in _chunks(some, part):
            d = np.maximum(_squares(x, part, members), core[members][None] ** 2)
            i, j = np.nonzero(d <= np.minimum(d.min(1), best[part] ** 2 + slack)[:, None] + 2 * slack)
            reach = np.maximum(np.maximum(_exact(x, part[i], members[j]), core[members[j]]), core[part[i]])
            order = np.lexsort((reach, i))
            i, j, reach = i[order], j[order], reach[order]
            first = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else i
            i, j, reach = i[first], j[first], reach[first]
            less = reach < best[part[i]]
            best[part[i[less]]], source[part[i[less]]] = reach[less], members[j[less]]


def spanning_edges(pdf: pd.DataFrame) -> pd.DataFrame:
    """Smallest spanning tree of the mutual reachability between two blocks, or inside one. Rows of one `part` are joined already."""
    x, left, right = _sides(pdf)
    node, core, part = pdf["node"].to_numpy(), pdf["core"].to_numpy(), pdf["part"].to_numpy()
    alike = pdf["one"].iloc[0] == pdf["two"].iloc[0]
    slack = _slack(x, pdf["far"].iloc[0])
    side = np.zeros(len(x), bool)
    side[right] = True
    by_part = np.argsort(part, kind="stable")
    names, first, held = np.unique(part[by_part], return_index=True, return_counts=True)
    bounds = dict(zip(names.tolist(), zip(first.tolist(), (first + held).tolist())))
    best, source, open_ = np.full(len(x), np.inf), np.full(len(x), -1), np.ones(len(x), bool)
    at, out = int(left[0]) if len(left) else 0, []
    # a hash may leave a block empty
    while len(left) and len(right):
        lo, hi = bounds[part[at]]
        joined = by_part[lo:hi]
        open_[joined] = False
        to = np.flatnonzero(open_)
        if not len(to):
            break
        for some, others in ((joined, to),) if alike else ((joined[side[joined]], to[~side[to]]), (joined[~side[joined]], to[side[to]])):
            if len(some) and len(others):
                _reach_all(x, core, some, others, slack, best, source)
        at = int(to[best[to].argmin()])
        a, b = (at, int(source[at])) if node[at] < node[source[at]] else (int(source[at]), at)
        out.append((node[a], node[b], best[at], part[a], part[b]))
    return pd.DataFrame(out, columns=["lo", "hi", "w", "a", "b"])


def boruvka(edges: DataFrame) -> DataFrame:
    """(grp, lo, hi, w): spanning trees of a graph whose nodes are numbered over all groups.

    Columns a and b, if there, name what lo and hi are joined to already.
    """
    ends = edges if "a" in edges.columns else edges.withColumns({"a": F.col("lo"), "b": F.col("hi")})
    now = materialise(ends.groupBy("grp", "lo", "hi", "a", "b").agg(F.min("w").alias("w")), "density-edges")
    tree = None
    while now.head(1):
        edge = F.struct("w", "lo", "hi")
        both = now.select("grp", F.explode(F.array("a", "b")).alias("node"), edge.alias("e"), "a", "b")
        picked = both.groupBy("node").agg(F.min(F.struct("e", "a", "b", "grp")).alias("p")).select("p.*").groupBy("grp", "e", "a", "b").agg(F.lit(0).alias("_")).drop("_")
        picked = materialise(picked, "density-picked")
        found = picked.select("grp", "e.lo", "e.hi", "e.w")
        tree = found if tree is None else tree.unionByName(found)
        roots = materialise(components(picked.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "density-roots")
        named = lambda df, c: df.join(roots.withColumnsRenamed({"node": c, "root": "_r"}), c, "left").withColumn(c, F.coalesce("_r", c)).drop("_r")
        moved = named(named(now, "a"), "b").where("a <> b").withColumns({"_a": F.least("a", "b"), "_b": F.greatest("a", "b")})
        # of the edges between two components only the smallest can still count
        now = materialise(moved.groupBy("grp", F.col("_a").alias("a"), F.col("_b").alias("b")).agg(F.min(edge).alias("e")).select("grp", "e.lo", "e.hi", "e.w", "a", "b"), "density-edges")
    return tree if tree is not None else edges.select("grp", "lo", "hi", "w")


def condensed_labels(nodes: np.ndarray, weight: np.ndarray, lo: np.ndarray, hi: np.ndarray, w: np.ndarray, smallest: int) -> np.ndarray:
    """Cluster (place of one of its nodes) of every node by excess of mass, −1 for noise.

    Edges of equal length split a cluster at once into all its parts. Parts of `smallest` rows or more are
    clusters; with one such part the cluster goes on, and the other rows leave it at that distance.
    A cluster stands if its stability is at least that of the clusters below it; the whole is none.
    """
    n = len(nodes)
    place = {v: i for i, v in enumerate(nodes.tolist())}
    up, top, size = list(range(n)), list(range(n)), weight.astype(int).tolist()
    kids: list[tuple[int, ...]] = [()] * n
    height = [0.0] * n

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for k in np.lexsort((hi, lo, w)).tolist():
        a, b = root(place[lo[k]]), root(place[hi[k]])
        parts: list[int] = []
        for t in (top[a], top[b]):
            parts += kids[t] if kids[t] and height[t] == w[k] else [t]
        kids.append(tuple(parts))
        height.append(float(w[k]))
        size.append(size[top[a]] + size[top[b]])
        up[b] = a
        top[a] = len(kids) - 1

    def leaves(t: int) -> list[int]:
        out, stack = [], [t]
        while stack:
            t = stack.pop()
            if kids[t]:
                stack += kids[t]
            else:
                out.append(t)
        return out

    # clusters: 0 is the whole; born at an inverse distance
    parent, born, stable, own = [-1], [0.0], [0.0], [-1] * n
    stack = [(top[root(0)], 0)] if n else []
    while stack:
        t, c = stack.pop()
        if not kids[t]:  # copies of one row stay together for good
            own[t] = c
            stable[c] += size[t] * (1 / CLOSEST - born[c])
            continue
        rate = 1 / max(height[t], CLOSEST)
        large = [k for k in kids[t] if size[k] >= smallest]
        for k in kids[t]:
            if size[k] < smallest or len(large) > 1:
                stable[c] += size[k] * (rate - born[c])
            if size[k] < smallest:
                for leaf in leaves(k):
                    own[leaf] = c
        if len(large) == 1:
            stack.append((large[0], c))
        elif large:
            for k in large:
                parent.append(c)
                born.append(rate)
                stable.append(0.0)
                stack.append((k, len(parent) - 1))
    below, stands = [0.0] * len(parent), [False] * len(parent)
    children = [False] * len(parent)
    for c in range(len(parent) - 1, 0, -1):
        stands[c] = not children[c] or stable[c] >= below[c]
        below[parent[c]] += stable[c] if stands[c] else below[c]
        children[parent[c]] = True
    chosen = [-1] * len(parent)
    for c in range(1, len(parent)):
        chosen[c] = chosen[parent[c]] if chosen[parent[c]] >= 0 else c if stands[c] else -1
    first: dict[int, int] = {}
    for i in np.argsort(nodes, kind="stable").tolist():
        if chosen[own[i]] >= 0:
            first.setdefault(chosen[own[i]], i)
    return np.array([first.get(chosen[c], -1) for c in own], int)


def large_cores(points: DataFrame) -> DataFrame:
    """points with the core distance of every row; the groups are of several blocks."""
    home, few = ["grp", "block"], ["grp", "block", "blocks", "no", "x", "n"]
    every = points.where(F.pmod(F.xxhash64("no", F.lit(7)), F.col("nth")) == 0).select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "x", "n")

    def beside(rows: DataFrame, column: str, other: DataFrame, fn, schema: str, name: str) -> DataFrame:
        """rows with what fn finds from the rows of a block and `other` of it."""
        fresh = lambda d: d.toDF(*d.columns).groupBy(*home)
        names = [c.split()[0] for c in schema.split(", ")]
        found = lambda mine, theirs: fn(mine, theirs) if len(mine) else pd.DataFrame(columns=names)
        mine = rows.select(*home, "no", column, "least", "total")
        return materialise(rows.join(fresh(mine).cogroup(fresh(other)).applyInPandas(found, schema), "no"), name)

    bordered = beside(points, "x", every, borders, "no long, borders array<double>", "density-borders")
    counts = _pairs(bordered.select(*few, "borders")).groupBy(*TASK).applyInPandas(lambda pdf: counts_between(pdf).assign(grp=pdf["grp"].iloc[0]), "block long, held binary, grp string")
    narrow = beside(bordered, "borders", counts, next_borders, "no long, lower double, upper double", "density-narrow").drop("borders")
    near = _pairs(narrow.select(*few, "lower", "upper", "far")).groupBy(*TASK).applyInPandas(
        lambda pdf: near_rank(pdf).assign(grp=pdf["grp"].iloc[0]), "block long, below binary, place binary, d binary, held binary, grp string"
    )
    return beside(narrow, "lower", near, ranked_cores, "no long, core double", "density-ranked").drop("lower", "upper")


def density_tree(df: DataFrame, key: str, group: str, col: str = "reduced", min_cluster: int | None = None, block: int = BLOCK) -> DataFrame:
    """ML-30: clusters of differing density in every group; adds `cluster`, the smallest key of its rows, −1 for noise.

    min_cluster: rows a cluster needs, max(8, rows / 40) of the group if None; also the number of rows, itself
    included, that the core distance of a row reaches. Keys are whole numbers, unique over all groups.
    The edges of one tree, one for each window of a person's history, are condensed in one task.
    """
    # a name for every group, also for that of rows without one
    rows = df.withColumn("_x", vector_to_array(col)).withColumn("_g", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")))
    points = rows.groupBy(F.col("_g").alias("grp"), F.col("_x").alias("x")).agg(F.min(F.col(key).cast("long")).alias("node"), F.count(F.lit(1)).alias("n"))
    size = F.greatest(F.lit(LEAST_SIZE), F.floor(F.sum("n") / SIZE_SHARE)) if min_cluster is None else F.lit(min_cluster)
    points = points.withColumn("_s", F.aggregate("x", F.lit(0.0), lambda t, v: t + v * v))
    most = F.greatest(F.lit(block), F.least(F.lit(MOST_IN_BLOCK), F.ceil(F.count(F.lit(1)) / SIDE_BLOCKS)))
    groups = points.groupBy("grp").agg(
        F.ceil(F.count(F.lit(1)) / most).cast("long").alias("blocks"), size.cast("int").alias("least"), F.sum("n").alias("total"),
        F.max("_s").alias("far"), F.ceil(F.count(F.lit(1)) / F.greatest(F.lit(SAMPLE), F.ceil(F.count(F.lit(1)) / STANDS_FOR))).cast("long").alias("nth"),
    )
    numbered = points.drop("_s").withColumn("no", F.monotonically_increasing_id())
    placed = materialise(numbered.join(groups, "grp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))), "density-points")
    alone, many = placed.where("blocks = 1"), placed.where("blocks > 1")
    cored = alone.join(alone.groupBy("grp").applyInPandas(lone_cores, "no long, core double"), "no")
    hung = None
    # without a large group the steps of large ones are left out
    if many.head(1):
        cored = cored.unionByName(large_cores(many))
    cored = materialise(cored.where(F.col("node").isNotNull()), "density-cores")
    if many.head(1):
        pairs = _pairs(cored.where("blocks > 1").drop("n", "least", "total", "nth")).groupBy(*TASK)
        near = pairs.applyInPandas(lambda pdf: hung_on(pdf).assign(grp=pdf["grp"].iloc[0]), "node long, core double, to long, to_core double, grp string")
        hung = materialise(near.groupBy("grp", "node", "core").agg(F.min(F.struct("to_core", "to")).getField("to").alias("to")), "density-hung")
        parts = components(hung.select(F.greatest("node", "to").alias("a"), F.least("node", "to").alias("b")))
        cored = materialise(cored.join(parts, "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root"), "density-parts")
    else:
        cored = cored.withColumn("part", F.col("node"))
    meeting = _pairs(cored.drop("n", "least", "total", "nth")).groupBy(*TASK)
    edges = materialise(meeting.applyInPandas(lambda pdf: spanning_edges(pdf).assign(grp=pdf["grp"].iloc[0]), "lo long, hi long, w double, a long, b long, grp string"), "density-trees")
    # the tree of a group of one block is its spanning tree
    several = cored.where("blocks > 1").select("grp").distinct()
    tree = edges.join(several, "grp", "left_anti").select("grp", "lo", "hi", "w")
    if hung is not None:
        held = hung.select("grp", F.least("node", "to").alias("lo"), F.greatest("node", "to").alias("hi"), F.col("core").alias("w"))
        tree = tree.unionByName(held).unionByName(boruvka(edges.join(several, "grp", "left_semi")))

    def condense(key, points: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        nodes = points["node"].to_numpy()
        got = condensed_labels(nodes, points["n"].to_numpy(), tree["lo"].to_numpy(), tree["hi"].to_numpy(), tree["w"].to_numpy(), int(points["least"].iloc[0])) if len(points) else []
        return pd.DataFrame({"node": nodes, "cluster": [int(nodes[c]) if c >= 0 else -1 for c in got]})

    fresh = lambda d: d.toDF(*d.columns).groupBy("grp")
    labels = fresh(cored.select("grp", "node", "n", "least")).cogroup(fresh(tree)).applyInPandas(condense, "node long, cluster long")
    named = placed.select(F.col("grp").alias("_g"), F.col("x").alias("_x"), "node").join(labels, "node").drop("node")
    return rows.join(named, ["_g", "_x"], "left").drop("_x", "_g")
