"""SimHash near-dedup with vantage-point trees.

A fingerprint has one majority bit per bit of the hashes of the word shingles. Distinct
fingerprints are dealt to shards by a vantage-point tree: at every node the Hamming distance to a
vantage fingerprint decides the side, and a query also takes the other side when the triangle
bound does not exclude partners there, so every pair within the radius meets in the home shard of
one of them. Inside a shard the tree is continued in numpy down to small leaves, whose pairs are
compared exactly. A task reports links as a spanning forest, never all pairs.

Copies collapse to one fingerprint before the search. The tree is built from a bounded sample
(SAMPLE fingerprints a leaf, by smallest hash); only where it cuts depends on the sample, not which pairs
are found. Its number of leaves follows the number of fingerprints up to MOST_LEAVES; beyond that, a
shard is dealt over tasks that share its fingerprints and split the queries.

At a large radius, where triangle bounds exclude nothing, shards of equal smallest shingles take the
place of the outer tree (`minima`); inside a shard the search is the same. There the bits may only
nominate (`similar`): texts with a partner within reach meet once more, with their shingle sets, and the
similarity of the sets decides every pair whose rows no earlier pair has joined.

Cases: null or wordless texts have fingerprint 0 and are linked like any other; texts with fewer
words than a shingle are one shingle; rows with equal ids are one node each and share a component
if linked; a null id takes part and loses to any other as component id; an empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, row_key
from ..session import broadcast_if_small
from ..functions.components import components

SAMPLE = 8
LEAF = 1_024
MOST_LEAVES = 1 << 15
SMALL = 256


def fingerprints_of(texts: list[bytes | None], size: int, parts: int = 1, minima: int = 0) -> np.ndarray:
    """(rows, parts + minima + 1): 64-bit fingerprints, each with another seed, the first with 42;
    the smallest shingle hash of each of `minima` orders; the number of shingles."""
    import xxhash

    out = np.zeros((len(texts), parts + minima + 1), np.uint64)
    turn = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, (minima, 2), dtype=np.uint64) | np.uint64(1)
    least = np.full(minima, np.iinfo(np.uint64).max)
    for i, text in enumerate(texts):
        words = text.lower().split() if text else []
        if not words:
            continue
        flat = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        k = min(size, len(words))
        cuts = list(zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()))
        least[:] = np.iinfo(np.uint64).max
        for part in range(parts):
            seed, h64 = 42 + part, xxhash.xxh64_intdigest
            ones, n = np.zeros(64, np.int64), len(cuts)
            for at in range(0, n, 1 << 16):
                h = np.fromiter((h64(flat[s:e], seed) for s, e in cuts[at : at + (1 << 16)]), np.uint64, min(n - at, 1 << 16))
                ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
                if part == 0:
                    for m in range(minima):
                        least[m] = min(least[m], ((h ^ (h >> np.uint64(29))) * turn[m, 0] ^ turn[m, 1]).min())
            out[i, part] = np.packbits(2 * ones > n).view(">u8")[0]
        out[i, parts : parts + minima], out[i, -1] = least, len(cuts)
    return out


def fingerprint(text: Column, size: int, parts: int = 1, minima: int = 0) -> Column:
    """Array of longs: the bits of the fingerprint, 64 each, the shingle minima and the number of shingles."""

    def rows(column: pa.Array) -> pa.Array:
        got = fingerprints_of([x.as_py() for x in column], size, parts, minima)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1, dtype=np.int32) * got.shape[1]), pa.array(got.view(np.int64).ravel()))

    return F.arrow_udf(rows, "array<long>")(text.cast("binary"))


def shingle_sets(text: Column, size: int) -> Column:
    """Array of longs: the distinct 64-bit hashes of the shingles, sorted; empty without words."""

    def one(text: bytes | None) -> np.ndarray:
        import xxhash

        words = text.lower().split() if text else []
        k = min(size, len(words))
        hashed = (xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1 if words else 0))
        return np.unique(np.fromiter(hashed, np.uint64).view(np.int64))

    def rows(column: pa.Array) -> pa.Array:
        sets = [one(x.as_py()) for x in column]
        ends = np.cumsum([0] + [len(x) for x in sets])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))

    return F.arrow_udf(rows, "array<long>")(text.cast("binary"))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distance along the last axis of 64-bit parts."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


class Tree:
    """Vantage points and radii in heap order; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.vantage = np.zeros(((1 << depth), sample.shape[1]), np.uint64)
        self.radius = np.full(1 << depth, -1, np.int64)
        self._grow(sample, 1, 0)

    def _grow(self, sample: np.ndarray, node: int, level: int) -> None:
        if level == self.depth or not len(sample):
            return
        vantage = sample[0]
        d = distance(sample, vantage)
        # the cut that parts the sample most evenly; inside is d <= radius
        counts = np.cumsum(np.bincount(d))
        radius = int(np.argmin(np.abs(2 * counts - len(sample))))
        self.vantage[node], self.radius[node] = vantage, radius
        self._grow(sample[d <= radius], 2 * node, level + 1)
        self._grow(sample[d > radius], 2 * node + 1, level + 1)

    def homes(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (distance(points, self.vantage[node]) > self.radius[node])
        return node - (1 << self.depth)

    def visits(self, points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf) of every leaf that may hold a partner within reach."""
        at, node = np.arange(len(points)), np.ones(len(points), np.int64)
        for _ in range(self.depth):
            d, r = distance(points[at], self.vantage[node]), self.radius[node]
            inside, outside = d - reach <= r, d + reach > r
            at, node = np.concatenate((at[inside], at[outside])), np.concatenate((2 * node[inside], 2 * node[outside] + 1))
        return at, node - (1 << self.depth)


class Forest:
    """Union-find over the rows of one task; joins that change nothing are not links."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = int(up[x])
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                self.links.append((x, y))


class Proven(Forest):
    """Joins only rows whose sets have 100 * intersection >= percent * union; two empty sets are equal."""

    def __init__(self, starts: np.ndarray, flat: np.ndarray, percent: int):
        super().__init__(len(starts) - 1)
        self.starts, self.flat, self.percent = starts, flat, percent

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while (self.up[r] != r).any():
            r = self.up[r]
        self.up[x] = r
        return r

    def similar(self, a: int, others: np.ndarray) -> np.ndarray:
        """Whether a is similar enough to each of the others; their sets are laid end to end, few at a time."""
        own = self.flat[self.starts[a] : self.starts[a + 1]]
        sizes = self.starts[others + 1] - self.starts[others]
        both = np.zeros(len(others), np.int64)
        # sizes that far apart exclude the similarity
        fit = np.flatnonzero(100 * np.minimum(sizes, len(own)) >= self.percent * np.maximum(sizes, len(own)))
        for at in range(0, len(fit) if len(own) else 0, 256):
            some = fit[at : at + 256]
            ends = np.cumsum(sizes[some])
            laid = np.arange(ends[-1]) + np.repeat(self.starts[others[some]] - ends + sizes[some], sizes[some])
            values = self.flat[laid]
            place = np.minimum(np.searchsorted(own, values), len(own) - 1)
            both[some] = np.diff(np.append(0, np.cumsum(own[place] == values)[ends - 1]))
        return 100 * both >= self.percent * (sizes + len(own) - both)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """a is in ascending order, as tiles are searched row by row."""
        cut = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else []
        for lo, hi in zip(cut, np.append(cut[1:], len(a)).tolist() if len(a) else []):
            left = b[lo:hi]
            left = left[self.roots(left) != self.root(int(a[lo]))]
            if len(left):
                found = left[self.similar(int(a[lo]), left)]
                super().join(np.full(len(found), a[lo]), found)


def search(points: np.ndarray, sizes: np.ndarray, homes: np.ndarray, queries: np.ndarray, reach: int, ratio: float, found: Forest) -> None:
    """Links every query to the points within reach, by a vantage-point tree over the points.

    homes, queries: rows of points; sizes: shingles of each row, whose ratio must be `ratio` at least.
    """
    if not len(homes) or not len(queries):
        return
    if len(homes) > SMALL:
        vantage = points[homes[len(homes) // 2]]
        d = distance(points[homes], vantage)
        counts = np.cumsum(np.bincount(d))
        radius = int(np.argmin(np.abs(2 * counts - len(homes))))
        q = distance(points[queries], vantage)
        near, far = queries[q - reach <= radius], queries[q + reach > radius]
        if len(near) + len(far) < 1.9 * len(queries) and 0 < counts[radius] < len(homes):
            search(points, sizes, homes[d <= radius], near, reach, ratio, found)
            search(points, sizes, homes[d > radius], far, reach, ratio, found)
            return
    for block in range(0, len(homes), SMALL):
        own = homes[block : block + SMALL]
        for at in range(0, len(queries), 4096):
            asked = queries[at : at + 4096]
            hit = np.bitwise_count(points[asked, None, 0] ^ points[None, own, 0])
            for part in range(1, points.shape[1]):
                hit = hit + np.bitwise_count(points[asked, None, part] ^ points[None, own, part]).astype(np.uint16)
            a, b = np.nonzero(hit <= reach)
            a, b = asked[a], own[b]
            if ratio > 0:
                fit = np.minimum(sizes[a], sizes[b]) >= ratio * np.maximum(sizes[a], sizes[b])
                a, b = a[fit], b[fit]
            other = a != b
            found.join(a[other], b[other])


def _route(tree: Tree, reach: int, salts: int):
    """(shard, salt, home, asks, node, bits, size): a fingerprint in its home shard, and as a query in later shards."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = _matrix(batch.column(1))
            home = tree.homes(parts)
            at, leaf = tree.visits(parts, reach)
            # a pair meets once: the one with the earlier home asks in the later one
            ahead = leaf > home[at]
            stay = np.tile(np.arange(len(home)), salts)
            at, leaf = np.concatenate((stay, at[ahead])), np.concatenate((home[stay], leaf[ahead]))
            turn = batch.column(0).to_numpy()[at] % salts
            own = np.zeros(len(at), bool)
            own[: len(stay)] = True
            # in its home shard a fingerprint is found in every salt and asks in one
            salt = np.where(own, np.append(np.repeat(np.arange(salts), len(home)), np.zeros(ahead.sum(), np.int64)), turn)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf), pa.array(salt), pa.array(own), pa.array(salt == turn), batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take)],
                names=["shard", "salt", "home", "asks", "node", "bits", "size"],
            )

    return rows


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.uint64)


def _links(reach: int, ratio: float):
    def rows(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node = table.column("node").to_numpy()
        points = _matrix(table.column("bits").combine_chunks())
        home, asks = (table.column(c).to_numpy(zero_copy_only=False) for c in ("home", "asks"))
        sizes = table.column("size").to_numpy()
        # searched in one order, so retries report the same links
        order = np.argsort(node, kind="stable")
        node, points, home, asks, sizes = node[order], points[order], home[order], asks[order], sizes[order]
        found = Forest(len(node))
        search(points, sizes, np.flatnonzero(home), np.flatnonzero(asks), reach, ratio, found)
        a, b = np.array(found.links, np.int64).reshape(-1, 2).T
        return pa.table({"a": np.maximum(node[a], node[b]), "b": np.minimum(node[a], node[b])})

    return rows


def near_links(nodes: DataFrame, reach: int, ratio: float = 0.0, leaf: int = LEAF, sample: int = SAMPLE, most_leaves: int = MOST_LEAVES) -> DataFrame:
    """(a, b), a > b: links that connect what is connected by pairs of fingerprints within reach.

    nodes: node (long, unique), bits (array of longs, unique), size (long).
    """
    spark = nodes.sparkSession
    n = nodes.count()
    depth = 0
    while (1 << depth) < most_leaves and n > leaf << depth:
        depth += 1
    salts = max(1, -(-n // (4 * leaf << depth)))
    # bounded: `sample` fingerprints for each of most_leaves leaves reach the driver, and the tree has as many nodes
    picked = nodes.orderBy(F.xxhash64("bits"), "node").limit(sample << depth).select("bits").toArrow() if depth else None
    grid = _matrix(picked.column("bits").combine_chunks()) if picked is not None else np.zeros((0, 1), np.uint64)
    tree = Tree(grid, depth)
    dealt = nodes.select("node", "bits", "size").mapInArrow(_route(tree, reach, salts), "shard long, salt long, home boolean, asks boolean, node long, bits array<long>, size long")
    return dealt.groupBy("shard", "salt").applyInArrow(_links(reach, ratio), "a long, b long")


def _shard_links(reach: int, ratio: float, percent: int = 0):
    """Links of every task (shard, one, two) of one bucket of tasks: inside a block, or between two.

    percent > 0: the column set holds the sorted shingle hashes of a row, and their similarity decides.
    """

    def rows(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, key, one, two, block = (table.column(c).to_numpy() for c in ("node", "shard", "one", "two", "block"))
        points = _matrix(table.column("bits").combine_chunks())
        sizes = table.column("size").to_numpy()
        order = np.lexsort((node, two, one, key))
        node, key, one, two, block, points, sizes = node[order], key[order], one[order], two[order], block[order], points[order], sizes[order]
        if percent:
            sets = table.column("set").combine_chunks()
            flat = sets.values.to_numpy()
            begin, end = sets.offsets.to_numpy()[:-1][order], sets.offsets.to_numpy()[1:][order]
        cut = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
        links = []
        for lo, hi in zip(cut.tolist(), np.append(cut[1:], len(key)).tolist()):
            if hi - lo > 1:
                if percent:
                    starts = np.append(0, np.cumsum(end[lo:hi] - begin[lo:hi]))
                    found = Proven(starts, np.concatenate([flat[x:y] for x, y in zip(begin[lo:hi].tolist(), end[lo:hi].tolist())]), percent)
                else:
                    found = Forest(hi - lo)
                homes, asks = np.flatnonzero(block[lo:hi] == one[lo]), np.flatnonzero(block[lo:hi] == two[lo])
                search(points[lo:hi], sizes[lo:hi], homes, asks, reach, ratio, found)
                links += [(node[lo + x], node[lo + y]) for x, y in found.links]
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return rows


def shard_links(nodes: DataFrame, parts: int, reach: int, ratio: float, block: int = 4_096, pivots: int = 0, percent: int = 0, sets: DataFrame | None = None, held_hashes: int = 1 << 21) -> DataFrame:
    """(a, b), a > b: links of fingerprints that share a smallest shingle, for radii at which the tree cannot prune.

    nodes: node, bits, minima (array of longs), size. A shard is one smallest shingle of one order; a shard
    of over `block` rows is dealt by hash over blocks, and a task compares two of them (or one with itself),
    so all pairs of a shard are compared at any size. pivots is not needed any more. percent > 0: sets
    gives the set of every node, and only pairs of such a similarity are linked; a block and a group of
    whole shards then hold about held_hashes hashes.
    """
    carried = ["node", "bits", "size", *(["set"] if percent else [])]
    keyed = nodes.select("node", "bits", "size", F.posexplode("minima").alias("order", "least")).withColumn("shard", F.xxhash64("order", "least")).drop("order", "least")
    hashes = F.sum("size") if percent else F.lit(0)
    held = keyed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), hashes.alias("hashes")).where("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("hashes") / held_hashes)).cast("long")
    full = keyed.join(held, "shard")
    met = (full.join(sets, "node") if percent else full).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    # a member goes to the tasks of its block with every block
    other = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    n, total = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("size") * F.size("minima")), F.lit(0))).first()
    buckets = F.lit(max(1, n // 10_000, total // held_hashes if percent else 0))
    # the tasks of a cut shard get groups of their own
    whole = F.col("blocks") == 1
    dealt = other.select(
        *carried, "shard", "block",
        F.least("block", "other").alias("one"),
        F.greatest("block", "other").alias("two"),
        F.when(whole, F.pmod(F.xxhash64("shard"), buckets)).otherwise(F.xxhash64("shard", F.least("block", "other"), F.greatest("block", "other"))).alias("bucket"),
    )
    return dealt.groupBy("bucket").applyInArrow(_shard_links(reach, ratio, percent), "a long, b long")


def _proven_links(docs: DataFrame, first: DataFrame, nominated: DataFrame, parts: int, reach: int, ratio: float, shingle: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """Links by shingle sets inside the components of nominated links; only texts of their nodes are read again.

    A component takes the place of a shard, so a set is sent once, and once a block where the component is cut.
    """
    named = components(nominated)
    # a root is in no row of its own
    members = materialise(named.unionByName(named.select(F.col("root").alias("node"), "root").distinct()), "member-roots")
    asked = materialise(first.drop("minima").join(members, "node").select("node", "bits", "size", "key", F.array("root").alias("minima")), "members")
    texts = docs.select(row_key(doc_id, text).alias("key"), F.col(text).alias("text")).join(broadcast_if_small(asked.select("key", "node")), "key")
    # rows of one key have one text
    once = texts.groupBy("node").agg(F.min("text").alias("text"))
    sets = once.select("node", shingle_sets(F.col("text"), shingle).alias("set"))
    return shard_links(asked, parts, reach, ratio, percent=percent, sets=sets)


#: Nodes of rows without an id lie above all ids.
LOOSE = 1 << 62


def near_groups(docs: DataFrame, shingle: int = 3, reach: int = 2, parts: int = 1, minima: int = 0, ratio: float = 0.0, percent: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """key, doc_id, bits, root, component_id: the smallest document id that links of fingerprints reach.

    minima = 0: shards of the vantage-point tree, every pair within reach is linked. minima > 0: shards
    of equal smallest shingles in so many orders; a pair of similarity s shares none with chance
    (1 - s) ** minima. ratio: smallest allowed ratio of the numbers of shingles. percent (with minima): pairs
    within reach are linked only if the sets of their distinct shingles have that similarity.
    """
    alike = ["bits", "minima", "size"] if percent else ["bits"]
    rows = docs.select(row_key(doc_id, text).alias("key"), F.col(doc_id).cast("long").alias("doc_id"), fingerprint(F.col(text), shingle, parts, minima).alias("all"))
    prints = materialise(rows.select("key", "doc_id", F.slice("all", 1, parts).alias("bits"), F.slice("all", parts + 1, minima).alias("minima"), F.element_at("all", -1).alias("size")), "fingerprints")
    loose = F.lit(LOOSE) + F.shiftrightunsigned(F.xxhash64(*alike), 2)
    rest = {"minima": F.min("minima"), "size": F.min("size"), "key": F.min("key")}
    first = materialise(
        prints.groupBy(*alike).agg(F.min("doc_id").alias("least"), *[v.alias(c) for c, v in rest.items() if c not in alike]).withColumn("node", F.coalesce("least", loose)),
        "distinct-fingerprints",
    )
    # two fingerprints share a node only if rows repeat an id: they are one document then
    found = near_links(first.select("node", "bits", "size"), reach, ratio) if not minima else shard_links(first, parts, reach, ratio)
    if percent:
        found = _proven_links(docs, first, materialise(found, "nominated"), parts, reach, ratio, shingle, percent, doc_id, text)
    named = materialise(first.join(components(found), "node", "left").select(*alike, F.coalesce("root", "node").alias("root")), "roots")
    return prints.join(named, alike).select("key", "doc_id", "bits", "root", F.when(F.col("root") < LOOSE, F.col("root")).alias("component_id"))
