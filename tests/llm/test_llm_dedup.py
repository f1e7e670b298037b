"""Exact and near dedup against brute force."""

import re

import numpy as np
import pytest
import xxhash

from dayweave.llm import block_names, simhash
from dayweave.functions.components import components
from pyspark.sql import functions as F


def exact(rows):
    """{(id, text): (keep_id, group size, kept)} by plain grouping."""
    groups = {}
    for i, t in {(i, t or "") for i, t in rows}:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", t), []).append((i, t))
    out = {}
    for members in groups.values():
        keep = max(members, key=lambda m: (len(m[1]), m[0] is not None, -(m[0] or 0)))
        for m in members:
            out[m] = (keep[0], len(members))
    return out


@pytest.mark.parametrize("route", [F.xxhash64, lambda b: F.pmod(F.xxhash64(b), F.lit(3))])
@pytest.mark.parametrize("block", [16, 4096])
def test_block_names_against_grouping(docs, odd, route, block):
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    # a hash of three values sends nearly all blocks through the join on their bytes
    small = both.where(F.coalesce(F.length("text"), F.lit(0)) < 3000) if block == 16 else both
    want = exact([tuple(r) for r in small.collect()])
    got = block_names.exact_groups(small, block=block, route=route).collect()
    assert len(got) == len(want)
    kept = 0
    groups = {}
    for r in got:
        same = [v for k, v in want.items() if k[0] == r.doc_id and len(k[1]) == r.n_chars]
        assert (r.keep_id, r.group_size) in same
        kept += r.kept
        groups.setdefault(r.text_sha256, []).append(r.kept)
    assert all(sum(v) == 1 for v in groups.values()) and kept == len(groups)


def test_block_names_of_nothing(empty):
    assert block_names.exact_groups(empty).count() == 0


def fingerprint(text, k):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, reach):
    """Smallest id of the component of every id, over all pairs."""
    ids = list(prints)
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if bin(prints[ids[a]] ^ prints[ids[b]]).count("1") <= reach:
                x, y = sorted((root(ids[a]), root(ids[b])))
                up[y] = x
    return {i: root(i) for i in ids}


def test_simhash_against_all_pairs(docs, texts):
    prints = {i: fingerprint(r.text, 3) for i, r in texts.items()}
    want = linked(prints, 2)
    got = {r.doc_id: r for r in simhash.near_groups(docs).collect()}
    assert {i: r.bits[0] & ((1 << 64) - 1) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == want


@pytest.mark.parametrize("reach, leaves", [(1, 1 << 15), (2, 1 << 15), (2, 4), (5, 8)])
def test_trees_find_every_planted_link(spark, reach, leaves):
    rng = np.random.default_rng(reach)
    points = set(rng.integers(0, 1 << 62, 1500).tolist())
    for p in list(points)[:300]:
        for _ in range(4):
            flips = rng.choice(62, rng.integers(1, reach + 2), replace=False)
            points.add(p ^ int(sum(1 << int(f) for f in flips)))
    prints = dict(enumerate(sorted(points)))
    nodes = spark.createDataFrame([(i, [p], 1) for i, p in prints.items()], "node long, bits array<long>, size long")
    got = components(simhash.near_links(nodes, reach, leaf=64 if leaves > 100 else 16, most_leaves=leaves)).toPandas()
    mine = {i: i for i in prints} | dict(zip(got.node, got.root))
    assert mine == linked(prints, reach)


def test_local_search_of_a_dense_group():
    rng = np.random.default_rng(0)
    center = rng.integers(0, 1 << 63, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(900)], dtype=object)
    points = np.unique(np.array([int(center) ^ f for f in flips], dtype=np.uint64))
    found = simhash.Forest(len(points))
    simhash.search(points[:, None], np.ones(len(points), np.int64), np.arange(len(points)), np.arange(len(points)), 2, 0.0, found)
    want = linked({i: int(p) for i, p in enumerate(points)}, 2)
    assert [found.root(i) for i in range(len(points))] == [want[i] for i in range(len(points))]
    assert len(found.links) < len(points)


def test_components_of_a_chain(spark):
    order = np.random.default_rng(1).permutation(300).tolist()
    edges = [(max(a, b), min(a, b)) for a, b in zip(order[:200], order[1:200])] + [(1000, 900), (900, 800)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    chain = set(order[:200])
    assert got == {x: min(chain) for x in chain - {min(chain)}} | {1000: 800, 900: 800}


def test_simhash_of_odd_rows(odd, odd_rows, empty):
    got = simhash.near_groups(odd).collect()
    assert len(got) == len(odd_rows)
    proven = simhash.near_groups(odd, shingle=5, reach=34, parts=2, minima=6, percent=80)
    assert proven.count() == len(odd_rows) and simhash.near_groups(empty, minima=6, parts=2, percent=80).count() == 0
    blank = {r.component_id for r in got if r.doc_id in (2, 3, 4)}
    assert blank == {2} and {r.component_id for r in got if r.doc_id in (7, 8)} == {7}
    assert len({r.root for r in got if r.doc_id is None}) == 2 and all(r.component_id is None for r in got if r.doc_id is None)
    assert simhash.near_groups(empty).count() == 0


def test_minimum_shards_join_near_copies_only(spark):
    rng = np.random.default_rng(4)
    fresh = lambda n: [f"w{v}" for v in rng.integers(0, 1 << 30, n)]
    rows, near = [], {}
    for g in range(40):
        words = fresh(400)
        for c in range(5):
            copy = list(words)
            for at in rng.choice(400, 4, replace=False):
                copy[at] = f"x{rng.integers(0, 1 << 30)}"
            near[len(rows)] = 5 * g
            rows.append((len(rows), " ".join(copy)))
    for _ in range(300):
        near[len(rows)] = len(rows)
        rows.append((len(rows), " ".join(fresh(300))))
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5, reach=24, parts=2, minima=6, ratio=0.7).collect()
    assert {r.doc_id: r.component_id for r in got} == near


def jaccard_groups(rows, percent):
    """{id: smallest id} over links of five-word shingle sets, by comparing all pairs."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in ((i, t.lower().split()) for i, t in rows)}
    lead = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and lead[a] != lead[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                one, two = sorted((lead[a], lead[b]))
                lead.update({i: one for i, r in lead.items() if r == two})
    return lead


def test_shingle_sets_decide_at_the_limit(spark):
    """Stars and chains with similarities on both sides of 0.8, repeated passages, order, case and blanks."""
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(50):
        words = [f"w{v}" for v in rng.integers(0, 1 << 30, 300)]
        rows.append((len(rows), " ".join(words)))
        for _ in range(4):
            copy = list(words)
            at = int(rng.integers(0, 200))
            size = int(rng.integers(20, 45))  # similarities of about 0.72 to 0.86
            copy[at : at + size] = [f"x{v}" for v in rng.integers(0, 1 << 30, size)]
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000, rows[0][1].upper()), (1001, rows[5][1] + "  " + rows[5][1]), (1002, "few words"), (1003, "Few\tWORDS "), (1004, "few other words"), (1005, ""), (1006, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = simhash.near_groups(docs, shingle=5, reach=34, parts=2, minima=6, percent=80).collect()
    want = jaccard_groups(rows, 80)
    assert {r.doc_id: r.component_id for r in got} == want
    assert 100 < len(set(want.values())) < 240  # links and refusals both occur


def test_shingle_sets_inside_cut_shards(spark):
    """A shared passage brings all rows into one shard; blocks bounded by hashes still compare all pairs."""
    rng = np.random.default_rng(9)
    flat = [np.unique(rng.integers(0, 1 << 40, 50)) for _ in range(60)]
    rows = [(3 * k + j, [0], [5], 50, sorted({*x[c:].tolist(), *range(c)})) for k, x in enumerate(flat) for j, c in enumerate((0, 2, 30))]
    nodes = spark.createDataFrame(rows, "node long, bits array<long>, minima array<long>, size long, set array<long>")
    sets = nodes.select("node", "set")
    got = components(simhash.shard_links(nodes, 1, 2, 0.0, block=40, percent=80, sets=sets, held_hashes=1000)).toPandas()
    assert dict(zip(got.node, got.root)) == {3 * k + 1: 3 * k for k in range(60)}
    assert components(simhash.shard_links(nodes, 1, 2, 0.0, block=40)).count() == 179  # the bits alone link all


def test_hot_shard_is_cut_into_blocks(spark):
    nodes = spark.range(3000).selectExpr("id as node", "array(id % 7, 0L) as bits", "array(5L) as minima", "1L as size")
    links = simhash.shard_links(nodes, 2, 4, 0.0, block=200, pivots=64)
    got = components(links).toPandas()
    assert len(got) == 2999 and set(got.root) == {0}


def test_cut_shard_compares_all_pairs(spark):
    # 400 pairs that meet in one shard only, by a shared passage; nothing else is near
    rng = np.random.default_rng(6)
    points = rng.integers(0, 1 << 62, (400, 2))
    rows = [(2 * k + c, [int(a) ^ c, int(b)], [5], 1) for k, (a, b) in enumerate(points.tolist()) for c in range(2)]
    nodes = spark.createDataFrame(rows, "node long, bits array<long>, minima array<long>, size long")
    got = components(simhash.shard_links(nodes, 2, 4, 0.0, block=20)).toPandas()
    assert dict(zip(got.node, got.root)) == {2 * k + 1: 2 * k for k in range(400)}
