"""SetSketch near-dedup against exact sets and all pairs."""

import re

import numpy as np
import pytest

from dayweave.llm import set_sketch as S


def shingle_sets(rows):
    out = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        out[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    return out


def linked(sets, percent):
    ids = list(sets)
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(ids[a]), root(ids[b])))
                up[q] = p
    return {i: root(i) for i in ids}


def check(spark, rows, percent=85):
    sets = shingle_sets(rows)
    want = linked(sets, percent)
    got = {r.doc_id: r for r in S.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), percent).collect()}
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    return want


def test_documents_against_all_pairs(spark, texts):
    check(spark, [(i, r.text) for i, r in texts.items()])


def edited(words, n, rng):
    words = list(words)
    for at in rng.choice(len(words), n, replace=False):
        words[at] = f"x{rng.integers(1 << 40)}"
    return " ".join(words)


def test_groups_around_the_limit(spark):
    rng = np.random.default_rng(1)
    fresh = lambda n: [f"w{v}" for v in rng.integers(0, 1 << 40, n)]
    rows = []
    for g in range(60):  # similarities on both sides of 0.85, and stars whose arms are further apart
        base = fresh(200)
        rows.append(" ".join(base))
        rows += [edited(base, int(k), rng) for k in rng.integers(1, 7, 5)]
    passage = fresh(120)  # a passage shared by many documents
    rows += [" ".join(passage + fresh(40)) for _ in range(80)]
    order = rng.permutation(len(rows))
    want = check(spark, [(int(i) + 1, rows[k]) for i, k in enumerate(order)])
    assert 60 < len(set(want.values())) < len(rows) - 60


def test_large_group_of_near_copies_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 40)
    monkeypatch.setattr(S.crossing_links, "__defaults__", (40, 200))
    rng = np.random.default_rng(2)
    base = [f"w{v}" for v in rng.integers(0, 1 << 40, 300)]
    # arms of a star are below the limit to each other, its centre has the largest id
    rows = [(i, edited(base, 4, rng)) for i in range(300)] + [(900, " ".join(base))]
    assert set(check(spark, rows).values()) == {0}
    apart = [(i, edited(base, 8, rng)) for i in range(200)]
    assert len(set(check(spark, apart).values())) == 200


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(3)
    for shared in (0.5, 0.85, 0.95):
        n = 4000
        both = int(2 * n * shared / (1 + shared))
        pool = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64) * np.uint64(2)
        a, b = pool[:n], pool[n - both :]
        flat, cut = np.concatenate((a, b, pool)), np.cumsum([0, len(a), len(b), len(pool)])
        regs = S.registers_of(flat, cut)
        assert np.array_equal(S.merge(regs[:2]), regs[2])
        x, y = regs[0], regs[1]
        got = S.likelihood_estimate(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([float(n)]), np.array([float(n)]))[0]
        true = both / (2 * n - both)
        assert abs(got - true) < 5 * np.sqrt(true * (1 - true) / S.REGISTERS) + 1e-3


def test_odd_rows(spark, odd, odd_rows, empty):
    got = S.near_groups(odd).collect()
    assert len(got) == len(odd_rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert all(r.n_shingles == 0 and r.component_id == i and r.kept for i in (2, 3, 4) for r in by[i])
    assert [r.component_id for r in by[6]] == [5] and not by[6][0].kept and by[5][0].kept
    assert {r.component_id for r in by[7] + by[8]} == {7} and len(by[8]) == 2
    assert all(r.component_id is None and r.kept for r in by[None])
    assert S.near_groups(empty).count() == 0


@pytest.mark.parametrize("text, n", [("One TWO three", 1), ("a b c d e", 1), ("a b c d e a b c d e", 5), (" \t\n", 0), (None, 0)])
def test_number_of_shingles(spark, text, n):
    assert S.near_groups(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().n_shingles == n


def test_rows_that_repeat_an_id(spark):
    rows = [(1, "a b c d e f g"), (1, "p q r s t u v"), (2, "A  b c d e f g"), (3, "p q r s t u v")]
    got = {(r.doc_id, r.component_id) for r in S.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1)}
