"""Chunked decoding equals one fold over the whole history."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayweave.operators import chains as C

CLASSES = ["a", "b", "c"]


def histories(seed=0):
    """(person, w): a long gap-free history, one with gaps, a single window."""
    rng = np.random.default_rng(seed)
    long = [("long", 30 * i) for i in range(-40, 260)]
    holes = [("holes", 30 * i) for i in range(200) if rng.random() > 0.06]
    return long + holes + [("one", 30 * 77)]


def best_path(emit, step):
    score, back = emit[0], []
    for e in emit[1:]:
        cand = score[:, None] + step
        back.append(cand.argmax(axis=0))
        score = cand.max(axis=0) + e
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


@pytest.mark.parametrize("chunk", [1, 7, 64, 1024])
def test_viterbi_in_chunks_equals_one_fold(spark, chunk):
    rng = np.random.default_rng(1)
    rows = [(p, w, *rng.dirichlet([0.7] * 3).tolist()) for p, w in histories()]
    mats = {p: rng.dirichlet([0.4, 0.4, 0.4], 3) + np.eye(3) for p in ("long", "holes")}
    matrix = [(p, CLASSES[i], CLASSES[j], float(m[i, j] / m[i].sum())) for p, m in mats.items() for i in range(3) for j in range(3)]
    df = spark.createDataFrame(rows, "person string, w long, p_a double, p_b double, p_c double").repartition(5)
    got = {(r.person, r.w): r.label for r in C.viterbi_relabel(df, spark.createDataFrame(matrix, "person string, a string, b string, p double"), ["person"], CLASSES, chunk).collect()}
    want = {}
    for p in ("long", "holes", "one"):
        own = sorted(r for r in rows if r[0] == p)
        m = mats.get(p)
        prior = 0.85 * (m / m.sum(1, keepdims=True) if m is not None else np.full((3, 3), 1 / 3)) + 0.05
        cut = [0, *(i for i in range(1, len(own)) if own[i][1] - own[i - 1][1] != 30), len(own)]
        for a, b in zip(cut, cut[1:]):
            path = best_path(np.log(np.array([r[2:] for r in own[a:b]])), np.log(prior))
            want |= {(p, r[1]): CLASSES[s] for r, s in zip(own[a:b], path)}
    assert got == want


def filter_inputs(spark, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for p, w in histories(seed):
        gate = "away" if rng.random() < 0.05 else None
        fired = json.dumps([{"from_state": None, "to_state": "b", "strength": 0.5}]) if rng.random() < 0.1 else None
        probs = dict(zip(CLASSES, rng.dirichlet([0.6] * 3).tolist()))
        rows.append((p, w, str(int(rng.integers(4))), gate, json.dumps(probs), fired))
    moves = [(p, part, a, b, float(v)) for p in ("long", "holes") for part in "012" for a in [*CLASSES, "away"] for b, v in zip([*CLASSES, "away"], rng.dirichlet([0.5] * 4))]
    ends = [(p, s, d, float(rng.random())) for p in ("long", "holes") for s in CLASSES for d in range(1, 49)]
    df = spark.createDataFrame(rows, "person string, w long, part string, gate string, probs string, fired string")
    df = df.withColumn("probs", F.from_json("probs", "map<string,double>")).withColumn("fired", F.from_json("fired", "array<struct<from_state:string,to_state:string,strength:double>>"))
    return rows, moves, ends, df, spark.createDataFrame(moves, "person string, part string, a string, b string, p double"), spark.createDataFrame(ends, "person string, state string, d int, hazard double")


def folded(rows, moves, ends):
    out = {}
    for p in {r[0] for r in rows}:
        model = C.Model(json.dumps([dict(zip(("part", "a", "b", "p"), m[1:])) for m in moves if m[0] == p]), json.dumps([dict(zip(("state", "d", "hazard"), e[1:])) for e in ends if e[0] == p]))
        held, last = None, None
        for _, w, part, gate, probs, fired in sorted(r for r in rows if r[0] == p):
            if last is not None and w - last != 30:
                held = None
            state, conf, now, run = C.advance(model, held, part, gate, json.loads(probs), json.loads(fired) if fired else [])
            held, last = (state, run), w
            out[p, w] = (state, conf, now)
    return out


@pytest.mark.parametrize("chunk", [1, 9, 1024])
def test_forward_filter_in_chunks_equals_one_fold(spark, chunk):
    rows, moves, ends, df, m, e = filter_inputs(spark)
    got = {(r.person, r.w): (r.coarse, r.coarse_confidence, r.probs) for r in C.filtered_states(df.repartition(4), m, e, chunk).collect()}
    assert got == folded(rows, moves, ends)


def test_one_long_history_is_decoded_by_many_tasks(spark):
    rows = spark.range(60_000).select(F.lit("p").alias("person"), (F.col("id") * 30).alias("w"), *[(F.pmod(F.xxhash64("id", F.lit(c)), F.lit(1000)) / 1000 + 0.01).alias(f"p_{c}") for c in CLASSES])
    matrix = spark.createDataFrame([("p", a, b, 0.9 if a == b else 0.05) for a in CLASSES for b in CLASSES], "person string, a string, b string, p double")
    got = C.viterbi_relabel(rows, matrix, ["person"], CLASSES)
    pdf = rows.toPandas().sort_values("w")
    step = np.log(0.85 * (np.full((3, 3), 0.05) + 0.85 * np.eye(3)) + 0.05)
    want = [CLASSES[s] for s in best_path(np.log(pdf[["p_a", "p_b", "p_c"]].to_numpy()), step)]
    mine = got.withColumn("task", F.spark_partition_id()).toPandas().sort_values("w")
    assert mine.label.tolist() == want
    # 59 chunks on their own: no task folds the history
    assert mine.groupby(mine.w // (30 * C.CHUNK)).size().max() <= C.CHUNK
