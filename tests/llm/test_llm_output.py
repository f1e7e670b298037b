"""Token files, mixing, packing, chat, masked LM and the pipeline."""

import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from dayweave.llm import chat, masked_lm, mixing, packing, token_files
from dayweave.llm.common import materialise, scratch_path
from dayweave.llm.queries import QUERIES, tokenizer
from pyspark.sql import functions as F


def encoded(name, texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer(name))
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_against_the_library(spark, docs, odd):
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text").where("doc_id is null or doc_id > 8").withColumn("doc_id", F.col("doc_id") + 100_000))
    path = scratch_path(spark, "test")
    token_files.write_token_files(both, path, tokenizer("word_bpe_49k.json"))
    got = token_files.checksums(token_files.read_token_files(spark, path)).toPandas().sort_values("start")
    rows = sorted(((r.doc_id, r.text) for r in both.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    ids = encoded("word_bpe_49k.json", [t for _, t in rows], 2)
    named = [(i, len(x), crc(x)) for (i, _), x in zip(rows, ids)]
    mine = [(None if pd.isna(r.doc_id) else int(r.doc_id), r.n_tokens, r.ids_crc32) for r in got.itertuples()]
    assert mine[2:] == named[2:] and sorted(map(str, mine[:2])) == sorted(map(str, named[:2]))
    assert got.start.tolist() == np.concatenate(([0], np.cumsum(got.n_tokens)[:-1])).tolist()
    found = token_files.find_documents(spark, path, [5, 7]).collect()
    assert {r.doc_id: r.ids for r in found} == {i: x for (i, _), x in zip(rows, ids) if i in (5, 7)}


def test_token_files_have_indexes(spark, docs):
    import glob

    from pyarrow import orc

    path = scratch_path(spark, "test")
    token_files.write_token_files(docs, path, tokenizer("word_bpe_49k.json"))
    files = [orc.ORCFile(f) for f in sorted(glob.glob(path.removeprefix("file:") + "/*.orc"))]
    assert sum(f.nrows for f in files) == docs.count() and all(f.compression == "ZSTD" for f in files)
    ranges = [(min(v), max(v)) for v in (f.read(["doc_id"])["doc_id"].to_pylist() for f in files) if v]
    assert all(a[1] < b[0] for a, b in zip(sorted(ranges), sorted(ranges)[1:]))


def test_token_files_of_nothing(spark, empty):
    path = scratch_path(spark, "test")
    token_files.write_token_files(empty, path, tokenizer("word_bpe_49k.json"))
    assert token_files.checksums(token_files.read_token_files(spark, path)).count() == 0


def check_pieces(pieces, texts_by_id, most=1024):
    """Every id of every document lies in one piece; sequences are gapless and need no padding."""
    sequences, docs = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
        docs[p.doc_id].append(p)
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.concatenate(([0], np.cumsum([p.length for p in own])[:-1])).tolist()
        total = sum(p.length for p in own)
        assert total <= most and (total == most or total & (total - 1) == 0)
    want = Counter()
    for i, texts in texts_by_id.items():
        for ids in encoded("byte_bpe_50k.json", texts, 0):
            cuts = Counter((p.start, p.length, p.ids_crc32) for p in docs[i] if p.doc_tokens == len(ids))
            covered = sum(length * n for (s, length, c), n in cuts.items() if crc(ids[s : s + length]) == c)
            want[i] += len(ids)
            assert covered >= len(ids)
    assert {i: sum(p.length for p in v) for i, v in docs.items()} == dict(want)


def test_packing_against_the_library(docs, odd, texts, odd_rows):
    check_pieces(packing.pack(docs, tokenizer("byte_bpe_50k.json")).collect(), {i: [r.text] for i, r in texts.items()})
    by_id = defaultdict(list)
    for r in odd_rows:
        by_id[r[0]].append(r[1])
    check_pieces(packing.pack(odd, tokenizer("byte_bpe_50k.json")).collect(), by_id)


def test_packing_of_nothing(empty):
    assert packing.pack(empty, tokenizer("byte_bpe_50k.json")).count() == 0


def test_bm25_ranks_against_the_formula():
    import math
    import re

    import pyarrow as pa

    from dayweave.llm import text as T

    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{v}" for v in rng.integers(0, 30, rng.integers(1, 25))) for _ in range(40)]
    (_, data, offs), = T.runs(pa.array([t.encode() for t in texts]))
    words = [re.findall(r"\S+", t) for t in texts]
    df = Counter(w for ws in words for w in set(ws))
    idf = {w: max(0.0, math.log((40 - n + 0.5) / (n + 0.5))) for w, n in df.items()}
    grid = np.zeros(1 << packing.DF_BITS, np.float32)
    for w in df:
        (_, d, o), = T.runs(pa.array([w.encode()]))
        grid[int(packing._terms(d, o)[0][0] >> np.uint64(64 - packing.DF_BITS))] = idf[w]
    mean = sum(map(len, words)) / 40
    index = packing.Index(data, offs, grid, mean)
    for seed in range(40):
        score = [sum(idf[w] * ws.count(w) * 2.2 / (ws.count(w) + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w in set(words[seed]) & set(ws)) if k != seed else 0 for k, ws in enumerate(words)]
        got = index.ranked(seed)
        assert len(got) == sum(s > 0 for s in score)
        assert all(score[a] >= score[b] - 1e-4 for a, b in zip(got, got[1:]))


def test_packing_puts_neighbours_together(spark):
    rng = np.random.default_rng(8)
    topics = [[f"t{k}w{v}" for v in range(60)] for k in range(12)]
    rows = [(i, " ".join(rng.choice(topics[i % 12], 90))) for i in range(240)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), tokenizer("byte_bpe_50k.json")).toPandas()
    mixed = got.assign(topic=got.doc_id % 12).groupby("sequence_id").topic.nunique()
    assert mixed.mean() < 1.6


def test_packing_finds_neighbours_in_all_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_WORDS", 10_000, raising=False)
    rng = np.random.default_rng(12)
    common = [f"c{v}" for v in range(300)]
    pairs = [[f"p{k}w{v}" for v in range(12)] for k in range(400)]
    rows = [(400 * half + k, " ".join(rng.permutation([*pairs[k], *rng.choice(common, 60)]))) for half in range(2) for k in range(400)]
    # partners lie in different partitions; a third of all rows are copies of one text
    rows += [(1000 + i, rows[7][1]) for i in range(400)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(4, "doc_id"), tokenizer("byte_bpe_50k.json")).toPandas()
    # a partition is one task's shards
    own = (got.sequence_id // (1 << 40)).groupby(got.doc_id).agg(set)
    assert got.doc_id.nunique() == 1200 and len(set.union(*own)) > 4
    assert np.mean([bool(own[k] & own[400 + k]) for k in range(400)]) > 0.93


def test_packing_writes_only_terms_that_tie_texts(spark, monkeypatch):
    """Words of one text and smallest shingles that no other text has are not written."""
    written = {}

    def keep(df, name):
        written[name] = materialise(df, name)
        return written[name]

    monkeypatch.setattr(packing, "materialise", keep)
    rows = [(1, "a b c shared"), (2, "d e f shared"), (3, "g h i j"), (4, "k l m n o"), (5, "k l m n o"), (6, ""), (7, "solo")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    texts = docs.select(F.xxhash64(F.col("text").cast("binary")).alias("node"), F.col("text").cast("binary").alias("text"))
    got = packing.neighbours(texts, *packing.term_weights(docs))
    assert {t for r in got.collect() for t in (r.hub, r.best) if t is not None} <= {r.node for r in texts.collect()}
    by_id = {r.doc_id: r.node for r in docs.select("doc_id", F.xxhash64(F.col("text").cast("binary")).alias("node")).collect()}
    assert {r.node: r.best for r in got.collect() if r.best} == {by_id[1]: by_id[2], by_id[2]: by_id[1]}
    # one word in two texts; copies are one text
    assert sum(df.count() for df in written.values()) == 2


def test_mixing_meets_targets(docs, texts):
    got = mixing.mix(docs).toPandas()
    size = got.groupby("source")["size"].sum()
    assert (got["taken"] <= 2 * got["size"]).all()
    for source, own in got.groupby("source"):
        target = own.target.iloc[0]
        assert abs(own.taken.sum() - target) <= max(own["size"].min(), 0.005 * target) and target <= 2 * size[source] + 1e-6
    assert abs(got.groupby("source").target.first().sum() - 1.5 * size.sum()) < 1e-3
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert dict(zip(got.doc_id, got.taken)) == dict(zip(again.doc_id, again.taken))


def test_newton_with_priors_solves_the_dual(spark):
    rng = np.random.default_rng(6)
    cells = [(s, float(q), int(t)) for s in "abc" for q, t in zip(rng.random(25) * 3, rng.integers(1, 900, 25))]
    totals = {s: sum(t for x, _, t in cells if x == s) for s in "abc"}
    want = {"a": 0.4 * totals["a"], "b": 1.3 * totals["b"], "c": 1.9 * totals["c"]}
    kind = "source struct<name:string>"
    rows = spark.createDataFrame([((s,), q, t) for s, q, t in cells], f"{kind}, prior double, tokens long")
    targets = spark.createDataFrame([((s,), totals[s], t) for s, t in want.items()], f"{kind}, source_size long, target double")
    lam = {r.source.name: r.lam for r in mixing.balanced_rates(rows, targets).collect()}
    for s, t in want.items():
        assert abs(sum(n * min(2.0, q * np.exp(lam[s])) for x, q, n in cells if x == s) - t) < 1e-6 * t


def test_mixing_of_odd_rows(odd, odd_rows, empty):
    got = mixing.mix(odd).toPandas()
    assert len(got) == len(odd_rows) and got["size"].sum() > 0 and (got.taken <= 2 * got["size"]).all()
    assert (got.copies.between(0, 2)).all() and mixing.mix(empty).count() == 0
    with_prior = mixing.mix(odd.withColumn("q", F.rand(3) + 0.2), prior="q").toPandas()
    own = with_prior[with_prior.source == "b"]
    assert abs(own.taken.sum() - own.target.iloc[0]) <= own["size"].max()


def test_large_classes_are_ranked_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 50)
    docs = spark.range(1200).selectExpr("id as doc_id", "'five words are in here' as text", "if(id < 1000, 'a', 'b') as source")
    got = mixing.mix(docs, weights=(1.0, 4.0)).toPandas()
    for _, own in got.groupby("source"):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= 5
        assert own.copies.max() - own.copies.min() <= 1


def test_chat_of_odd_turns(spark):
    rows = [
        (1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "ann", "tie"), (1, 2, "ann", "tie"), (1, None, "ann", "late"), (1, 3, None, "who"),
        (None, 0, "x", ""), (2, 0, "system", "alone"), *((3, k, "ann" if k % 2 else "bob", "w" * (k % 50)) for k in range(1000)),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"speaker": F.lit("clash"), "part": F.lit(1), "said": F.lit(2)})
    got = chat.rotate(turns).collect()
    assert {(r.conv_id, r.speaker) for r in got} == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "x"), (3, "ann"), (3, "bob")}
    whole = defaultdict(str)
    for r in sorted(got, key=lambda r: (str(r.conv_id), r.speaker, r.part)):
        assert r.start == len(whole[r.conv_id, r.speaker])
        whole[r.conv_id, r.speaker] += r.text
        for m in r.masks:
            assert r.text[: m.start].endswith("<|assistant|>\n") and r.text[m.start : m.end].endswith("<|end|>\n")
    assert whole[1, "ann"] == "<|system|>\nrules<|end|>\n<|assistant|>\nhi<|end|>\n<|assistant|>\ntie<|end|>\n<|user|>\nbob: <|end|>\n<|user|>\nunknown: who<|end|>\n<|assistant|>\nlate<|end|>\n"
    assert whole[3, "bob"].count("<|assistant|>") == 500 and whole[3, "bob"].count("<|user|>\nann: ") == 500
    assert chat.rotate(turns.limit(0)).count() == 0


def test_masked_lm_against_plain_formulas():
    rng = np.random.default_rng(5)
    m = masked_lm.opened(rng.normal(0, 0.5, len(masked_lm.start_model())).astype(np.float32))
    ids, row = rng.integers(0, masked_lm.VOCAB, 40), np.repeat([0, 1, 2], [25, 1, 14])
    around = masked_lm.contexts(ids, row)
    got = masked_lm.log_chances(m, ids, around)
    soft = lambda z: z - np.log(np.exp(z).sum())
    for i in range(40):
        total = np.zeros(masked_lm.DIMS)
        for k, d in enumerate((-3, -2, -1, 1, 2, 3)):
            j = i + d
            near = ids[j] if 0 <= j < 40 and row[j] == row[i] else masked_lm.VOCAB
            assert around[i, k] == near
            total += m["embed"][near] * m["place"][k]
        h = np.tanh(total @ m["mix"] + m["mix_bias"])
        group, word = ids[i] % 64, ids[i] // 64
        want = soft(h @ m["group"] + m["group_bias"])[group] + soft(h @ m["word"][group] + m["word_bias"][group])[word]
        assert abs(got[i] - want) < 1e-3


@pytest.mark.parametrize("scale", [0.3, 40])
def test_masked_lm_step_follows_plain_gradients(scale):
    """One step over two texts, against softmax and sums written out; also where exponents are far apart."""
    M, rng = masked_lm, np.random.default_rng(2)
    flat = rng.normal(0, 0.3, len(M.start_model())).astype(np.float32)
    m = M.opened(flat)
    m["group_bias"] *= scale
    m["word_bias"] *= scale
    ids, row = rng.integers(0, 200, 300), np.repeat([0, 1], [120, 180])
    around, was = M.contexts(ids, row), {k: v.astype(float) for k, v in m.items()}
    total = sum(was["embed"][around[:, k]] * was["place"][k] for k in range(2 * M.REACH))
    hidden = np.tanh(total @ was["mix"] + was["mix_bias"])
    want = {k: np.zeros_like(v) for k, v in was.items()}
    for i, (h, t) in enumerate(zip(hidden, ids)):
        group, word = t % M.CLASSES, t // M.CLASSES
        soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        a = soft(h @ was["group"] + was["group_bias"]) - np.eye(M.CLASSES)[group]
        b = soft(h @ was["word"][group] + was["word_bias"][group]) - np.eye(M.CLASSES)[word]
        want["group"] += np.outer(h, a)
        want["group_bias"] += a
        want["word"][group] += np.outer(h, b)
        want["word_bias"][group] += b
        back = (was["group"] @ a + was["word"][group] @ b) * (1 - h * h)
        want["mix"] += np.outer(total[i], back)
        want["mix_bias"] += back
        back = was["mix"] @ back
        for k in range(2 * M.REACH):
            want["place"][k] += was["embed"][around[i, k]] * back
            want["embed"][around[i, k]] += was["place"][k] * back
    want["embed"][M.VOCAB] = 0
    sums = {k: np.zeros_like(v) for k, v in m.items()}
    M.learn(m, ids, around, sums, 0.1)
    for name, g in want.items():
        g = g / len(ids)
        assert np.allclose(sums[name], g * g, rtol=1e-3, atol=1e-7), name
        assert np.allclose(m[name], was[name] - 0.1 * g / np.sqrt(g * g + 1e-8), atol=2e-3), name


def test_masked_lm_step_makes_few_calls():
    """Softmax, sums and word gradients are taken over a whole step, not class by class: over 900 calls a step before."""
    ids, row = np.arange(masked_lm.STEP) % masked_lm.VOCAB, np.arange(masked_lm.STEP) // 100
    m = masked_lm.opened(masked_lm.start_model())
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(arg) if event == "c_call" else None)
    try:
        masked_lm.learn(m, ids, masked_lm.contexts(ids, row), {k: np.zeros_like(v) for k, v in m.items()}, 0.1)
    finally:
        sys.setprofile(None)
    assert len(calls) < 300


def test_masked_lm_prefers_word_order(spark):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"k{(s + j) % 40}" for j in range(200))) for i, s in enumerate(rng.integers(0, 40, 400))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    known = masked_lm.vocabulary(docs)
    model = masked_lm.train(docs, known, share=1, rounds=2)
    probe = spark.createDataFrame([(1, rows[0][1]), (2, " ".join(rng.permutation(rows[0][1].split())))], "doc_id long, text string")
    got = {r.doc_id: r.s.mean_log_prob for r in probe.select("doc_id", masked_lm.score(F.col("text"), model, known).alias("s")).collect()}
    assert got[1] > got[2] + 0.5


def test_masked_lm_learns_from_every_document(spark):
    """A table of any one document gives a model; none is left out of training by its id."""
    for i in range(4):
        one = spark.createDataFrame([(i, "the cat sat on the mat " * (i + 1))], "doc_id long, text string")
        assert (masked_lm.train(one, masked_lm.vocabulary(one)) != masked_lm.start_model()).any()


def test_masked_lm_of_odd_rows(odd, empty, odd_rows):
    known = masked_lm.vocabulary(odd)
    model = masked_lm.train(odd, known, share=1, rounds=1)
    got = odd.select("doc_id", "text", masked_lm.score(F.col("text"), model, known).alias("s")).collect()
    assert len(got) == len(odd_rows)
    assert all((r.s.n_tokens == 0) == (r.s.mean_log_prob is None) and r.s.sum_log_prob <= 0 for r in got)
    assert len(masked_lm.vocabulary(empty)) == 0
    assert (masked_lm.train(empty, known) == masked_lm.start_model()).all()


def test_every_stage_of_the_pipeline(spark, docs, texts, sf_dir):
    from test_llm_dedup import exact
    from test_llm_filters import verdicts

    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash_near_dedup", "source_mixing", "bm25_packing"]
    judged = materialise(stages["quality_rules"](spark, docs, sf_dir), "t")
    want = {i: t for i, _, kept, t in verdicts([(r.doc_id, r.text, r.source) for r in texts.values()], 10, 0.05, 0.5) if kept}
    assert {r.doc_id: r.text for r in judged.collect()} == want and judged.columns == docs.columns
    once = materialise(stages["exact_dedup"](spark, judged, sf_dir), "t")
    kept = {v[0] for v in exact(list(want.items())).values()}
    assert {r.doc_id for r in once.collect()} == kept and once.columns == docs.columns
    apart = materialise(stages["simhash_near_dedup"](spark, once, sf_dir), "t")
    left = {r.doc_id: r.text for r in apart.collect()}
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((r.doc_id, r.text.lower().split()) for r in once.collect())}
    near = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    # one row stays of what links of 0.8 or more connect, and nothing else goes
    lead = {i: i for i in shingles}
    for a, b in ((a, b) for a in shingles for b in shingles if a < b and near(a, b) >= 0.8):
        one, two = sorted((lead[a], lead[b]))
        lead.update({i: one for i, r in lead.items() if r == two})
    assert set(left) == set(lead.values())
    mixed = materialise(stages["source_mixing"](spark, apart, sf_dir), "t")
    copies = Counter(r.doc_id for r in mixed.collect())
    assert set(copies.values()) <= {1, 2} and set(copies) <= set(left) and mixed.columns == docs.columns
    pieces = stages["bm25_packing"](spark, mixed, sf_dir).collect()
    check_pieces(pieces, {i: [left[i]] * n for i, n in copies.items()})


def test_pipeline_stages_take_odd_rows(spark, odd, empty, sf_dir):
    for start in (odd, empty):
        docs = start.select("doc_id", "text", "lang", "source", "n_chars")
        for name, stage in corpus_pipeline.STAGES:
            after = materialise(stage(spark, docs, sf_dir), name)
            if name == "quality_rules":
                assert after.count() <= docs.count()
                continue  # the next stages get the odd rows themselves
            docs = after


def test_pipeline_keeps_clashing_columns_and_picks_repeated_rows_alike(spark, sf_dir):
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    rows = [(i, body(i), lang, "a", 0, f"k{i}", 7, "r", "d") for i in range(6) for lang in (("en", "de", None) if i == 3 else ("en",))]
    columns = ["doc_id", "text", "lang", "source", "n_chars", "_key", "_copies", "row", "a.b"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _key string, _copies int, row string, `a.b` string"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = set()
        for parts in (1, 5):
            docs = spark.createDataFrame(rows[::-1] if parts == 5 else rows, schema).repartition(parts)
            after = materialise(stage(spark, docs, sf_dir), name)
            assert after.columns == columns
            got = after.collect()
            assert {r.doc_id for r in got} == (set(range(6)) if name != "source_mixing" else {r.doc_id for r in got})
            assert {(r[5], r[6], r[7], r[8]) for r in got} <= {(f"k{i}", 7, "r", "d") for i in range(6)}
            if name in ("exact_dedup", "simhash_near_dedup"):
                assert len(got) == 6
            seen.add(tuple(sorted(map(str, got))))
        assert len(seen) == 1 or name == "source_mixing"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_gives_one_schema(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    assert got.columns[0] in ("doc_id", "conv_id") and got.count() > 0
