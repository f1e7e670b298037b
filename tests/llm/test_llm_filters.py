"""Quality rules, classifier, language: brute force, held-out accuracy, odd rows."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from dayweave.llm import language, line_rules, quality_model
from dayweave.llm.common import crc32_of_id
from dayweave.llm.queries import ORACLES, QUERIES
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def plain_line(x):
    return re.sub(r"[\x20\x09\x0B-\x0D]+", " ", re.sub("[0-9]+", "0", x.lower())).strip(" ")


def verdicts(rows, min_docs, share, left):
    """(base counts, kept, clean text) by plain loops; rows: (id, text, host)."""
    held, size = defaultdict(set), Counter(h for _, _, h in rows)
    for i, t, h in rows:
        for x in (t or "").split("\n"):
            held[h, plain_line(x)].add((i, t))
    above = {k for k, v in held.items() if k[1] and len(v) > max(min_docs, share * size[k[0]])}
    for i, t, h in rows:
        b = base(t)
        gone = [x for x in (t or "").split("\n") if (h, plain_line(x)) in above]
        lost = sum(len(plain_line(x).split(" ")) for x in gone)
        failed = b[0] < 20 or 100 * b[4] > 30 * b[0]
        clean = t if not gone else "\n".join(x for x in t.split("\n") if (h, plain_line(x)) not in above)
        yield i, b, not failed and b[0] - lost >= left * b[0], clean


@pytest.mark.parametrize("limit", [(10, 0.05), (1, 0.0)])
def test_line_rules_against_loops(docs, odd, limit):
    both = docs.select("doc_id", "text", "source").unionByName(odd.select("doc_id", "text", "source"))
    rows = [tuple(r) for r in both.collect()]
    got = line_rules.line_frequency(both, min_docs=limit[0], max_share=limit[1]).collect()
    mine = sorted(((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), r.kept, r.clean_text) for r in got), key=str)
    assert mine == sorted(verdicts(rows, limit[0], limit[1], 0.5), key=str)


def test_copies_do_not_make_their_lines_boilerplate(spark, sf_dir):
    import corpus_pipeline

    rng = np.random.default_rng(3)
    fresh = lambda: " ".join(f"w{chr(97 + v % 26)}{chr(97 + v // 26)}" for v in rng.integers(0, 676, 40))
    one = f"{fresh()}\n{fresh()}"
    rows = [(i, one if i % 2 else one.replace(" ", "  "), "h") for i in range(30)] + [(100 + i, f"{fresh()}\nthe same footer", "h") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.char_length("text").cast("long"))
    got = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["quality_rules"](spark, docs, sf_dir).collect()}
    assert len(got) == 60 and all(got[i] == rows[i][1] for i in range(30))
    assert not [t for t in got.values() if "footer" in t]


def test_line_rules_carry_clashing_columns(odd, empty, odd_rows):
    got = line_rules.line_frequency(odd)
    assert got.count() == len(odd_rows) and got.select("row.kept", "row.row").first() == (1, "x")
    assert line_rules.line_frequency(empty).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    from test_oracle import canonical

    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


def test_quality_model_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op3_quality_ftrl"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = got.score[got.quality == 1].to_numpy(), got.score[got.quality == 0].to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.97
    assert ((got.score >= 0.3) == (got.predicted == 1)).all() and got.score.between(0, 1).all()


def test_ftrl_against_plain_updates():
    rng = np.random.default_rng(3)
    rows = [(float(k % 2), np.sort(rng.choice(40, 5, replace=False)) + 20 * (k % 2), rng.random(5).astype(np.float32)) for k in range(60)]
    got = quality_model.ftrl(rows, epochs=2)
    z, n = defaultdict(float), defaultdict(float)
    weight = lambda i: 0.0 if abs(z[i]) <= 0.001 else -(z[i] - np.sign(z[i]) * 0.001) / ((0.1 + n[i] ** 0.5) / 0.5)
    for _ in range(2):
        for y, b, x in rows:
            pairs = [*zip(b.tolist(), x.tolist()), (1 << quality_model.BITS, 1.0)]
            w = {i: weight(i) for i, _ in pairs}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in pairs)))
            for i, v in pairs:
                g = (p - y) * v
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.5 * w[i]
                n[i] += g * g
    assert all(abs(weight(i) - got[i]) < 1e-5 for i in z)


def test_quality_model_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (5, 0), (5, 0), (9, None), (None, 1), (77, 1)], "doc_id long, quality int")
    w = quality_model.train(odd, labels, F.lit(True))
    got = odd.select("text", quality_model.score(F.col("text"), w).alias("s")).collect()
    assert all(0 <= r.s <= 1 for r in got) and len({r.s for r in got if not (r.text or "").strip()}) == 1
    none = quality_model.train(empty, labels, F.lit(True))
    assert not none.any() and empty.select(quality_model.score(F.col("text"), none)).count() == 0


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op4_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all() and got.accepted.mean() > 0.9


def test_language_on_odd_rows(odd, empty):
    model = language.train(odd, crc32_of_id() % 3 != 5)
    got = odd.select("text", language.predict(F.col("text"), model).alias("p")).collect()
    assert {r.p.lang_pred for r in got if not r.text or not any(c.isalpha() for c in r.text)} == {"und"}
    assert {r.p.lang_pred for r in got} <= {"und", "en", "de", "fr"}
    assert language.train(empty, F.lit(True)) is None
    assert odd.select(language.predict(F.col("text"), None).alias("p")).where("p.lang_pred <> 'und'").count() == 0


def test_subwords_are_the_grams_of_the_padded_text():
    import pyarrow as pa

    from dayweave.llm import text as T

    texts = ["ab", "", "x", "né e\n", "abab"]
    single = []
    for t in texts:
        (_, data, offs), = T.runs(pa.array([t.encode()]))
        single.append(language.subwords(data, offs)[0].tolist())
    (_, data, offs), = T.runs(pa.array([t.encode() for t in texts]))
    bucket, bounds = language.subwords(data, offs)
    threes = [bucket[a:b:2].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    assert threes == [s[::2] for s in single]
    assert [len(x) for x in threes] == [len(t.encode()) + 1 for t in texts]
