"""Registered queries of the training-data operators, with SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_names, chat, hard_negatives, language, line_rules, masked_lm, mixing, packing, quality_model, set_sketch, simhash, token_files, vector_codes
from .common import crc32_of_id, materialise, ready, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(ready(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query(
    "op1_line_frequency",
    """
    WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
    w AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
    p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8),
    g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM p),
    r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
    c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, range(8) t(k) GROUP BY doc_id),
    q AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
    u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM q WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
    l AS (
        SELECT doc_id, source, trim(unnest(string_split(regexp_replace(regexp_replace(lower(text), '[0-9]+', '0', 'g'), '[\\x20\\x09\\x0B-\\x0D]+', ' ', 'g'), chr(10)))) AS line FROM d
    ),
    f AS (SELECT source, line, count(DISTINCT doc_id) AS held FROM l WHERE line <> '' GROUP BY ALL),
    h AS (SELECT source, greatest(10, 0.05 * count(*)) AS most FROM d GROUP BY source),
    above AS (SELECT f.source, line FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source WHERE held > most),
    lost AS (
        SELECT doc_id, count(*) AS n_removed_lines, sum(len(string_split(l.line, ' '))) AS n_removed_words
        FROM l JOIN above a ON l.source IS NOT DISTINCT FROM a.source AND l.line = a.line GROUP BY doc_id
    ),
    base AS (
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
            length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
            coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
            coalesce(n_removed_lines, 0) AS n_removed_lines, CAST(coalesce(n_removed_words, 0) AS BIGINT) AS n_removed_words
        FROM d JOIN w USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN u USING (doc_id) LEFT JOIN lost USING (doc_id)
    ),
    v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_words - n_removed_words < 0.5 * n_words AS depleted FROM base)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT depleted AS kept, n_removed_lines, n_removed_words, depleted FROM v
    """,
)
def op1_line_frequency(spark, sf_dir):
    got = line_rules.line_frequency(documents(spark, sf_dir))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "n_removed_words", "depleted")


@query(
    "op2_block_names",
    """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
    n AS (SELECT doc_id, length(body) AS n_chars, sha256(regexp_replace(body, '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256 FROM d)
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
        doc_id = first_value(doc_id) OVER w AS kept, text_sha256
    FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id)
    """,
)
def op2_block_names(spark, sf_dir):
    return block_names.exact_groups(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op3_quality_ftrl")
def op3_quality_ftrl(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rest = crc32_of_id() % 5
    weights = quality_model.train(docs, labels, rest != 0)
    scored = docs.select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), quality_model.score(F.col("text"), weights).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query("op4_language")
def op4_language(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rest = crc32_of_id() % 3
    model = language.train(docs, rest != 1)
    return docs.select("doc_id", F.coalesce(rest == 1, F.lit(False)).alias("held_out"), language.predict(F.col("text"), model).alias("p")).select("doc_id", "held_out", "p.*")


@query("op5_masked_lm")
def op5_masked_lm(spark, sf_dir):
    docs = documents(spark, sf_dir)
    known = masked_lm.vocabulary(docs)
    model = masked_lm.train(docs, known)
    return docs.select("doc_id", masked_lm.score(F.col("text"), model, known).alias("s")).select("doc_id", "s.*")


@query("op6_orc_tokens")
def op6_orc_tokens(spark, sf_dir):
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(documents(spark, sf_dir), path, tokenizer("word_bpe_49k.json"))
    return token_files.checksums(token_files.read_token_files(spark, path))


@query(
    "op7_entropy_mixing",
    """
    WITH RECURSIVE s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
    t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s GROUP BY source),
    o AS (SELECT *, 2.0 * source_size / weight AS full_at, row_number() OVER (ORDER BY 2.0 * source_size / weight, source) AS j FROM t),
    cut AS (
        SELECT j, full_at, (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o
    ),
    lv AS (SELECT level FROM cut WHERE level <= full_at ORDER BY j LIMIT 1),
    g AS (SELECT source, source_size, least(2.0 * source_size, weight * level) AS target FROM t, lv),
    c AS (
        SELECT s.source, s.size, count(*) AS n, any_value(target / g.source_size) AS rate, row_number() OVER (PARTITION BY s.source ORDER BY s.size DESC) AS i
        FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source WHERE s.size > 0 GROUP BY s.source, s.size
    ),
    fold AS (
        SELECT source, 0 AS i, CAST(0 AS DOUBLE) AS carry, CAST(0 AS BIGINT) AS size, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS k FROM t
        UNION ALL
        SELECT f.source, CAST(c.i AS INTEGER), c.rate * c.n * c.size + f.carry - greatest(0, least(2 * c.n, floor((c.rate * c.n * c.size + f.carry) / c.size + 0.5))) * c.size,
            c.size, c.n, CAST(greatest(0, least(2 * c.n, floor((c.rate * c.n * c.size + f.carry) / c.size + 0.5))) AS BIGINT)
        FROM fold f JOIN c ON c.source IS NOT DISTINCT FROM f.source AND c.i = f.i + 1
    ),
    r AS (SELECT *, row_number() OVER (PARTITION BY source, size ORDER BY doc_id) AS place FROM s)
    SELECT r.doc_id, r.size, g.source_size, g.target,
        CASE WHEN r.size > 0 THEN f.k // f.n + CAST(r.place <= f.k % f.n AS BIGINT) ELSE CAST(floor(target / g.source_size + 0.5) AS BIGINT) END AS copies,
        CASE WHEN r.size > 0 THEN (f.k // f.n + CAST(r.place <= f.k % f.n AS BIGINT)) * r.size ELSE 0 END AS taken
    FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source LEFT JOIN fold f ON f.source IS NOT DISTINCT FROM r.source AND f.size = r.size AND f.i > 0
    """,
)
def op7_entropy_mixing(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query("op8_simhash_trees")
def op8_simhash_trees(spark, sf_dir):
    got = simhash.near_groups(documents(spark, sf_dir))
    return got.select("doc_id", F.lower(F.lpad(F.hex(F.element_at("bits", 1)), 16, "0")).alias("fingerprint"), "component_id")


@query(
    "op9_perspective_chat",
    """
    WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
    p AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
    s AS (
        SELECT conv_id, speaker, turn, role, text, floor(turn / 64) AS block,
            CASE WHEN role = speaker THEN '<|assistant|>' || chr(10) WHEN role = 'system' THEN '<|system|>' || chr(10) ELSE '<|user|>' || chr(10) || role || ': ' END AS head
        FROM t JOIN p USING (conv_id)
    ),
    b AS (SELECT *, head || text || '<|end|>' || chr(10) AS body FROM s),
    c AS (SELECT *, coalesce(sum(length(body)) OVER (PARTITION BY conv_id, speaker, block ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM b),
    g AS (
        SELECT conv_id, speaker, block, count(*) AS n_turns, string_agg(body, '' ORDER BY turn, role, text) AS text, sum(length(body)) AS chars,
            coalesce(string_agg(CAST(CAST(pos + length(head) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(pos + length(body) AS BIGINT) AS VARCHAR), ',' ORDER BY pos) FILTER (role = speaker), '') AS masks
        FROM c GROUP BY ALL
    )
    SELECT conv_id, speaker, row_number() OVER w - 1 AS part, CAST(coalesce(sum(chars) OVER (PARTITION BY conv_id, speaker ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, n_turns, text, masks
    FROM g WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY block)
    """,
)
def op9_perspective_chat(spark, sf_dir):
    got = chat.rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return got.withColumn("masks", F.array_join(F.transform("masks", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string"))), ","))


@query("op10_bm25_packing")
def op10_bm25_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


@query(
    "op11_coordinate_negatives",
    """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    ),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
    """,
)
def op11_coordinate_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(embeddings(spark, sf_dir), F.col("id") % 100 == 0, label=label)


@query(
    "op12_set_sketch",
    """
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    p AS (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0),
    g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM p),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
    met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    e AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
    r AS (SELECT doc_id AS d, doc_id AS c FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d WHERE r.c < e.b),
    m AS (SELECT d, min(c) AS c FROM r GROUP BY d)
    SELECT doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, doc_id = m.c AS kept FROM w LEFT JOIN n USING (doc_id) JOIN m ON m.d = doc_id
    """,
)
def op12_set_sketch(spark, sf_dir):
    return set_sketch.near_groups(documents(spark, sf_dir))


@query(
    "op13_anchor_trees",
    """
    WITH k AS (SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    parts AS (SELECT vec_id, p, q[4 * p + 1:4 * p + 4] AS v FROM k, range(16) t(p)),
    c0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM parts QUALIFY e < 64),
    a0 AS (SELECT vec_id, x.p, x.v, arg_min(e, (x.v[1] - c.v[1]) ** 2 + (x.v[2] - c.v[2]) ** 2 + (x.v[3] - c.v[3]) ** 2 + (x.v[4] - c.v[4]) ** 2 + e / 64.0) AS e FROM parts x JOIN c0 c USING (p) GROUP BY ALL),
    m0 AS (SELECT p, e, CAST(floor(sum(v[1]) / count(*)) AS BIGINT) AS x1, CAST(floor(sum(v[2]) / count(*)) AS BIGINT) AS x2, CAST(floor(sum(v[3]) / count(*)) AS BIGINT) AS x3, CAST(floor(sum(v[4]) / count(*)) AS BIGINT) AS x4 FROM a0 GROUP BY p, e),
    c1 AS (SELECT p, e, CASE WHEN x1 IS NULL THEN v ELSE [x1, x2, x3, x4] END AS v FROM c0 LEFT JOIN m0 USING (p, e)),
    a1 AS (SELECT vec_id, x.p, x.v, arg_min(e, (x.v[1] - c.v[1]) ** 2 + (x.v[2] - c.v[2]) ** 2 + (x.v[3] - c.v[3]) ** 2 + (x.v[4] - c.v[4]) ** 2 + e / 64.0) AS e FROM parts x JOIN c1 c USING (p) GROUP BY ALL),
    m1 AS (SELECT p, e, CAST(floor(sum(v[1]) / count(*)) AS BIGINT) AS x1, CAST(floor(sum(v[2]) / count(*)) AS BIGINT) AS x2, CAST(floor(sum(v[3]) / count(*)) AS BIGINT) AS x3, CAST(floor(sum(v[4]) / count(*)) AS BIGINT) AS x4 FROM a1 GROUP BY p, e),
    c2 AS (SELECT p, e, CASE WHEN x1 IS NULL THEN v ELSE [x1, x2, x3, x4] END AS v FROM c1 LEFT JOIN m1 USING (p, e)),
    f AS (SELECT vec_id, x.p, min((x.v[1] - c.v[1]) ** 2 + (x.v[2] - c.v[2]) ** 2 + (x.v[3] - c.v[3]) ** 2 + (x.v[4] - c.v[4]) ** 2 + e / 64.0) AS best FROM parts x JOIN c2 c USING (p) GROUP BY ALL),
    g AS (SELECT vec_id, string_agg(lower(lpad(to_hex(CAST((best - floor(best)) * 64 AS BIGINT)), 2, '0')), '' ORDER BY p) AS code, CAST(sum(floor(best)) AS BIGINT) AS error FROM f GROUP BY vec_id),
    h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c2)
    SELECT k.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN g USING (vec_id), h
    """,
)
def op13_anchor_trees(spark, sf_dir):
    coded, books = vector_codes.encode(embeddings(spark, sf_dir))
    got = vector_codes.with_label_error(materialise(coded, "codes"))
    return got.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))
