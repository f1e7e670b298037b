"""Corpus pipeline: quality rules, exact dedup, near-dedup, source mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. A stage works on all rows its predecessor kept. Repeated rows (equal id and text) are one
document from the dedup stage on; null texts and ids follow the rules of the operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from dayweave.llm import block_names, line_rules, mixing, packing, simhash
from dayweave.llm.common import materialise, ready, row_key
from dayweave.llm.queries import documents, tokenizer

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def _keyed(docs: DataFrame, text: str | Column = "text") -> DataFrame:
    """key and row: all columns of a document in one struct, so none of their names can clash."""
    return docs.select(row_key("doc_id", text).alias("key"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))


def _once(keyed: DataFrame) -> DataFrame:
    """One row of every key: that with the smallest hash, should repeated rows differ in further columns."""
    flat = [F.col("row").getField(f.name) for f in keyed.schema["row"].dataType if not isinstance(f.dataType, (MapType, VariantType))]
    return keyed.groupBy("key").agg(F.min_by("row", F.xxhash64(*flat)).alias("row"))


def _only(keyed: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows whose key is in kept, once each."""
    return _once(keyed.join(kept.select("key"), "key", "left_semi")).select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines above the limit of their host go; rejected documents go. Copies count as one document, as all but one go later."""
    judged = line_rules.line_frequency(docs, copies=False).where("kept")
    fresh = {"text": F.col("clean_text"), "n_chars": F.char_length("clean_text").cast("long")}
    return judged.select(*[fresh.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return _only(_keyed(docs, F.coalesce("text", F.lit(""))), block_names.exact_groups(docs).where("kept"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (similarity of their sets of five-word shingles of 0.8 or more) the smallest id stays.

    34 of 128 differing bits only nominate: a pair of similarity 0.8 differs in about 19, unrelated texts in 64.
    """
    near = simhash.near_groups(docs, shingle=5, reach=34, parts=2, minima=6, percent=80)
    groups = materialise(near.select("key", "root"), "near-groups")
    kept = groups.groupBy("root").agg(F.min_by("key", F.struct(F.col("key.id").isNull(), "key.id", "key.h")).alias("key"))
    return _only(_keyed(docs), kept)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's rate asks for."""
    plan = mixing.mix(docs).groupBy("key").agg(F.sum("copies").alias("copies")).where("copies > 0")
    taken = _once(_keyed(docs)).join(plan, "key")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def bm25_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


def _stage(fn):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return fn(ready(spark), docs, sf_dir)

    return run_stage


STAGES = [(fn.__name__, _stage(fn)) for fn in (quality_rules, exact_dedup, simhash_near_dedup, source_mixing, bm25_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
