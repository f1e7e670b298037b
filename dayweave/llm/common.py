"""Shared helpers of the training-data operators: row keys and fixed hashes."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, scratch_path, ship  # noqa: F401

BATCH_BYTES = 16 << 20

#: Word characters of every contract: all but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def ready(spark: SparkSession) -> SparkSession:
    """A session whose Python workers have the package and get texts in batches of bounded size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return ship(spark)


def row_key(doc_id: str | Column = "doc_id", text: str | Column = "text") -> Column:
    """Identity of a row: its id and the hash of its text. A struct, so null ids compare equal."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.struct(doc_id.alias("id"), F.xxhash64(text).alias("h"))


def crc32_of_id(doc_id: str | Column = "doc_id") -> Column:
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary"))
