"""Token ids in ORC files: ascending document ids, run-length encoded ids, row indexes, Bloom filters.

Rows are dealt by ranges of the document id before they are encoded, so a task writes one file of
neighbouring ids and no encoded row is shuffled. Spark's ORC writer gives integer run-length
encoding, stripes, row indexes and Bloom filters; readers split by stripe and skip stripes by the
document id. A file keeps the running token count of its own rows; the few totals of the files
give global positions.

Cases: a null text is empty (its end id only); a null id comes first; rows with equal ids keep
their order by text hash; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ids as I
from . import text as T

SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


def encode_rows(path: str, end: int, spaced: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, position = TaskContext.get().partitionId(), 0
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            for first, data, offs in T.runs(texts):
                ids, bounds = I.with_end(*I.encoder(path, spaced).run(data, offs), end)
                n = len(bounds) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids.slice(first, n),
                        pa.array(np.full(n, part, np.int32)),
                        pa.array(position + bounds[:-1]),
                        pa.array(np.diff(bounds)),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))),
                    ],
                    names=["doc_id", "part", "local_start", "n_tokens", "ids"],
                )
                position += int(bounds[-1])

    return rows


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end: int = 2, spaced: bool = False, doc_id: str = "doc_id", text: str = "text", stripe_mb: int = 32) -> None:
    """Encodes every text and writes ids in ascending order of the document id."""
    dealt = (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    dealt.mapInArrow(encode_rows(tokenizer, end, spaced), SCHEMA).write.options(
        **{"orc.compress": "ZSTD", "orc.stripe.size": str(stripe_mb << 20), "orc.row.index.stride": "1000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
    ).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids: start counts the ids of all documents before."""
    rows = spark.read.schema(SCHEMA).orc(path)
    # one row per file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # as many rows as files, which the driver lists anyway
    return rows.join(F.broadcast(totals), "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def find_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of a few documents; stripes and row groups without them are skipped by statistics and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def id_checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, start, n_tokens counted from the ids themselves, crc32 of the ids as little-endian 32-bit integers."""
    for batch in batches:
        lists = batch.column(2)
        offs = lists.offsets.to_numpy()
        values = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<u4")).cast("B")
        sums = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offs).astype(np.int64)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", "start", "ids").mapInArrow(id_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
