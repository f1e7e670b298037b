"""Quality rules: word, symbol and repetition counts, and cross-document line frequency per host.

Lines are normalised (lower case, digit runs to 0, white space collapsed), hashed, and
counted over distinct documents of a host with partial aggregation, so a line that a third
of all documents share costs one row per map task. Lines above the limit of their host are
removed; a document that loses too many of its words is rejected as depleted.

Cases: a null text counts as empty (no words, base_failed); a null host is a host of its own;
empty lines never count; rows with equal id and text are one document for the counts and each
keep their output row; an empty table gives an empty result; further columns of the input are
carried in the struct `row`, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import materialise, row_key

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 8

_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def text_counts(column: pa.Array) -> pa.Array:
    """The five base counts of every text of a binary column."""
    n = len(column)
    out = {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    for first, data, offs in T.runs(column):
        rows = slice(first, first + len(offs) - 1)
        size = len(offs) - 1
        starts, ends, row = T.words(data, offs)
        out["n_words"][rows] = np.bincount(row, minlength=size)
        out["word_chars"][rows] = T.per_row(((data & 0xC0) != 0x80) & ~T.SPACE[data], offs)
        out["n_symbols"][rows] = T.per_row(SYMBOLS[data], offs)
        begin, end, line_row = T.lines(data, offs)
        if len(begin):
            keys = T.mix(T.hashes(data, begin, end) ^ line_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            _, kept = np.unique(keys, return_index=True)
            out["n_dup_lines"][rows] = np.bincount(line_row, minlength=size) - np.bincount(line_row[kept], minlength=size)
        if len(starts) >= WINDOW:
            h = T.hashes(data, starts, ends)
            step = np.uint64(0xC2B2AE3D27D4EB4F)
            for reach in (1, 2, 4):
                h = T.mix(h[:-reach] * step + h[reach:])
            whole = np.flatnonzero(row[WINDOW - 1 :] == row[: len(h)])
            twice = whole[T.repeats(h[whole] ^ T.mix(row[whole].astype(np.uint64) + np.uint64(1)))]
            if len(twice):
                cover = np.zeros(len(starts) + 1, np.int32)
                np.add.at(cover, twice, 1)
                np.add.at(cover, twice + WINDOW, -1)
                out["n_repeat_words"][rows] = np.bincount(row[np.cumsum(cover[:-1]) > 0], minlength=size)
    return pa.StructArray.from_arrays([pa.array(v) for v in out.values()], names=list(out))


def base_counts(text: Column) -> Column:
    # the function is made here, as a session must exist first; nondeterministic only in name, so that a
    # filter on the counts does not compute them a second time
    return F.arrow_udf(text_counts, _STATS).asNondeterministic()(text.cast("binary"))


def normalised_lines(text: Column) -> Column:
    """Lines of the text in the form that is hashed; blank lines become empty strings."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "0"), "[\\x20\\x09\\x0B-\\x0D]+", " ")
    return F.transform(F.split(plain, "\n"), lambda x: F.trim(x))


def line_frequency(
    docs: DataFrame,
    host: str = "source",
    min_docs: int = 10,
    max_share: float = 0.05,
    min_left: float = 0.5,
    doc_id: str = "doc_id",
    text: str = "text",
    copies: bool = True,
) -> DataFrame:
    """Base counts, removed lines and verdict of every document.

    A line is above the limit of its host if more than max(min_docs, max_share x documents of
    the host) documents of that host hold it. copies=False: documents of a host that are equal but
    for white space count as one, for a line and for the host. Result: row (all input columns), doc_id, the base
    counts, base_failed, n_removed_lines, n_removed_words, depleted, kept, clean_text.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.struct(F.col(host)).alias("host"), row_key(doc_id, text).alias("key"))
    if not copies:
        rows = rows.withColumn("body", F.xxhash64(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", "")))
    own = [] if copies else ["body"]
    marked = F.transform(normalised_lines(F.col("text")), lambda x: F.struct(F.xxhash64(x).alias("line"), F.when(x == "", 0).otherwise(F.size(F.split(x, " "))).alias("w")))
    # a few numbers per line, read by the count and by the look-up below
    lines = materialise(
        rows.select("key", "host", *own, F.explode(marked).alias("l"))
        .where("l.w > 0")
        .groupBy("key", "host", *own, "l.line")
        .agg(F.sum("l.w").alias("w"), F.count(F.lit(1)).alias("n")),
        "lines",
    )
    hosts = (rows if copies else rows.select("host", "body").distinct()).groupBy("host").agg(F.greatest(F.lit(float(min_docs)), F.count(F.lit(1)) * max_share).alias("limit"))
    above = (
        (lines if copies else lines.select("host", "line", "body").distinct()).groupBy("host", "line").agg(F.count(F.lit(1)).alias("held"))
        .where(F.col("held") > min_docs)
        .join(hosts, "host")
        .where("held > limit")
        .select("host", "line")
    )
    lost = (
        lines.join(above, ["host", "line"])
        .groupBy("key")
        .agg(F.sum("w").alias("lost_words"), F.sum("n").alias("lost_lines"), F.collect_set("line").alias("lost"))
    )
    counted = rows.drop(*own).withColumn("c", base_counts(F.col("text")))
    joined = counted.join(lost, "key", "left")
    removed = F.coalesce("lost_words", F.lit(0)).cast("long")
    failed = (F.col("c.n_words") < 20) | (100 * F.col("c.n_repeat_words") > 30 * F.col("c.n_words"))
    depleted = F.col("c.n_words") - removed < min_left * F.col("c.n_words")
    pairs = F.arrays_zip(F.split("text", "\n").alias("raw"), normalised_lines(F.col("text")).alias("norm"))
    stay = F.transform(F.filter(pairs, lambda p: (p["norm"] == "") | ~F.array_contains("lost", F.xxhash64(p["norm"]))), lambda p: p["raw"])
    return joined.select(
        "row",
        "doc_id",
        "c.*",
        failed.alias("base_failed"),
        F.coalesce("lost_lines", F.lit(0)).cast("long").alias("n_removed_lines"),
        removed.alias("n_removed_words"),
        depleted.alias("depleted"),
        (~failed & ~depleted).alias("kept"),
        F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n")).alias("clean_text"),
    )
