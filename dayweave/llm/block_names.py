"""Exact dedup by deterministic block naming.

The normalised text is cut into blocks of a fixed number of bytes. Distinct blocks are sorted
and numbered; every document becomes a row of block names. Adjacent names are then paired and
distinct pairs are sorted and numbered, level by level, until one name per document is left.
Equal (number of blocks, last name) holds exactly if the texts are equal: names are given to
blocks and pairs themselves, never to hashes.

A 64-bit hash only routes a block to its name. Where one hash has several blocks, which is
looked up in the finished name table, those blocks are joined by their bytes.

Block bytes are shuffled once, after partial aggregation, so a block shared by a third of the
documents costs one row per map task; all later rows are a few integers. Levels are written to
the shared folder, which cuts lineage.

Cases: null text counts as empty; empty texts form one group; a text of any length is cut into
blocks; rows with equal id and text are one document (one output row); a null id is an id like
any other and loses ties; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

BLOCK = 4096
#: White space that normalisation deletes.
BLANKS = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def _numbered(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys with an integer name: the place in the sorted rows of a partition."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def block_names(docs: DataFrame, block: int = BLOCK, route=F.xxhash64) -> DataFrame:
    """(key, pos, n, name): the name of every block of every document key, n blocks in all.

    docs: key, norm. route: hash that leads a block to its name.
    """
    raw = F.col("norm").cast("binary")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("norm") / block)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(i.alias("pos"), F.substring(F.col("raw"), i * block + 1, F.lit(block)).alias("block")))
    pieces = docs.select("key", raw.alias("raw"), n.alias("n")).select("key", "n", F.explode(cut).alias("b")).select("key", "n", "b.pos", "b.block", route("b.block").alias("h"))
    names = materialise(_numbered(pieces.groupBy("h", "block").agg(F.lit(0).alias("_")).select("h", "block"), ["h", "block"]), "blocks")
    by_hash = names.groupBy("h").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("blocks"))
    narrow = pieces.select("key", "n", "pos", "h").join(by_hash, "h")
    alone = materialise(narrow.select("key", "n", "pos", "name", "blocks"), "named")
    shared = by_hash.where("blocks > 1").select("h")
    if shared.isEmpty():
        return alone.drop("blocks")
    exact = pieces.join(shared, "h", "left_semi").join(names, ["h", "block"]).select("key", "n", "pos", "name")
    return materialise(alone.where("blocks = 1").drop("blocks").unionByName(exact), "named-exact")


def name_documents(names: DataFrame) -> DataFrame:
    """(key, n, name): pairs adjacent names until one is left per document."""
    done = names.where("n = 1").select("key", "n", "name")
    level = names.where("n > 1")
    width = level.agg(F.max("n")).first()[0] or 1
    while width > 1:
        pairs = materialise(
            level.groupBy("key", "n", F.shiftright("pos", 1).alias("pos")).agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
            ),
            "pairs",
        )
        numbered = materialise(_numbered(pairs.groupBy("a", "b").agg(F.lit(0).alias("_")).select("a", "b"), ["a", "b"]), "pair-names")
        level = pairs.join(numbered, ["a", "b"]).select("key", "n", "pos", "name")
        width = (width + 1) // 2
    # a name of the last level stands for a whole text; n keeps texts of other lengths apart
    return done.unionByName(level.select("key", "n", "name"))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, route=F.xxhash64) -> DataFrame:
    """One row per document: doc_id, key, keep_id, group_size, kept, text_sha256, n_chars.

    Of equal texts the one with most code points before normalisation stays, then the smallest id.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct(F.col(doc_id).alias("id"), F.xxhash64(body).alias("h")).alias("key"), body.alias("body")).withColumn("norm", normalised(F.col("body")))
    identity = name_documents(block_names(rows.select("key", "norm"), block, route))
    facts = rows.select("key", F.char_length("body").cast("long").alias("n_chars"), F.sha2("norm", 256).alias("text_sha256"))
    named = materialise(facts.join(identity, "key").dropDuplicates(["key"]), "identity")
    best = F.struct(F.col("n_chars"), F.col("key.id").isNotNull(), -F.col("key.id"), F.col("key.h"))
    # written, so that the join below has two plain shuffles and a group of many copies can be split
    groups = materialise(named.groupBy("n", "name").agg(F.max_by("key", best).alias("keep"), F.count(F.lit(1)).alias("group_size")), "groups")
    return named.join(groups, ["n", "name"]).select(
        F.col("key.id").alias("doc_id"),
        "key",
        F.col("keep.id").alias("keep_id"),
        "group_size",
        (F.col("key") == F.col("keep")).alias("kept"),
        "text_sha256",
        "n_chars",
    )
