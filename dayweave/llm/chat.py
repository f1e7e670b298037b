"""Multi-party perspective rotation of conversations. DataFrame and SQL functions only.

For every participant the dialogue is rendered with that speaker as the assistant and the others
as named users; the mask covers what the assistant says. A dialogue is rendered in parts of at most
TURNS turn numbers, so no conversation, however long, is collected whole: a part is a row, most
dialogues have one, and `start` places it in the whole rendering.

Cases: rows equal in all four columns count once; turns with equal numbers follow by role and text;
null turns come last, dealt by hash over parts of their own; a null role speaks as `unknown`; a null
text is empty; system turns are rendered unmasked and are no participant; a conversation of system
turns only has no perspective and gives no row; a null conversation id is a conversation; an empty
table gives no rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TURNS = 64
#: Parts over which turns without a number are dealt.
LOOSE = 1024
END = "<|end|>\n"


def rotate(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", per_part: int = TURNS) -> DataFrame:
    """conv_id, speaker, part, start, n_turns, text, masks (array of start and end in this part's text)."""
    number = F.col("turn")
    rows = (
        turns.select(F.struct(F.col(conv_id).alias("id")).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .groupBy("conv", "turn", "role", "text").agg(F.lit(0).alias("_"))
        .select("conv", F.struct(number.isNull().alias("loose"), F.when(number.isNull(), F.pmod(F.xxhash64("role", "text"), F.lit(LOOSE))).otherwise(F.floor(number / per_part)).alias("at")).alias("block"), F.struct("turn", "role", "text").alias("said"))
    )
    people = rows.where(F.col("said.role") != "system").groupBy("conv", F.col("said.role").alias("speaker")).agg(F.lit(0).alias("_")).drop("_")
    parts = rows.groupBy("conv", "block").agg(F.sort_array(F.collect_list("said")).alias("said"))
    seen = parts.join(people, "conv")
    mine = lambda s: s["role"] == F.col("speaker")
    head = lambda s: F.when(mine(s), F.lit("<|assistant|>\n")).when(s["role"] == "system", F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user|>\n"), s["role"], F.lit(": ")))
    segments = F.transform("said", lambda s: F.struct(mine(s).alias("own"), F.length(head(s)).alias("head"), F.concat(head(s), s["text"], F.lit(END)).alias("body")))

    def walk(acc, s):
        stop = acc["at"] + F.length(s["body"])
        span = F.array(F.struct((acc["at"] + s["head"]).cast("long").alias("start"), stop.cast("long").alias("end")))
        return F.struct(stop.cast("long").alias("at"), F.when(s["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    rendered = (
        seen.withColumn("segments", segments)
        .select("conv", "speaker", "block", F.size("segments").cast("long").alias("n_turns"), F.array_join(F.transform("segments", lambda s: s["body"]), "").alias("text"), F.aggregate("segments", F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), walk).alias("walked"))
    )
    # one row per part of a dialogue
    order = Window.partitionBy("conv", "speaker").orderBy("block")
    before = F.coalesce(F.sum("walked.at").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rendered.select(F.col("conv.id").alias("conv_id"), "speaker", (F.row_number().over(order) - 1).cast("long").alias("part"), before.cast("long").alias("start"), "n_turns", "text", F.col("walked.spans").alias("masks"))
