"""Multi-party perspective rotation of dialogues.

For every participant the whole dialogue is rendered once with that speaker as the assistant and all others as
named users, and with a mask of the spans that the assistant says. System turns are no participant and open every
perspective as what they are.

A dialogue is rendered in parts of at most `PART` turns each, by their place in the dialogue, so one of any length is spread over
tasks; parts of a perspective follow each other by `part`, and put together are the whole rendering.

What stands in a text or a name cannot pass for a mark: `<|` is written `<\\|` there (and `<\\` as `<\\\\`, so it can be undone), and `|>` in a name `|\\>`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import joined, ranked

PART = 256
ASSISTANT, END = "<|assistant|>\n", "<|end|>\n"
SYSTEM = "system"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\"), F.lit("<\\\\")), F.lit("<|"), F.lit("<\\|"))


def opening(speaker: Column, perspective: Column) -> Column:
    named = F.concat(F.lit("<|user:"), F.replace(escaped(speaker), F.lit("|>"), F.lit("|\\>")), F.lit("|>\n"))
    return F.when(speaker == perspective, F.lit(ASSISTANT)).when(speaker == SYSTEM, F.lit("<|system|>\n")).otherwise(named)


def rotate(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", part: int = PART) -> DataFrame:
    """conv_id, perspective, part, n_turns, n_own, text and mask (array of start, end) for each participant and part.

    Spans are code points into `text`, end exclusive, and cover what the assistant says with the end mark. Turns
    are ordered by number (null first), speaker and text, repeated rows are said again; part p holds those at the places from p * `part` on, whatever their
    numbers are. A null speaker is named "unknown", a null text is empty, rows without a dialogue's id are one dialogue. A dialogue of
    system turns alone has no participant and no row, an empty table an empty result. Other columns are not read.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("")).alias("key")
    speaker = F.coalesce(F.col(speaker_col).cast("string"), F.lit("unknown")).alias("speaker")
    said = df.select(key, F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), speaker, F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("salt"))
    told, _ = ranked(said, F.col("key"), F.col("turn"), F.col("speaker"), F.col("text"), F.col("salt"))
    begins = told.groupBy("key").agg(F.min("rank").alias("begin"), F.count(F.lit(1)).alias("n"))
    told = joined(told.drop("turn", "salt"), begins, "key", told.count(), common.FEW // 10).withColumn("part", F.expr(f"(rank - begin) div {part}"))
    speakers = told.filter(F.col("speaker") != SYSTEM).groupBy("key", F.col("speaker").alias("perspective")).agg(F.first("conv").alias("conv"))
    parts = told.groupBy("key", "part").agg(F.sort_array(F.collect_list(F.struct("rank", "speaker", "text"))).alias("turns"))
    each = parts.join(speakers, "key")
    who = F.col("perspective")
    pieces = F.transform("turns", lambda t: F.struct(F.concat(opening(t["speaker"], who), escaped(t["text"]), F.lit(END)).alias("piece"), (t["speaker"] == who).alias("own")))
    each = each.withColumn("pieces", pieces)
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, end: bigint>>").alias("spans"))

    def step(state: Column, p: Column) -> Column:
        after = state["at"] + F.length(p["piece"])
        span = F.array(F.struct((state["at"] + len(ASSISTANT)).alias("start"), after.alias("end")))
        return F.struct(after.alias("at"), F.when(p["own"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return each.select(
        F.col("conv").alias(conv_col),
        "perspective",
        "part",
        F.size("pieces").alias("n_turns"),
        F.size(F.filter("pieces", lambda p: p["own"])).alias("n_own"),
        F.array_join("pieces.piece", "").alias("text"),
        F.aggregate("pieces", empty, step)["spans"].alias("mask"),
    )
