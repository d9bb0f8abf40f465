"""Chat formatting with perspective rotation, in DataFrame functions only.

For every participant of a dialogue (every speaker but the ``narrators``) the dialogue is rendered once: this
speaker is the assistant, the others are users with their names, narrators stay system turns. The loss
mask is the list of code point ranges of the assistant's words (with the end mark, without the header).

A rendering comes in chunks of at most ``chunk_turns`` turns, numbered from 0, so no row holds an unbounded
dialogue. A turn's place in its dialogue comes from two steps: counts of (dialogue, ``turn`` div ``chunk_turns``) are
summed up over the dialogue, and rows are numbered inside each such block; so a dialogue with a third of
all turns is spread over its blocks. Participants are a distinct over (dialogue, speaker), reduced before the
shuffle. A participant without a turn in a chunk still gets this chunk (with an empty mask), as context.

Cases: null speakers are named ``unknown``, null texts are empty, turns without number come first; equal turns
are ordered by speaker and text, and repeated rows are repeated turns; rows of a null dialogue id are one
dialogue; dialogues of narrators only give no rows; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK_TURNS = 64
NARRATORS = ("system",)
HEAD, TAIL = "<|start|>", "<|end|>\n"


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", narrators: tuple[str, ...] = NARRATORS, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """(conv, perspective, chunk, n_turns, n_own, rendered, mask): mask is "start:end,..." in code points."""
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.coalesce(F.col(turn_col).cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("unknown")).alias("name"),
        F.coalesce(F.col(text_col), F.lit("")).alias("said"),
    ).withColumn("block", F.expr(f"turn div {chunk_turns}"))
    blocks = rows.groupBy("conv", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(F.col("conv").alias("c"), F.col("block").alias("b"), F.coalesce(before, F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("conv", "block").orderBy("turn", "name", "said"))
    rows = rows.withColumn("k", place).join(blocks, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    rows = rows.withColumn("at", F.col("base") + F.col("k") - 1).withColumn("chunk", F.expr(f"at div {chunk_turns}"))
    chunks = rows.groupBy("conv", "chunk").agg(F.sort_array(F.collect_list(F.struct("at", "name", "said"))).alias("turns"))
    people = rows.filter(~F.col("name").isin(*narrators)).select(F.col("conv").alias("c"), F.col("name").alias("perspective")).distinct()
    both = chunks.join(people, F.col("conv").eqNullSafe(F.col("c")))
    own = lambda t: t["name"] == F.col("perspective")
    head = lambda t: F.concat(
        F.lit(HEAD),
        F.when(own(t), F.lit("assistant")).when(t["name"].isin(*narrators), t["name"]).otherwise(F.concat(F.lit("user name="), t["name"])),
        F.lit("\n"),
    )
    parts = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["said"], F.lit(TAIL)).alias("body"), own(t).alias("own")))
    both = both.select("conv", "perspective", "chunk", parts.alias("parts"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("mask"))

    def step(acc, p):
        begin = acc["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        span = F.concat(begin.cast("string"), F.lit(":"), (end - 1).cast("string"))  # the line break after the mark is not learned
        return F.struct(end.alias("at"), F.when(p["own"], F.concat(acc["mask"], F.array(span))).otherwise(acc["mask"]).alias("mask"))

    return both.select(
        F.col("conv").alias(conv_col),
        "perspective",
        F.col("chunk").cast("long").alias("chunk"),
        F.size("parts").cast("long").alias("n_turns"),
        F.size(F.filter("parts", lambda p: p["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), "").alias("rendered"),
        F.array_join(F.aggregate("parts", start, step, lambda acc: acc["mask"]), ",").alias("mask"),
    )


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dialogue of ``conversations``."""
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
