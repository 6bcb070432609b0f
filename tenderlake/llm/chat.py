"""Chat formatting by perspective: every participant of a dialogue becomes the assistant once, in DataFrame functions only.

For a participant, their turns are rendered as the assistant's, other speakers as named users, system turns as system;
the mask covers what the assistant is to learn: the text of its turns with the end mark. A dialogue comes in blocks of at
most ``block`` turns, in order, so that no task gathers a dialogue of any length; the blocks' texts one after the other
are the whole rendering and ``char_offset`` says where a block starts in it. Masks are start:end pairs of code points in the block.

Marks of the format within texts and names are broken up by a backslash, and line ends in names become blanks, so that no
text can open another's turn. A speaker of the system's name is the system and no participant.

Edge cases: null text counts as empty, a null speaker is named "unknown", null turns come first; turns with equal numbers
are ordered by speaker and text, repeated rows are all rendered; a dialogue of system turns alone has no participant and
gives no row; null dialogue ids form one dialogue; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, written

BLOCK = 64
START, STOP = "<|im_start|>", "<|im_end|>\n"


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit("<|im_"), F.lit("<\\|im_"))


def numbered(turns: DataFrame, conv: str, turn: str, speaker: str, text: str) -> DataFrame:
    """A table of conv, speaker, text, n_chars of it, n: the place of each turn in its dialogue from 0. Rows are sorted over
    ranges that may cut a dialogue anywhere, and counted by range, so that a long dialogue is spread over tasks."""
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(speaker), F.lit("unknown")).alias("speaker"), _plain(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    order = ["conv", "turn", "speaker", "text"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(rows.select("conv", "speaker", "text", F.length("text").alias("n_chars"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos")), "turns")
    sizes = rows.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("size"), F.min("pos").alias("first"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("conv").alias("c"), F.col("part").alias("p"), (before - F.col("first")).alias("shift"))
    joined = rows.join(written(sizes, "sizes"), rows["conv"].eqNullSafe(F.col("c")) & (rows["part"] == F.col("p")))
    return joined.select("conv", "speaker", "text", "n_chars", (F.col("pos") + F.col("shift")).alias("n"))


def perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", system: str = "system", block: int = BLOCK) -> DataFrame:
    """conv, perspective, block_no, n_turns, char_offset, rendered, mask."""
    rows = numbered(turns, conv, turn, speaker, text)
    # A table by itself, so that its join with a long dialogue can be split.
    people = written(rows.where(F.col("speaker") != system).select(F.col("conv").alias("c"), F.col("speaker").alias("perspective")).distinct(), "people")
    own = F.col("speaker") == F.col("perspective")
    head = F.concat(F.lit(START), F.when(own, "assistant").when(F.col("speaker") == system, "system").otherwise(F.concat(F.lit("user name="), F.translate(_plain(F.col("speaker")), "\n\r", "  "))), F.lit("\n"))
    block_no = F.floor(F.col("n") / block).cast("long").alias("block_no")
    each = rows.join(people, rows["conv"].eqNullSafe(people["c"])).select("conv", "perspective", block_no, "n", "text", "n_chars", head.alias("head"), own.alias("own"))

    # Where blocks start is told from lengths alone; no task gets the texts of a dialogue.
    sizes = each.groupBy("conv", "perspective", "block_no").agg(F.sum(F.length("head") + F.col("n_chars") + len(STOP)).alias("chars"))
    earlier = Window.partitionBy("conv", "perspective").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("conv").alias("c"), F.col("perspective").alias("p"), F.col("block_no").alias("b"), F.coalesce(F.sum("chars").over(earlier), F.lit(0)).cast("long").alias("char_offset"))

    # In a block: turns in order, and with each the code points up to its end.
    turn_ = F.struct("n", F.concat("head", "text", F.lit(STOP)).alias("s"), (F.length("head") + F.col("n_chars") + len(STOP)).alias("size"), (F.col("n_chars") + len(STOP)).alias("body"), "own")
    blocks = each.groupBy("conv", "perspective", "block_no").agg(F.count(F.lit(1)).alias("n_turns"), F.array_sort(F.collect_list(turn_)).alias("all"))
    stop = lambda i: F.aggregate(F.slice("all", 1, i + 1), F.lit(0), lambda total, x: total + x["size"])
    span = F.transform("all", lambda x, i: F.when(x["own"], let(stop(i), lambda at: F.concat_ws(":", (at - x["body"]).cast("string"), at.cast("string")))))
    placed = blocks.join(starts, blocks["conv"].eqNullSafe(starts["c"]) & (blocks["perspective"] == starts["p"]) & (blocks["block_no"] == starts["b"]))
    return placed.select(F.col("conv").alias(conv), "perspective", "block_no", "n_turns", "char_offset", F.array_join(F.transform("all", lambda x: x["s"]), "").alias("rendered"), F.array_join(span, ",").alias("mask"))
