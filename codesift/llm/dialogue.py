"""Perspective rotation of multi-party dialogues.

For every participant of a conversation the dialogue is rendered once with
that speaker as the assistant and all others as named users; the loss mask is
set on the assistant's turns alone.  The result has one row per turn and
perspective with its place in the rendered dialogue, so no conversation is
ever gathered in one value; concatenating ``segment`` in the order of
``char_start`` gives the whole rendering.

Defined results: system turns are context, not a participant; a null speaker
is an unnamed user and no participant; a null text is empty; turns are ordered
by number (null first), then speaker and text, and repeated rows are repeated
turns; a conversation without participants has no perspective and so no rows;
rows without conv_id belong to no dialogue; template marks inside names and
texts are defused, names one to one (blanks become ``_``, ``_`` is escaped); an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import columns

SYSTEM = "system"
START, END = "<|im_start|>", "<|im_end|>\n"
# Turn numbers per block of the running offset.
BLOCK = 512


def defused(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("< |"))


# Characters of a speaker that a name cannot hold, and what stands for them.
NAME_MARKS = [("\\", "\\\\"), ("_", "\\_"), ("<|", "<\\|"), (" ", "_"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ("\x0b", "\\v"), ("\x0c", "\\f")]


def user_name(speaker: str) -> Column:
    """A name without white space or template marks; different speakers have
    different names."""
    out = F.col(speaker)
    for mark, name in NAME_MARKS:
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def rotate(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text",
           system: str = SYSTEM) -> DataFrame:
    """conv_id, perspective, turn, speaker, role, name, segment, char_start,
    char_end, loss_start, loss_end (null without loss), is_target."""
    t = columns(turns, conv_id=conv_id, turn=turn, speaker=speaker, text=text).filter("conv_id is not null")
    cast = t.filter(F.col("speaker").isNotNull() & (F.col("speaker") != system)) \
        .groupBy("conv_id", "speaker").agg(F.count(F.lit(1)).alias("own_turns")) \
        .select("conv_id", F.col("speaker").alias("perspective"))
    rows = t.join(cast, "conv_id")
    target = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    name = F.when(~target & F.col("speaker").isNotNull() & (F.col("speaker") != system),
                  user_name("speaker"))
    rows = rows.select("conv_id", "perspective", "turn", "speaker", target.alias("is_target"), name.alias("name"),
                       F.when(target, "assistant").when(F.col("speaker") == system, "system").otherwise("user").alias("role"),
                       defused(F.coalesce("text", F.lit(""))).alias("content"))
    head = F.concat(F.lit(START), "role", F.coalesce(F.concat(F.lit(" name="), "name"), F.lit("")), F.lit("\n"))
    rows = rows.withColumn("head", F.length(head)).withColumn("segment", F.concat(head, "content", F.lit(END))).drop("content") \
        .withColumn("size", F.length("segment").cast("long")).withColumn("block", F.floor(F.col("turn") / BLOCK))
    # running offsets: inside a block of turns, and of the blocks before it
    inside = Window.partitionBy("conv_id", "perspective", "block").orderBy("turn", "speaker", "segment") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "perspective", "block").agg(F.sum("size").alias("all")) \
        .withColumn("base", F.coalesce(F.sum("all").over(before), F.lit(0))).drop("all").alias("b")
    placed = rows.withColumn("upto", F.sum("size").over(inside)).alias("r").join(
        blocks, (F.col("r.conv_id") == F.col("b.conv_id")) & (F.col("r.perspective") == F.col("b.perspective"))
        & F.col("r.block").eqNullSafe(F.col("b.block"))).select("r.*", "b.base")
    start = F.col("base") + F.col("upto") - F.col("size")
    return placed.select(
        "conv_id", "perspective", "turn", "speaker", "role", "name", "segment",
        start.alias("char_start"), (F.col("base") + F.col("upto")).alias("char_end"),
        F.when(F.col("is_target"), start + F.col("head")).alias("loss_start"),
        F.when(F.col("is_target"), F.col("base") + F.col("upto")).alias("loss_end"), "is_target")
