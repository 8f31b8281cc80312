r"""Chat formatting by prefix-target expansion: every assistant turn is an example of its own.

A turn is written as ``<|role|>text<|end|>``. Inside roles and texts a backslash becomes ``\\`` and a
bar ``\p``, so no control string can appear there and reading back is exact.

An example is all turns before an assistant turn as context, and that turn, of which only the text
is trainable. Its text is a prefix of the conversation as written, so examples refer to it:
``expanded`` puts the example behind each assistant turn of ``render``, with the ends of context, loss
and example as offsets, and is at most twice as large as the input; ``examples`` has these rows alone. ``example_texts`` writes every prefix out, which grows with the square of a
conversation's turns; it is for writers of files.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>", "<|end|>"
_TURN = re.compile(r"<\|([^|]*)\|>([^|]*)<\|end\|>")
_ESCAPED = re.compile(r"\\(.)")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\p"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "|" if m[1] == "p" else m[1], text) if "\\" in text else text


def read_turn(piece: str) -> tuple[str, str]:
    """Role and text of a written turn."""
    found = _TURN.fullmatch(piece)
    if not found:
        raise ValueError("not a turn of this template")
    return unescape(found[1]), unescape(found[2])


def render(conversations: DataFrame) -> DataFrame:
    """``conv_id, position, start, piece, is_target, loss_start, loss_end``, a row for each turn.

    ``position`` counts from 1 in the order of turn, role and text (nulls first), so ties and repeated
    rows keep a place each. ``piece`` is the turn as written and ``start`` its offset in the
    conversation; ``loss_start`` and ``loss_end`` bound the trainable text of an assistant turn (null
    for others). Offsets are in code points. Null roles and texts count as empty; null ``conv_id`` is a
    conversation of its own. Other columns are ignored. Turns of a conversation are in one partition,
    in order; they stream through a window and are never collected.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")
    ).repartition("conv_id")
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(CLOSE))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    written = rows.select(
        "*",
        F.length(head).alias("head_chars"),
        F.length(escaped(F.col("text"))).alias("text_chars"),
        F.concat(head, escaped(F.col("text")), F.lit(END)).alias("piece"),
    )
    placed = written.select(
        "conv_id",
        F.row_number().over(order).cast("long").alias("position"),
        F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).cast("long").alias("start"),
        "piece",
        (F.col("role") == "assistant").alias("is_target"),
        "head_chars",
        "text_chars",
    )
    loss_start = F.when(F.col("is_target"), F.col("start") + F.col("head_chars"))
    return placed.select(
        "conv_id", "position", "start", "piece", "is_target", loss_start.alias("loss_start"),
        (loss_start + F.col("text_chars")).alias("loss_end"),
    )


def expanded(turns: DataFrame) -> DataFrame:
    """Every turn, and after each assistant turn its example: the columns of ``turns``, with
    ``context_end`` and ``example_end``, which are null in rows that are turns.

    The context of an example is the conversation as written up to ``context_end``, all turns before it;
    its ``piece`` is the reply, and only ``loss_start`` to ``loss_end`` of it is trainable. Rows of one
    conversation stay in the order and the task that they have in ``turns``, so a reader streams the
    context once for all its examples.
    """
    both = F.when(F.col("is_target"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    rows = turns.withColumn("_example", F.explode(both))
    return rows.withColumns(
        {
            "context_end": F.when(F.col("_example"), F.col("start")),
            "example_end": F.when(F.col("_example"), F.col("start") + F.length("piece")),
        }
    ).drop("_example")


def examples(turns: DataFrame) -> DataFrame:
    """``conv_id, position, context_end, loss_start, loss_end, example_end``: a row for each assistant
    turn. The example is the conversation as written up to ``example_end``."""
    return expanded(turns).filter("context_end IS NOT NULL").select(
        "conv_id", "position", "context_end", "loss_start", "loss_end", "example_end"
    )


def example_texts(turns: DataFrame) -> DataFrame:
    """``conv_id, position, text, loss_start, loss_end``: the examples written out."""
    whole = Window.partitionBy("conv_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    text = F.array_join(F.collect_list("piece").over(whole), "")
    return turns.withColumn("text", text).filter("is_target").select("conv_id", "position", "text", "loss_start", "loss_end")
