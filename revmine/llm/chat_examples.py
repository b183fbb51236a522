"""Chat formatting: prefix-target expansion (DataFrame functions only).

A conversation is formatted as a stream of segments, one for each turn::

    <|role|>text<|end|>

``&``, ``<`` and ``>`` in roles and texts are written ``&amp;``, ``&lt;`` and
``&gt;``, so a control string never occurs inside a text and the text can be
restored exactly.

Every assistant turn becomes one example: all preceding turns are its context
and only its reply is trainable.  Each example is stored with its context
written out, its target segment and the loss span in it; the segments are also
stored once, in order, with their offsets in the stream.  The contexts of a
conversation grow with the square of its turns, and so does the output.  They
are cut from the conversation's stream where they are written: ``SHARE``
consecutive turns get one copy of the stream's beginning, so what is shuffled is
a small part of what is written, and a long conversation's examples are written
by many tasks.

Positions and offsets are summed in two steps, inside blocks of ``BLOCK`` turn
numbers and over the blocks, so no task orders a whole long conversation.

Defined results: null texts and roles are empty; turns are ordered by number,
null first, repeated numbers by role and text; rows with a null conversation id
form one conversation; repeated rows are turns of their own; a conversation
without an assistant turn has no examples; an empty table gives empty outputs.
Other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from revmine.llm.common import stored

BLOCK = 256
#: consecutive turns whose examples cut their contexts from one copy of the stream
SHARE = 64
TARGET_ROLE = "assistant"
_END = "<|end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&gt;"), F.lit(">")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def segment(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), escape(role), F.lit("|>"), escape(text), F.lit(_END))


def role_of(seg: Column) -> Column:
    return unescape(F.regexp_extract(seg, r"(?s)^<\|([^<>]*)\|>", 1))


def text_of(seg: Column) -> Column:
    return unescape(F.regexp_extract(seg, r"(?s)^<\|[^<>]*\|>([^<]*)<\|end\|>$", 1))


@dataclass(frozen=True)
class ChatOutput:
    """segments: (conv_id, position, begin, end, segment), offsets in code points of the stream;
    examples: (conv_id, example, context_turns, context_end, context, target, loss_begin, loss_end), the loss
    span in code points of the target, ``example`` the position of the target segment."""

    segments: DataFrame
    examples: DataFrame


def format_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> ChatOutput:
    """Format and store all conversations."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("conv_id", F.floor(F.col("turn") / BLOCK).alias("block"), "turn", "role", "text",
                       segment(F.col("role"), F.col("text")).alias("segment"))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.select("conv_id", "block", "role", "segment", F.row_number().over(inside).alias("nth"),
                       F.sum(F.length("segment").cast("long")).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    rows = stored(rows, "chat-turns")
    blocks = rows.groupBy("conv_id", "block").agg(F.max("nth").cast("long").alias("n"), F.max("upto").alias("chars"))
    before = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv_id").alias("_conv"), F.col("block").alias("_block"),
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("turns_before"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"))
    placed = rows.join(blocks, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("block").eqNullSafe(F.col("_block")))
    end = F.col("chars_before") + F.col("upto")
    placed = placed.select("conv_id", (F.col("turns_before") + F.col("nth") - 1).alias("position"), (end - F.length("segment")).alias("begin"),
                           end.alias("end"), "segment", (F.col("role") == TARGET_ROLE).alias("target"))
    placed = stored(placed, "chat-segments")
    head = F.length(escape(F.lit(TARGET_ROLE))) + 4
    examples = placed.where("target").select(
        "conv_id", F.col("position").alias("example"), F.col("position").alias("context_turns"), F.col("begin").alias("context_end"),
        F.col("segment").alias("target"), head.alias("loss_begin"), (F.length("segment") - len(_END)).alias("loss_end"))
    return ChatOutput(placed.drop("target"), stored(_with_contexts(examples, placed), "chat-examples", "zstd"))


def _with_contexts(examples: DataFrame, segments: DataFrame) -> DataFrame:
    """``examples`` with all text of the stream before the target."""
    rows = examples.withColumn("_share", F.floor(F.col("example") / SHARE))
    parts = F.array_sort(F.collect_list(F.struct("position", "segment")))
    streams = segments.groupBy(F.col("conv_id").alias("_of")).agg(F.array_join(F.transform(parts, lambda p: p["segment"]), "").alias("_stream"))
    needed = rows.groupBy(F.col("conv_id").alias("_conv"), F.col("_share").alias("_s")).agg(F.max("context_end").alias("_upto"))
    begins = needed.join(streams, F.col("_conv").eqNullSafe(F.col("_of"))).select("_conv", "_s", F.substring("_stream", F.lit(1), F.col("_upto").cast("int")).alias("_begin"))
    joined = rows.join(begins, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_share") == F.col("_s")))
    return joined.select("conv_id", "example", "context_turns", "context_end", F.substring("_begin", F.lit(1), F.col("context_end").cast("int")).alias("context"),
                         "target", "loss_begin", "loss_end")


def loss_text(examples: DataFrame) -> Column:
    """What the loss mask of an example covers, as the turn said it."""
    return unescape(F.substring(examples["target"], examples["loss_begin"] + 1, examples["loss_end"] - examples["loss_begin"]))


def expanded(out: ChatOutput, max_context_chars: int | None = None) -> DataFrame:
    """(conv_id, example, context, target, loss_begin, loss_end) of the stored examples.

    Every example has a row.  With ``max_context_chars`` a longer context is
    null, for a later step to cut or fetch.
    """
    fits = F.lit(True) if max_context_chars is None else F.col("context_end") <= max_context_chars
    return out.examples.select("conv_id", "example", F.when(fits, F.col("context")).alias("context"), "target", "loss_begin", "loss_end")


def digests(out: ChatOutput) -> DataFrame:
    """Per conversation, read back from the output.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
    example_chars): ``formatted_chars`` counts the stored stream,
    ``example_chars`` the examples as they are written out.  A digest is over all text of a
    conversation, which therefore meets in one row, without its neighbours.
    """
    def joined(order: str, value: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"]), "")

    seg = F.col("segment")
    said = F.concat(role_of(seg), F.lit("\n"), text_of(seg), F.lit("\n"))
    turns = out.segments.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), F.sha2(joined("position", said), 256).alias("turns_sha256"), F.max("end").alias("formatted_chars"))
    loss = out.examples.groupBy(F.col("conv_id").alias("_conv")).agg(
        joined("example", loss_text(out.examples)).alias("loss"), F.sum(F.length("context").cast("long") + F.length("target")).alias("example_chars"))
    loss = loss.select("_conv", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "example_chars")
    none = F.lit(0).cast("long")
    return turns.join(loss, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        "conv_id", "n_turns", "turns_sha256", F.coalesce("loss_chars", none).alias("loss_chars"),
        F.coalesce("loss_sha256", F.sha2(F.lit(""), 256)).alias("loss_sha256"), "formatted_chars", F.coalesce("example_chars", none).alias("example_chars"))
