"""Chat formatting with prefix-target expansion.

A conversation is rendered turn by turn into one stream of characters; every assistant turn becomes an example of its own whose context
is the stream before it and whose reply alone is trained on. An example is stored as spans of the stream, so the context that
examples share is written once: the output grows with the number of turns, also where one conversation holds a third of all
rows. ``example_texts`` writes the examples out in full.

The template is ``### Role: text </turn>`` and a line feed. In roles and texts a backslash goes before each ``\\``, ``#``, ``/``
and ``:`` of a control string, so that none of them can occur there, and ``unescape`` gives back exactly what was put in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waybill.llm.base import stored

#: The control strings.
OPEN, BETWEEN, CLOSE = "### ", ": ", " </turn>\n"
#: Characters of a text that help to choose its range.
NEAR = 64

_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)


def escaped(text: F.Column) -> F.Column:
    """Backslash before each backslash, # and /: neither ### nor </turn> is left in a text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([\\#/])", r"\\$1")


def escaped_role(role: F.Column) -> F.Column:
    """In a role the colon too, so that the first bare one ends it."""
    return F.regexp_replace(F.coalesce(role, F.lit("")), r"([\\#/:])", r"\\$1")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def parse_segment(segment: str) -> tuple[str, str]:
    """Role and text of a rendered turn."""
    inner = segment.removeprefix(OPEN).removesuffix(CLOSE)
    role = re.match(r"(?:\\.|[^\\:])*", inner, re.DOTALL)[0]
    return unescape(role), unescape(inner[len(role) + len(BETWEEN) :])


def _placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Places of turns among those of their conversation in this partition; rows come sorted, conversations may span batches."""
    conv, position, start, example = object(), 0, 0, 0
    for batch in batches:
        rows = []
        for key, chars, assistant in zip(batch["conv_id"], batch["chars"], batch["assistant"], strict=True):
            if key != conv:
                conv, position, start, example = key, 0, 0, 0
            rows.append((position, start, example if assistant else None))
            position, start, example = position + 1, start + chars, example + bool(assistant)
        where = pd.DataFrame(rows, columns=["position", "start", "example"], dtype=object)
        yield pd.concat([batch.drop(columns=["assistant"]).reset_index(drop=True), where], axis=1)


def _carried(pieces: DataFrame) -> DataFrame:
    """What turns in earlier ranges add to the places in a later range of the same conversation.

    Ranges follow each other in order, so only the first conversation of a range can have begun before it: a row per range at most.
    """
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = pieces.groupBy("conv_id", "part").agg(
        F.count(F.lit(1)).alias("position"), F.sum("chars").alias("start"), F.count("example").alias("example")
    )
    carried = sums.select("conv_id", "part", *[F.sum(c).over(before).alias(f"{c}_before") for c in ("position", "start", "example")])
    return carried.where(F.col("position_before").isNotNull())


def conversation_stream(turns: DataFrame) -> DataFrame:
    """The rendered turns: conv_id, position, role, segment, start, chars, example, loss_start and loss_end.

    ``start`` is the segment's place in its conversation's stream; ``example`` numbers the assistant turns from 0 and is null for
    others. The example's context is the stream up to ``start``, and its loss mask is the stream from loss_start to loss_end: the
    reply's text alone.

    turns: conv_id, turn, role, text; other columns play no part. Null texts and roles are empty, null turns come first, rows of one
    turn go by role and text, repeated rows are turns of their own, and rows without a conv_id are one conversation. An
    empty table gives no rows.

    Turns are sorted in ranges over the whole table, so a conversation with a third of the rows lies in a third of the ranges. Places are counted
    inside a range, and what earlier ranges add is at most a row per range. The first ``NEAR`` characters of a text help to choose the range, no
    more: rows alike in conversation, turn, role and those characters stay together and stream through one task.
    """
    text, role = escaped(F.col("text")), escaped_role(F.col("role"))
    head = F.concat(F.lit(OPEN), role, F.lit(BETWEEN))
    rendered = turns.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.concat(head, text, F.lit(CLOSE)).alias("segment"),
        F.length(head).alias("before"),
    )
    turn = F.col("turn").asc_nulls_first()
    ordered = (
        rendered.repartitionByRange("conv_id", turn, "role", F.substring("text", 1, NEAR))
        .sortWithinPartitions("conv_id", turn, "role", "text")
        .select(
            "conv_id", "role", "segment", F.length("segment").cast("long").alias("chars"), "before",
            (F.col("role") == "assistant").alias("assistant"),
        )
    )
    schema = "conv_id string, role string, segment string, chars long, before int, position long, start long, example long"
    pieces = stored(ordered.mapInPandas(_placed, schema).withColumn("part", F.spark_partition_id()), "chat-pieces")
    placed = pieces.join(F.broadcast(_carried(pieces)), ["conv_id", "part"], "left")
    for c in ("position", "start", "example"):
        placed = placed.withColumn(c, F.col(c) + F.coalesce(f"{c}_before", F.lit(0)))
    reply = F.col("example").isNotNull()
    return placed.select(
        F.when(F.col("conv_id") != "", F.col("conv_id")).cast("long").alias("conv_id"),
        "position",
        "role",
        "segment",
        "start",
        "chars",
        "example",
        F.when(reply, F.col("start") + F.col("before")).alias("loss_start"),
        F.when(reply, F.col("start") + F.col("chars") - len(CLOSE)).alias("loss_end"),
    )


def examples(stream: DataFrame) -> DataFrame:
    """One row for each assistant turn: conv_id, example, context_end, loss_start, loss_end and example_end in the stream.

    The example is the stream from 0 to example_end; its context ends at context_end.
    """
    return stream.where(F.col("example").isNotNull()).select(
        "conv_id",
        "example",
        F.col("start").alias("context_end"),
        "loss_start",
        "loss_end",
        (F.col("start") + F.col("chars")).alias("example_end"),
    )


def example_texts(stream: DataFrame) -> DataFrame:
    """conv_id, example and the example's whole text, for conversations short enough to be written out again for each reply."""
    ends = examples(stream).select(F.col("conv_id").alias("of"), F.col("example").alias("target"), "context_end")
    parts = stream.join(ends, stream["conv_id"].eqNullSafe(ends["of"]) & (stream["start"] <= ends["context_end"]))
    return parts.groupBy(F.col("of").alias("conv_id"), F.col("target").alias("example")).agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("position", "segment"))), lambda x: x["segment"]), ""
        ).alias("text")
    )


def digests(stream: DataFrame, expanded: DataFrame | None = None) -> DataFrame:
    """Read conversations back from their stream and their examples: a row for each conversation.

    conv_id, n_turns, turns_sha256 (of role, line feed, text, line feed for each turn), loss_chars, loss_sha256 and formatted_chars.
    ``expanded`` is what ``examples`` made of the stream. The text under an example's loss mask is cut out of the stream by the example's span,
    and its characters, context included, are those read from the stream up to its end; formatted_chars is the sum over the
    examples and of what follows the last one. An example that does not end with a turn, or a span that no turn holds, is an error.

    A digest takes the turns of a conversation in order, so these stream through one task; memory does not grow with them.
    """
    schema = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    conv, none = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv_id"), F.lit(None).cast("long")
    told = stream.select(conv, F.col("start").alias("at"), "segment", none.alias("begin"), none.alias("end"), none.alias("upto"))
    asked = (examples(stream) if expanded is None else expanded).select(
        conv, F.col("context_end").alias("at"), F.lit(None).cast("string"), "loss_start", "loss_end", "example_end"
    )
    # a turn, then the example whose target it is
    read = told.union(asked).repartition("conv_id").sortWithinPartitions("conv_id", "at", F.col("upto").asc_nulls_first())
    digested = read.mapInPandas(_digested, schema)
    return digested.withColumn("conv_id", F.when(F.col("conv_id") != "", F.col("conv_id")).cast("long"))


class _Reader:
    """A conversation as read so far."""

    def __init__(self, key: str):
        self.key, self.n_turns, self.turns = key, 0, sha256()
        self.loss, self.loss_chars = sha256(), 0
        self.seen, self.segment, self.formatted, self.last = 0, "", 0, 0

    def turn(self, segment: str) -> None:
        role, text = parse_segment(segment)
        self.turns.update(f"{role}\n{text}\n".encode())
        self.n_turns, self.seen, self.segment = self.n_turns + 1, self.seen + len(segment), segment

    def example(self, begin: int, end: int, upto: int) -> None:
        start = self.seen - len(self.segment)
        if upto != self.seen or not start <= begin <= end <= upto:
            raise ValueError(f"conversation {self.key}: an example ends at {upto}, the turn it answers with at {self.seen}")
        reply = unescape(self.segment[begin - start : end - start])
        self.loss.update(reply.encode())
        self.loss_chars, self.formatted, self.last = self.loss_chars + len(reply), self.formatted + self.seen, self.seen

    def closed(self) -> tuple:
        rest = self.seen - self.last
        return self.key, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted + rest


def _digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    reader = None
    for batch in batches:
        rows = []
        for key, segment, begin, end, upto in zip(*(batch[c] for c in ["conv_id", "segment", "begin", "end", "upto"]), strict=True):
            if reader is None or reader.key != key:
                rows += [reader.closed()] if reader else []
                reader = _Reader(key)
            if segment is not None:
                reader.turn(segment)
            else:
                reader.example(int(begin), int(end), int(upto))
        yield pd.DataFrame(rows, columns=names)
    if reader:
        yield pd.DataFrame([reader.closed()], columns=names)
