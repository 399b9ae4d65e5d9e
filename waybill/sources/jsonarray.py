"""JSON files that are one array each, read by many tasks.

The files are read as text that ends at every ``}``, so Spark splits them into blocks of bytes. Whether a brace counts depends on what stands
before it: a block may begin inside a string or deep inside an object. A first pass finds what a block does to that state
(quotes modulo 2; change of depth, begun inside and outside a string), which is one row per block; running sums over a file's blocks give the state
each block begins with. A second pass cuts the records out. Only the two pieces at the ends of a block leave its task, to be joined to their neighbours.

A ``}`` never follows a backslash in JSON, so no escape crosses from one piece of text to the next.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waybill.operators.writes import written
from waybill.session import fresh_dir

_ESCAPE = re.compile(r"\\.", re.DOTALL)
_BLOCK = ["file", "block"]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Text between closing braces with the file, the block it begins in and its place in the task's input."""
    return spark.read.text(path, lineSep="}").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value"
    )


def _effect(piece: str) -> tuple[int, int, int]:
    """Quotes modulo 2, and the change of depth up to and with the brace that ends the piece, begun outside and inside a string."""
    parts = _ESCAPE.sub("", piece).split('"')
    deltas = [sum(p.count("{") + p.count("[") - p.count("]") for p in parts[begin::2]) for begin in (0, 1)]
    flips = (len(parts) - 1) % 2
    deltas[flips] -= 1  # the brace counts where the piece ends outside a string
    return flips, deltas[0], deltas[1]


def _block_effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each block of the task; its pieces come in order and may span batches."""
    names = [*_BLOCK, "flips", "outside", "inside"]
    at, state = None, [0, 0, 0]
    for batch in batches:
        done = []
        for file, block, piece in zip(batch["file"], batch["block"], batch["value"], strict=True):
            if (file, block) != at:
                done += [(*at, *state)] if at else []
                at, state = (file, block), [0, 0, 0]
            flips, *deltas = _effect(piece)
            state = [state[0] ^ flips, state[1] + deltas[state[0]], state[2] + deltas[1 - state[0]]]
        yield pd.DataFrame(done, columns=names)
    if at:
        yield pd.DataFrame([(*at, *state)], columns=names)


def _block_starts(effects: DataFrame) -> DataFrame:
    """Whether each block begins inside a string, and at which depth."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begun = effects.withColumn("in_string", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2)
    change = F.when(F.col("in_string") == 1, F.col("inside")).otherwise(F.col("outside"))
    return begun.withColumn("change", change).select(*_BLOCK, "in_string", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("depth"))


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records of a block (part null), then its first piece, which ends a record if ``n`` is not 0, and what is left after its last record.

    ``n`` is the number of records that end in the block. Memory holds the block's first record and the current one.
    """
    names = [*_BLOCK, "part", "n", "record"]
    at, inside, depth, n, head, text = None, 0, 0, 0, None, []

    def ends() -> list[tuple]:
        if at is None:
            return []
        rest = "".join(text)
        return [(*at, 0, n, head), (*at, 1, 0, rest)] if n else [(*at, 0, 0, rest)]

    for batch in batches:
        out = []
        for file, block, piece, in_string, begun in zip(*(batch[c] for c in [*_BLOCK, "value", "in_string", "depth"]), strict=True):
            if (file, block) != at:
                out += ends()
                at, inside, depth, n, head, text = (file, block), int(in_string), int(begun), 0, None, []
            flips, *deltas = _effect(piece)
            inside, depth = inside ^ flips, depth + deltas[inside]
            text.append(piece + "}")
            if depth == 1 and not inside:
                record, text, n = "".join(text), [], n + 1
                if n == 1:
                    head = record
                else:
                    out.append((file, block, None, 0, record))
        yield pd.DataFrame(out, columns=names).astype({"part": "Int32"})
    yield pd.DataFrame(ends(), columns=names).astype({"part": "Int32"})


def _checked(ok: Column, value: Column, file: Column) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit("not one JSON array of objects: "), file)))


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """The objects of the arrays in the files under ``path``, one row each: file and record, as text.

    An empty file or array has no records. A file that is something else than one array of objects, or ends too early, is an error; only one more
    closing brace at its very end goes unnoticed. The records are written once to the shared folder. The table of blocks has a row for each split of the input; Spark broadcasts it only below its own
    threshold and otherwise sorts both sides, and the order of the pieces is restored after either.
    """
    pieces = _pieces(spark, path)
    effects = pieces.drop("place").mapInPandas(_block_effects, "file string, block long, flips int, outside long, inside long")
    starts = written(_block_starts(effects), fresh_dir(spark, "json-blocks"))
    placed = pieces.join(starts, _BLOCK, "left").withColumn(
        # the splits of both passes are the same as long as the session's settings and cores are
        "depth", F.when(F.col("depth").isNull(), F.raise_error(F.lit("the input was split anew between two passes; load again"))).otherwise(F.col("depth"))
    )
    schema = "file string, block long, part int, n long, record string"
    cut = written(placed.sortWithinPartitions(*_BLOCK, "place").mapInPandas(_cut, schema), fresh_dir(spark, "json-records"))

    before = Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    ends = cut.where(F.col("part").isNotNull()).withColumn("records", F.coalesce(F.sum("n").over(before), F.lit(0)))
    joined = ends.groupBy("file", "records").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part", "record"))), lambda x: x["record"]), "").alias("record"),
        (F.max("n") > 0).alias("whole"),
    )
    # the text that ends the file seems to end with a brace, too: it has been added above and is none of the file's
    rest = F.regexp_replace("record", r"\}$", "")
    last = F.when(F.col("records") > 0, rest.rlike(r"^\s*\]\s*$")).otherwise(rest.rlike(r"^\s*(\[\s*\]\s*)?$"))
    whole = joined.where(F.col("whole")).select("file", "record").unionByName(cut.where(F.col("part").isNull()).select("file", "record"))
    closed = joined.where(~F.col("whole")).select("file", _checked(last, F.lit(None).cast("string"), F.col("file")).alias("record"))
    begin = r"^[\s\uFEFF]*[\[,]\s*(?=\{)"
    objects = whole.select("file", _checked(F.col("record").rlike(begin), F.regexp_replace("record", begin, ""), F.col("file")).alias("record"))
    return objects.unionByName(closed).where(F.col("record").isNotNull())


def load_arrays(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed rows of the objects; one that does not fit the schema stops the load."""
    row = F.from_json("record", schema, {"mode": "FAILFAST"}).alias("row")
    return array_records(spark, path).select(row).select(*[F.col("row").getField(f.name).alias(f.name) for f in schema])
