"""Masking inside JSON documents of any depth.

A document is read as a variant and walked level by level in one nested expression: the entries of an object, or the items of an array,
are listed, their keys masked, their values walked one level down, and the level put together again. The values of the text that comes out are
redacted piece by piece. Nothing is shuffled and no Python runs. How many levels the expression needs is measured first, by an aggregate
that returns one number; documents with fewer levels end at their leaves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.functions.privacy import masked_keys, redact

_VARIANTS, _FIELDS = "array<variant>", "map<string,variant>"
_TEXT = r'"(?:[^"\\]|\\.)*"?'


def nesting(document: Column) -> Column:
    """Levels of objects and arrays in a JSON text: 0 for a scalar. Brackets inside texts do not count."""
    brackets = F.regexp_replace(F.regexp_replace(document, _TEXT, ""), r"[^\[\]{}]+", "")
    steps = F.transform(F.split(brackets, ""), lambda b: F.when(b.isin("[", "{"), 1).when(b.isin("]", "}"), -1).otherwise(0))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("top"))
    deepest = F.aggregate(steps, start, lambda s, b: F.struct((s["at"] + b).alias("at"), F.greatest(s["top"], s["at"] + b).alias("top")))
    return deepest["top"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it; keeps nested expressions from doubling at each level."""
    return F.transform(F.array(value), body)[0]


def walked(value: Column, levels: int, keys: Callable[[Column], Column]) -> Column:
    """A variant with ``keys`` applied to the entries (key, value) of each object, ``levels`` objects or arrays deep."""
    if levels == 0:
        return value

    def level(at: Column) -> Column:
        listed = F.transform(at["items"], lambda v: F.struct(F.lit(None).cast("string").alias("key"), v.alias("value")))
        entries = F.coalesce(keys(F.map_entries(at["fields"])), listed)
        below = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), walked(e["value"], levels - 1, keys).alias("value")))

        def put_together(done: Column) -> Column:
            as_object = F.to_variant_object(F.map_from_entries(done))
            as_array = F.to_variant_object(F.transform(done, lambda e: e["value"]))
            return F.when(at["fields"].isNotNull(), as_object).when(at["items"].isNotNull(), as_array).otherwise(value)

        return _let(below, put_together)

    return _let(F.struct(value.try_cast(_FIELDS).alias("fields"), value.try_cast(_VARIANTS).alias("items")), level)


def redacted_values(document: Column, strict: bool = True) -> Column:
    """A JSON text with its text values redacted, wherever they stand; keys, numbers and all else stay as written."""

    def piece(p: Column) -> Column:
        value = F.from_json(F.concat(F.lit("["), p, F.lit("]")), "array<string>")[0]
        quoted = F.to_json(F.array(redact(value, strict=strict)))
        return F.when(p.startswith('"') & ~p.endswith(":"), F.substring(quoted, F.lit(2), F.length(quoted) - 2)).otherwise(p)

    return F.array_join(F.transform(F.regexp_extract_all(document, F.lit(rf"{_TEXT}(?:\s*:)?|[^\"]+"), F.lit(0)), piece), "")


@contextmanager
def _deep(spark: SparkSession, levels: int) -> Iterator[None]:
    """Spark resolves nested lambdas one level after the other, some rounds for each; documents of many levels need more rounds than it allows."""
    name = "spark.sql.analyzer.maxIterations"
    usual, needed = int(spark.conf.get(name)), 40 + 10 * levels
    if needed <= usual:
        yield
        return
    spark.conf.set(name, str(needed))
    try:
        yield
    finally:
        spark.conf.set(name, str(usual))


def masked_documents(df: DataFrame, column: str, out: str | None = None, levels: int | None = None, strict: bool = True) -> DataFrame:
    """``df`` with the JSON texts of ``column`` masked, as ``out`` (the column itself by default).

    In each object, however deep, keys that name something secret become ``[SENSITIVE_KEY]``, ``[SENSITIVE_KEY]_2`` and so on in the order
    of their names, and their values stay; each text value is redacted, in objects as in arrays; numbers, booleans and null stay. Keys
    come out in their order by name. A text that is not JSON, or names a key twice in one object, is redacted as a whole; null stays null.
    ``levels`` is the depth of the deepest document where it is known, and saves reading the column for it.
    """
    source, target = F.col(f"`{column}`"), out or column
    if levels is None:
        levels = df.agg(F.max(nesting(source))).first()[0] or 0
    parsed = "__" + target
    rows = df.withColumn(parsed, F.try_parse_json(source))
    with _deep(df.sparkSession, levels):
        rows = rows.withColumn(parsed, F.to_json(walked(F.col(f"`{parsed}`"), levels, masked_keys)))
    masked = F.coalesce(redacted_values(F.col(f"`{parsed}`"), strict), redact(source, strict=strict))
    return rows.withColumn(target, masked).drop(parsed)
