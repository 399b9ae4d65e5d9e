"""Measured facts about tables: counts, sizes, column profiles, convertibility."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions.convert import parse_date_multi
from waybill.operators.quality import tall


def _text(c: Column, kind: str) -> Column:
    """A value as text that does not depend on how an engine prints floats."""
    return c.cast("decimal(38,2)").cast("string") if kind in ("double", "float") else c.cast("string")


def table_profile(df: DataFrame, table: str, exact_distinct: bool = False) -> DataFrame:
    """One row per column: position, type, whether it may be null, rows, nulls, distinct values, smallest and greatest value.

    Distinct values are estimated in the same pass; ``exact_distinct`` counts them by their text in one
    more pass, which shuffles the distinct values of all columns.
    """
    fields = list(df.schema)
    aggs = [F.count("*").alias("n")]
    for i, f in enumerate(fields):
        aggs += [F.count_if(F.col(f.name).isNull()).alias(f"n{i}"), F.min(f.name).alias(f"lo{i}"), F.max(f.name).alias(f"hi{i}")]
        if not exact_distinct:
            aggs.append(F.approx_count_distinct(f.name, 0.02).alias(f"d{i}"))
    facts = {}
    for i, f in enumerate(fields):
        kind = f.dataType.simpleString()
        facts[f.name] = {
            "table_name": F.lit(table),
            "position": F.lit(i + 1),
            "data_type": F.lit(kind),
            "nullable": F.lit(f.nullable),
            "row_count": F.col("n"),
            "nulls": F.col(f"n{i}"),
            "min_value": _text(F.col(f"lo{i}"), kind),
            "max_value": _text(F.col(f"hi{i}"), kind),
        }
        if not exact_distinct:
            facts[f.name]["distinct_values"] = F.col(f"d{i}")
    out = tall(df.agg(*aggs), "column_name", facts)
    if not exact_distinct:
        return out
    # one pass for all columns: (column, value) pairs are made distinct before the shuffle and after it
    pairs = df.select(F.posexplode(F.array(*[F.col(f.name).cast("string") for f in fields])).alias("at", "value"))
    counted = pairs.where("value IS NOT NULL").distinct().groupBy("at").agg(F.count("value").alias("distinct_values"))
    return (
        out.join(counted, F.col("position") == F.col("at") + 1, "left")
        .withColumn("distinct_values", F.coalesce("distinct_values", F.lit(0)))
        .drop("at")
    )


def profiles(tables: Mapping[str, DataFrame], exact_distinct: bool = False) -> DataFrame:
    return reduce(DataFrame.unionByName, [table_profile(df, name, exact_distinct) for name, df in tables.items()])


def row_stats(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and bytes per table: text bytes as stored, eight bytes for every other value."""
    parts = []
    for name, df in tables.items():
        texts = [f.name for f in df.schema if f.dataType.typeName() == "string"]
        size = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in texts], F.lit(8 * (len(df.columns) - len(texts))).cast("long"))
        parts.append(
            df.agg(F.count("*").alias("row_count"), F.coalesce(F.sum(size), F.lit(0).cast("long")).alias("bytes")).select(
                F.lit(name).alias("table_name"), "row_count", "bytes"
            )
        )
    return reduce(DataFrame.unionByName, parts)


def type_check(staged: DataFrame, target: DataFrame) -> DataFrame:
    """Columns of both tables by name: types, whether they differ, and how many staged values do not convert."""
    want = {f.name: f.dataType.simpleString() for f in target.schema}
    have = {f.name: f.dataType.simpleString() for f in staged.schema}
    aggs, facts = [], {}
    for i, (name, kind) in enumerate(have.items()):
        c = F.col(name)
        if name in want and want[name] != kind:
            made = parse_date_multi(c.cast("string")) if want[name] in ("date", "timestamp", "timestamp_ntz") else c.try_cast(want[name])
            bad = F.count_if(c.isNotNull() & made.isNull())
        else:
            bad = F.sum(F.lit(0).cast("long"))
        aggs.append(bad.alias(f"b{i}"))
        facts[name] = {
            "staged_type": F.lit(kind),
            "target_type": F.lit(want.get(name)).cast("string"),
            "mismatch": F.lit(want.get(name) != kind),
            "unconvertible": F.coalesce(F.col(f"b{i}"), F.lit(0).cast("long")),
        }
    for name in want:
        if name not in have:
            facts[name] = {
                "staged_type": F.lit(None).cast("string"),
                "target_type": F.lit(want[name]),
                "mismatch": F.lit(True),
                "unconvertible": F.lit(0).cast("long"),
            }
    return tall(staged.agg(*aggs), "column_name", facts)
