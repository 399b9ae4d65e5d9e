"""The row steps of a table migration: filter, transform, map, validate.

Every step adds to one lazy plan, so filters and the column list reach the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions.convert import convert
from waybill.functions.registry import Registry, transforms
from waybill.operators.skew import skew_join


@dataclass(frozen=True)
class Filter:
    expression: str
    enabled: bool = True


@dataclass(frozen=True)
class Transform:
    """``kind`` names a registered transform; ``condition`` limits it to matching rows."""

    source: str
    target: str
    kind: str
    params: dict = field(default_factory=dict)
    condition: str | None = None


@dataclass(frozen=True)
class Mapping:
    source: str
    target: str
    type: str = ""
    required: bool = False
    default: object = None
    transform: str | None = None


def filter_conjunction(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """Rows that pass all enabled filters; no filters keep all rows."""
    tests = [F.expr(f.expression) for f in filters if f.enabled]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def transform_rows(df: DataFrame, steps: Sequence[Transform], known: Registry | None = None) -> DataFrame:
    """Apply transforms in list order; rows that miss a condition keep their value (NULL if the column is new)."""
    known = known or transforms()
    for step in steps:
        value = known[step.kind](F.col(step.source), **step.params)
        if step.condition:
            keep = F.col(step.target) if step.target in df.columns else F.lit(None)
            value = F.when(F.expr(step.condition), value).otherwise(keep)
        df = df.withColumn(step.target, value)
    return df


def map_columns(df: DataFrame, mappings: Sequence[Mapping], on_error: str = "abort", known: Registry | None = None) -> DataFrame:
    """Project to target names and types.

    A missing column takes its default; without one it is an error if required, else left out.
    A default never replaces a NULL value of a column that is there.
    """
    known = known or transforms()
    out: list[Column] = []
    for m in mappings:
        if m.source in df.columns:
            value = F.col(m.source)
        elif m.default is not None:
            value = F.lit(m.default)
        elif m.required:
            raise ValueError(f"required column {m.source} is missing and has no default")
        else:
            continue
        if m.transform:
            value = known[m.transform](value)
        if m.type:
            value = convert(value, m.type, on_error)
        out.append(value.alias(m.target))
    return df.select(*out)


def lookup_enrich(df: DataFrame, column: str, table: DataFrame, key: str, value: str, target: str) -> DataFrame:
    """Value of ``table`` for the row's key, or the original value where the key is missing.

    The look-up key must be unique; a repeated key fails the job instead of repeating rows.
    """
    once = F.when(F.count("*") == 1, F.first(value)).otherwise(
        F.raise_error(F.concat(F.lit("look-up key repeats: "), F.col(key).cast("string"))).cast(table.schema[value].dataType)
    )
    unique = table.groupBy(key).agg(once.alias("__value")).withColumn("__found", F.lit(True)).withColumnRenamed(key, column)
    joined = skew_join(df, unique, column, "left")
    found = F.coalesce(F.col("__found"), F.lit(False))
    return joined.withColumn(target, F.when(found, F.col("__value")).otherwise(F.col(column).cast("string"))).drop("__value", "__found")


def aggregate_transform(df: DataFrame, keys: Sequence[str], aggregates: dict[str, str]) -> DataFrame:
    """Group by ``keys`` with SQL aggregate expressions by output name."""
    return df.groupBy(*keys).agg(*[F.expr(e).alias(name) for name, e in aggregates.items()])


def migrate(
    df: DataFrame,
    filters: Sequence[Filter] = (),
    steps: Sequence[Transform] = (),
    mappings: Sequence[Mapping] = (),
    on_error: str = "abort",
    known: Registry | None = None,
) -> DataFrame:
    """Filter, transform and map in the fixed order of a table migration."""
    out = transform_rows(filter_conjunction(df, filters), steps, known)
    return map_columns(out, mappings, on_error, known) if mappings else out


# Ready-made migrations; each returns the rows to write.


def full_table_copy(source: DataFrame) -> DataFrame:
    return migrate(source)


def incremental_sync(source: DataFrame, ts: str, last_sync: str = "1970-01-01 00:00:00") -> DataFrame:
    return migrate(source, [Filter(f"{ts} > TIMESTAMP_NTZ '{last_sync}'")])


def data_transformation(source: DataFrame, steps: Sequence[Transform], mappings: Sequence[Mapping], on_error: str = "abort") -> DataFrame:
    return migrate(source, steps=steps, mappings=mappings, on_error=on_error)


def large_table_copy(source: DataFrame, key: str, done_below: int | None = None) -> DataFrame:
    """Copy of the rows at or above the last finished key; Spark cuts the work into partitions."""
    return migrate(source, [] if done_below is None else [Filter(f"{key} >= {done_below}")])


TEMPLATES = {
    "full-table-copy": full_table_copy,
    "incremental-sync": incremental_sync,
    "data-transformation": data_transformation,
    "large-table-streaming": large_table_copy,
}
