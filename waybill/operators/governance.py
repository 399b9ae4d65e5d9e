"""Erasure, export and retention of personal and classified rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.operators.ordered import row_number_by_key


def erased(table: DataFrame, column: str, subjects: DataFrame) -> DataFrame:
    """Rows of ``table`` that belong to none of the subjects (one column of distinct ids)."""
    return table.join(subjects.toDF("__subject"), F.col(column) == F.col("__subject"), "left_anti")


def erasure_log(tables: Mapping[str, tuple[DataFrame, str]], subjects: DataFrame) -> DataFrame:
    """Rows before, deleted and left per table; tables are counted per subject id before the join."""
    ids = subjects.toDF("__subject").withColumn("__hit", F.lit(True))
    parts = []
    for name, (table, column) in tables.items():
        counted = table.groupBy(F.col(column).cast("long").alias("__subject")).agg(F.count("*").alias("n"))
        joined = counted.join(ids, "__subject", "left")
        before = F.coalesce(F.sum("n"), F.lit(0).cast("long"))
        gone = F.coalesce(F.sum(F.when(F.col("__hit"), F.col("n"))), F.lit(0).cast("long"))
        parts.append(joined.agg(before.alias("rows_before"), gone.alias("rows_deleted")).withColumn("table_name", F.lit(name)))
    return reduce(DataFrame.unionByName, parts).withColumn("rows_left", F.col("rows_before") - F.col("rows_deleted"))


def subject_export(
    tables: Mapping[str, tuple[DataFrame, str, str, Sequence[str]]], subjects: DataFrame, size: int = 1000
) -> DataFrame:
    """Documents per subject and section, each a JSON list of at most ``size`` rows.

    ``tables`` maps a section to (rows, subject column, unique order column, columns to give).
    Long histories come in several numbered parts, so no subject gathers all rows in one task.
    """
    ids = subjects.toDF("subject")
    parts = []
    for section, (rows, column, order, columns) in tables.items():
        mine = rows.select(F.col(column).cast("long").alias("subject"), F.col(order).alias("__order"), F.struct(*columns).alias("__row")).join(ids, "subject", "left_semi")
        numbered = row_number_by_key(mine, ["subject"], ["__order"], "__n")
        listed = F.array_sort(F.collect_list(F.struct("__n", "__row")))
        parts.append(
            numbered.groupBy("subject", F.floor((F.col("__n") - 1) / size).alias("part"))
            .agg(F.count("*").alias("items"), F.to_json(F.transform(listed, lambda e: e["__row"])).alias("document"))
            .withColumn("section", F.lit(section))
        )
    return reduce(DataFrame.unionByName, parts)


def retention_cut(rows: DataFrame, level: Column, ts: str, as_of: Column, years: Mapping[str, int]) -> DataFrame:
    """Rows with their class and whether its retention has run out; unknown classes are kept."""
    kept_years = F.try_element_at(F.create_map(*[F.lit(x) for kv in years.items() for x in kv]), F.col("level"))
    cutoff = F.add_months(as_of, -12 * F.col("__years"))
    expired = F.coalesce(F.col(ts).cast("date") < cutoff, F.lit(False))
    return (
        rows.withColumn("level", level)
        .withColumn("__years", kept_years)
        .withColumn("action", F.when(expired, "purge").otherwise("keep"))
        .drop("__years")
    )
