"""Data quality checks: one pass over the table, one row per check."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions.numbers import ratio


def tall(one_row: DataFrame, label: str, groups: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """Turn one row of aggregates into one row per entry of ``groups`` (label -> {column: value})."""
    entries = [
        F.struct(F.lit(name).alias(label), *[c.alias(out) for out, c in cols.items()]) for name, cols in groups.items()
    ]
    return one_row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def rule_report(df: DataFrame, failures: Mapping[str, Column]) -> DataFrame:
    """PASS or FAIL with the failed rows of each rule; all rules share one aggregate."""
    counted = df.agg(*[c.alias(f"f{i}") for i, c in enumerate(failures.values())])
    return tall(
        counted,
        "rule",
        {
            name: {
                "result": F.when(F.col(f"f{i}") == 0, "PASS").otherwise("FAIL"),
                "failed_rows": F.col(f"f{i}"),
            }
            for i, name in enumerate(failures)
        },
    )


def null_blank(df: DataFrame) -> DataFrame:
    """NULLs and blank texts per column, with the ratio of filled cells."""
    aggs, texts = [F.count("*").alias("n")], {f.name for f in df.schema if f.dataType.typeName() == "string"}
    for i, name in enumerate(df.columns):
        aggs.append(F.count_if(F.col(name).isNull()).alias(f"n{i}"))
        blank = F.count_if(F.trim(F.col(name)) == "") if name in texts else F.lit(0).cast("long")
        aggs.append(blank.alias(f"b{i}"))
    return tall(
        df.agg(*aggs),
        "column_name",
        {
            name: {
                "nulls": F.col(f"n{i}"),
                "blanks": F.col(f"b{i}"),
                "filled_ratio": ratio(F.col("n") - F.col(f"n{i}"), F.col("n")),
            }
            for i, name in enumerate(df.columns)
        },
    )


def required_nulls(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """NULL count and verdict per required column, in one scan."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return tall(
        counted,
        "column_name",
        {
            c: {
                "table_name": F.lit(table),
                "null_count": F.col(c),
                "passed": F.col(c) == 0,
            }
            for c in columns
        },
    )


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def count_check(source: DataFrame, target: DataFrame, name: str) -> DataFrame:
    """Source and target row counts and whether they agree."""
    tagged = source.select(F.lit(1).alias("s"), F.lit(0).alias("t")).unionAll(target.select(F.lit(0), F.lit(1)))
    return tagged.agg(F.sum("s").alias("source_rows"), F.sum("t").alias("target_rows")).select(
        F.lit(name).alias("table_name"), "source_rows", "target_rows", (F.col("source_rows") == F.col("target_rows")).alias("passed")
    )


def fk_orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child keys without a parent and how many rows carry each; NULL keys are not orphans.

    The child is counted per key before the join, so a hot key is one row.
    """
    counted = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("orphan_rows"))
    return counted.join(parent, F.col(column) == F.col(key), "left_anti")


def completeness(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Share of distinct source keys that the target holds."""
    present = target.select(F.col(key).alias("__t")).distinct()
    keys = source.select(key).where(F.col(key).isNotNull()).distinct()
    return (
        keys.join(present, F.col(key) == F.col("__t"), "left")
        .agg(F.count("*").alias("source_keys"), F.count("__t").alias("present_keys"))
        .withColumn("present_ratio", ratio(F.col("present_keys"), F.col("source_keys")))
    )


def accuracy(source: DataFrame, target: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Per column the share of matched keys whose values agree (NULL equals NULL); keys are unique."""
    right = target.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__t_{c}") for c in columns])
    matched = source.join(right, F.col(key) == F.col("__k"))
    counted = matched.agg(
        F.count("*").alias("n"), *[F.count_if(F.col(c).eqNullSafe(F.col(f"__t_{c}"))).alias(f"e_{c}") for c in columns]
    )
    return tall(
        counted,
        "column_name",
        {
            c: {"matched": F.col("n"), "equal": F.col(f"e_{c}"), "accuracy": ratio(F.col(f"e_{c}"), F.col("n"))}
            for c in columns
        },
    )


@dataclass(frozen=True)
class Rule:
    name: str
    expression: str
    severity: str = "WARNING"
    enabled: bool = True


STOPPING = ("ERROR", "CRITICAL")


class QualityError(RuntimeError):
    """A rule of stopping severity failed."""


def rule_results(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Result of every enabled rule, with ``stops`` for failures that end the migration."""
    used = [r for r in rules if r.enabled]
    counted = df.agg(
        *[F.count_if(~F.coalesce(F.expr(r.expression), F.lit(False))).alias(f"f{i}") for i, r in enumerate(used)]
    )
    return tall(
        counted,
        "rule",
        {
            r.name: {
                "severity": F.lit(r.severity),
                "failed_rows": F.col(f"f{i}"),
                "result": F.when(F.col(f"f{i}") == 0, "PASS").otherwise("FAILED"),
                "stops": (F.col(f"f{i}") > 0) & F.lit(r.severity in STOPPING),
            }
            for i, r in enumerate(used)
        },
    )


def gate(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rows, or an error when a stopping rule fails (one aggregate row reaches the driver)."""
    broken = [row["rule"] for row in rule_results(df, rules).where("stops").collect()]
    if broken:
        raise QualityError(f"rules failed: {', '.join(sorted(broken))}")
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def column_types(df: DataFrame, table: str) -> list[tuple[str, str, int, str, bool]]:
    """Name, position, type and nullability of the columns, from the schema alone."""
    return [(table, f.name, i + 1, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema)]


def type_mismatches(left: DataFrame, right: DataFrame) -> list[tuple[str, str | None, str | None, bool]]:
    """Columns of two tables by name with both types; a handful of schema facts, no rows."""
    a = {f.name: f.dataType.simpleString() for f in left.schema}
    b = {f.name: f.dataType.simpleString() for f in right.schema}
    return [(n, a.get(n), b.get(n), a.get(n) != b.get(n)) for n in sorted({*a, *b})]
