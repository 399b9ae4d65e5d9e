"""Table backups, their verification, and restores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fnmatch import fnmatchcase
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from waybill.operators.diff import row_checksum


def selected(names: Sequence[str], include: Sequence[str] = (), exclude: Sequence[str] = ()) -> list[str]:
    """Table names that an include pattern admits (none given: all) and no exclude pattern drops."""
    kept = [n for n in names if not include or any(fnmatchcase(n, p) for p in include)]
    return [n for n in kept if not any(fnmatchcase(n, p) for p in exclude)]


def table_backup(tables: Mapping[str, DataFrame], root: str, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Copy the chosen tables below ``root`` and list them with row counts taken during the copy."""
    done = []
    for name in selected(list(tables), include, exclude):
        seen = Observation()
        tables[name].observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{root}/{name}")
        done.append((name, seen.get["rows"]))
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(done, "table_name string, row_count long")


def table_checksum(table: DataFrame) -> DataFrame:
    """One row that depends on the rows but not on their order or place.

    Two sums over independent halves of a SHA-256 per row; equal rows count as often as they occur.
    """
    digest = row_checksum(table.columns)
    part = lambda start: F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(20,0)")
    hashed = table.select(part(1).alias("a"), part(17).alias("b"))
    return hashed.agg(F.count("*").alias("rows"), F.coalesce(F.sum("a"), F.lit(0)).alias("sum_a"), F.coalesce(F.sum("b"), F.lit(0)).alias("sum_b"))


def backup_verify(source: Mapping[str, DataFrame], backup: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of each table and whether the backup's checksum equals the source's."""
    parts = []
    for name, table in source.items():
        sides = table_checksum(table).withColumn("side", F.lit("source")).unionByName(
            table_checksum(backup[name].select(*table.columns)).withColumn("side", F.lit("backup"))
        )
        value = F.struct("rows", "sum_a", "sum_b")
        picked = lambda side: F.max(F.when(F.col("side") == side, value))
        parts.append(
            sides.agg(picked("source").alias("s"), picked("backup").alias("b")).select(
                F.lit(name).alias("table_name"), F.col("s.rows").alias("source_rows"), F.col("b.rows").alias("backup_rows"), (F.col("s") == F.col("b")).alias("verified")
            )
        )
    return reduce(DataFrame.unionByName, parts)


class BackupError(RuntimeError):
    """A backup does not match the checksum taken when it was made."""


def restore(backup: DataFrame, current: DataFrame | None, key: str, skip_existing: bool = False, expected: DataFrame | None = None) -> DataFrame:
    """Rows after a restore; ``skip_existing`` keeps current rows and adds only missing keys.

    ``expected`` is the checksum row taken at backup time; a restore from other content is refused.
    """
    if expected is not None and expected.first() != table_checksum(backup).first():
        raise BackupError("the backup changed after it was made")
    if current is None or not skip_existing:
        return backup
    missing = backup.join(current.select(key).distinct(), key, "left_anti").select(*current.columns)
    return current.unionByName(missing)
