"""Bulk and report exports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ExportResult:
    path: str
    rows: int
    bytes: int


def bulk_export(
    rows: DataFrame,
    path: str,
    fmt: str = "csv",
    compression: str = "gzip",
    delimiter: str = ",",
    header: bool = True,
    overwrite: bool = False,
    max_rows_per_file: int = 0,
    single_file: bool = False,
) -> ExportResult:
    """Write rows as files and report rows and bytes; rows are counted while they are written."""
    seen = Observation()
    out = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
    if single_file:  # only on request: one task writes everything
        out = out.coalesce(1)
    writer = out.write.mode("overwrite" if overwrite else "errorifexists").option("compression", compression)
    if fmt == "csv":
        writer = writer.options(sep=delimiter, header=header)
    if max_rows_per_file:
        writer = writer.option("maxRecordsPerFile", max_rows_per_file)
    writer.format(fmt).save(path)
    sizes = rows.sparkSession.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    size = sizes.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return ExportResult(path, seen.get["rows"], size)


def stats_table(stats: DataFrame, metrics: list[str]) -> DataFrame:
    """One row of numbers as rows (metric, value)."""
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    return stats.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def history_export(records: DataFrame, keep: Column, ts: str, key: str, path: str) -> DataFrame:
    """Write matching records oldest first as JSON lines; files follow the order. Returns them as read back."""
    picked = records.where(keep)
    picked.orderBy(ts, key).write.json(path)
    return records.sparkSession.read.schema(picked.schema).json(path)
