"""Write modes, batch rollback and resumable copies on file tables.

A table image is always written to a new path and the reader is moved there; a path that is
being read is never overwritten, so a lost executor or a failed job leaves the old image whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.operators.diff import row_checksum


def written(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a new table at ``path`` and read it back."""
    _balanced(df, partition_by).write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(_nullable(df)).parquet(path)


def _balanced(rows: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Rows of a partition value brought together; Spark splits large values and joins small ones by size."""
    return rows.hint("rebalance", *[F.col(c) for c in partition_by]) if partition_by else rows


def _nullable(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def append(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    rows.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def one_per_key(source: DataFrame, key: str, latest_by: str | None = None) -> DataFrame:
    """Source rows with one row per key: the latest, or an error for a repeated key."""
    rest = [c for c in source.columns if c != key]
    row = F.struct(*rest)
    if latest_by:
        picked = F.max_by(row, F.struct(latest_by, row_checksum(rest)))
    else:
        again = F.raise_error(F.concat(F.lit("source key repeats: "), F.col(key).cast("string")))
        picked = F.when(F.count("*") == 1, F.first(row)).otherwise(again.cast(source.select(row.alias("r")).schema[0].dataType))
    return source.groupBy(key).agg(picked.alias("__r")).select(key, "__r.*").select(*source.columns)


#: Rows of a task that merges; Spark alone sizes its tasks by compressed bytes, and keys in order compress far below their size in memory.
MERGE_ROWS = 250_000


def upserted(target: DataFrame, source: DataFrame, key: str, latest_by: str | None = None) -> DataFrame:
    """Image after updating matched keys and inserting new ones.

    Both tables are counted first, and dealt by key into as many tasks as their rows ask for.
    """
    tasks = -(-max(source.count(), target.count()) // MERGE_ROWS)
    if tasks > 1:
        source, target = source.repartition(tasks, key), target.repartition(tasks, key)
    unique = one_per_key(source, key, latest_by)
    untouched = target.join(source.select(key).distinct(), key, "left_anti")
    return untouched.select(*target.columns).unionByName(unique)


def replace_partitions(rows: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace only the partitions that ``rows`` touch."""
    _balanced(rows, partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def sync_operations(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Operation per key that makes ``target`` equal to ``source``, with the resulting row.

    ``KEEP`` rows are equal; a ``DELETE`` row carries no values. The image is every other row.
    """
    columns = [c for c in source.columns if c != key]
    a = source.select(key, F.struct(*columns).alias("__s"))
    b = target.select(key, F.struct(*columns).alias("__t"))
    op = (
        F.when(F.col("__t").isNull(), "INSERT")
        .when(F.col("__s").isNull(), "DELETE")
        .when(~F.col("__s").eqNullSafe(F.col("__t")), "UPDATE")
        .otherwise("KEEP")
    )
    return a.join(b, key, "full_outer").select(key, op.alias("op"), "__s.*")


def synced(operations: DataFrame) -> DataFrame:
    return operations.where(F.col("op") != "DELETE").drop("op")


def rollback_batch(table: DataFrame, migration_column: str, migration_id) -> DataFrame:
    """Image without the rows a migration inserted."""
    return table.where(~F.col(migration_column).eqNullSafe(F.lit(migration_id)))


def copy_batches(source: DataFrame, batch: str, path: str, done_path: str) -> DataFrame:
    """Copy the batches that are not yet recorded as done, record them, and return the target.

    Batches are partitions of the target and are replaced as a whole, so a batch that was cut
    off half way is written again and never doubled.
    """
    spark = source.sparkSession
    done = spark.read.parquet(done_path).select(batch).distinct()
    todo = source.join(done, batch, "left_anti")
    replace_partitions(todo, path, [batch])
    finished = source.select(batch).distinct().join(done, batch, "left_anti")
    finished.write.mode("append").parquet(done_path)
    return spark.read.schema(_nullable(source)).parquet(path).select(*source.columns)
