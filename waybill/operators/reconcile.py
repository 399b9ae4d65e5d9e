"""Migration control: latest batches, row-count reconciliation, readiness and impact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.functions.numbers import half_up


def latest_batch(control: DataFrame) -> DataFrame:
    """The control row of the highest batch of each table; an aggregate instead of a correlated look-up."""
    rest = [c for c in control.columns if c != "table_name"]
    return control.groupBy("table_name").agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select("table_name", "r.*")


def count_reconciliation(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Source and target counts, difference and match percentage; a missing target stays NULL."""
    right = targets.select("table_name", F.col("row_count").alias("target_rows"))
    joined = sources.select("table_name", F.col("row_count").alias("source_rows")).join(right, "table_name", "left")
    percent = half_up(F.col("target_rows").cast("double") / F.nullif(F.col("source_rows"), F.lit(0)) * 100.0, 2)
    return joined.select(
        "table_name", "source_rows", "target_rows",
        (F.col("source_rows") - F.col("target_rows")).alias("difference"),
        F.when(F.col("source_rows") == 0, 0.0).otherwise(percent).alias("match_percentage"),
    )


def reconciliation_summary(control: DataFrame, sources: DataFrame) -> DataFrame:
    """Latest batch per table against the source count, with completion and duration."""
    counts = sources.select("table_name", F.col("row_count").alias("source_rows"))
    done = half_up(F.col("rows_migrated").cast("double") / F.nullif(F.col("source_rows"), F.lit(0)) * 100.0, 2)
    return latest_batch(control).join(counts, "table_name").select(
        "table_name", "status", "rows_migrated", "source_rows",
        (F.col("rows_migrated") - F.col("source_rows")).alias("row_difference"),
        F.when(F.col("source_rows") == 0, 100.0).otherwise(done).alias("completion_percentage"),
        "start_timestamp", "end_timestamp",
        F.timestamp_diff("MINUTE", F.col("start_timestamp"), F.col("end_timestamp")).alias("duration_minutes"),
    )


def quality_summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("table_name").agg(
        F.count_distinct("issue_type").alias("issue_types"),
        F.count("*").alias("total_issues"),
        F.sum("row_count").alias("affected_rows"),
        F.max("discovered_at").alias("last_discovered"),
    )


def reconciliation_report(control: DataFrame, sources: DataFrame, issues: DataFrame, report_date: str) -> DataFrame:
    quality = quality_summary(issues).select(
        "table_name", "total_issues", F.col("affected_rows").alias("quality_affected_rows")
    )
    return reconciliation_summary(control, sources).join(quality, "table_name", "left").withColumn("report_date", F.lit(report_date))


def migration_progress(sources: DataFrame) -> DataFrame:
    """One row: distinct tables by status, rows of finished tables, first start, last end."""
    by_status = lambda s: F.count_distinct(F.when(F.col("migration_status") == s, F.col("table_name")))
    finished = F.col("migration_status") == "completed"
    return sources.agg(
        F.count_distinct("table_name").alias("total_tables"),
        by_status("completed").alias("completed_tables"),
        by_status("in_progress").alias("in_progress_tables"),
        by_status("pending").alias("pending_tables"),
        F.coalesce(F.sum(F.when(finished, F.col("row_count")).otherwise(0)), F.lit(0).cast("long")).alias("total_rows_migrated"),
        F.min("migration_started").alias("migration_start_time"),
        F.max("migration_completed").alias("last_completion_time"),
    )


def migration_impact(stats: DataFrame, checkpoints: bool, rollback: bool, large: int = 10_000_000) -> DataFrame:
    """Risk of a plan from its tables (``table_name``, ``rows``, ``transforms``, ``dependencies``).

    More than three large tables or 100 million rows is HIGH; one large table or 10 million rows MEDIUM.
    Time counts 10 000 rows per second and at least a minute per table.
    """
    summed = stats.agg(
        F.count("*").alias("tables"),
        F.coalesce(F.sum("rows"), F.lit(0).cast("long")).alias("total_rows"),
        F.count_if(F.col("rows") > large).alias("large_tables"),
        F.count_if(F.col("transforms") > 5).alias("complex_tables"),
        F.coalesce(F.sum("dependencies"), F.lit(0).cast("long")).alias("dependencies"),
        F.sum(F.greatest(F.lit(60).cast("long"), F.expr("rows DIV 10000"))).alias("estimated_seconds"),
    )
    level = (
        F.when((F.col("large_tables") > 3) | (F.col("total_rows") > 100_000_000), "HIGH")
        .when((F.col("large_tables") > 0) | (F.col("total_rows") > 10_000_000), "MEDIUM")
        .otherwise("LOW")
    )
    factors = [
        F.when(F.col("large_tables") > 0, "large tables"),
        F.when(F.col("complex_tables") > 0, "complex transformations"),
        F.when(F.col("dependencies") > 10, "many dependencies"),
        F.when(F.lit(not checkpoints), "checkpoints off"),
        F.when(F.lit(not rollback), "rollback off"),
    ]
    advice = [
        F.when(F.col("risk_level") == "HIGH", "stream large tables"),
        F.when(F.col("risk_level") == "HIGH", "run at low traffic"),
        F.when(F.col("risk_level") == "MEDIUM", "watch progress"),
        F.when(F.col("dependencies") > 10, "split into phases"),
        F.when(F.lit(not checkpoints), "turn checkpoints on"),
        F.when(F.lit(not rollback), "turn rollback on"),
    ]
    text = lambda parts: F.array_join(F.array_compact(F.array(*parts)), "; ")
    return summed.withColumn("risk_level", level).withColumn("risk_factors", text(factors)).withColumn("recommendations", text(advice))
