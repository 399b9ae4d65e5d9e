"""Time-window reports; the streaming jobs compute the same in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.operators.monitor import credits


def query_metrics_sliding(log: DataFrame, width: str = "5 minutes", every: str = "1 minute") -> DataFrame:
    """Query counts, times, bytes and credits of the last ``width``, every ``every``.

    Rows are first added up per step, so a row is repeated into overlapping windows only after
    aggregation; ``width`` is a multiple of ``every``.
    """
    step = log.groupBy(F.window("start_time", every).alias("s")).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("status") == "SUCCESS").alias("good"),
        F.sum("exec_s").alias("exec"),
        F.max("exec_s").alias("longest"),
        F.sum("scanned_bytes").alias("bytes"),
        F.sum(F.col("compute_centi") * 10 + F.col("cloud_milli")).alias("milli"),
    )
    starts = step.withColumn("start_time", F.col("s.start"))
    return (
        starts.groupBy(F.window("start_time", width, every).alias("w"))
        .agg(
            F.sum("n").alias("total_queries"),
            F.sum("good").alias("succeeded"),
            (F.sum("exec").cast("double") / F.sum("n")).alias("avg_exec_s"),
            F.max("longest").cast("double").alias("max_exec_s"),
            F.sum("bytes").alias("bytes_scanned"),
            (F.sum("milli").cast("double") / 1000.0).alias("credits"),
        )
        .select(F.col("w.start").alias("window_start"), "total_queries", "succeeded", "avg_exec_s", "max_exec_s", "bytes_scanned", "credits")
    )


def credits_tumbling(log: DataFrame, width: str = "1 day") -> DataFrame:
    return (
        log.groupBy(F.window("start_time", width).alias("w"), "warehouse")
        .agg(credits().alias("credits"), F.count("*").alias("query_count"))
        .select(F.col("w.start").alias("window_start"), "warehouse", "credits", "query_count")
    )


def active_users(events: DataFrame, ts: str, user: str, width: str = "1 day", exact: bool = True) -> DataFrame:
    """Distinct users per window; streams use the approximate form, whose state has a fixed size."""
    n = F.count_distinct(user) if exact else F.approx_count_distinct(user, 0.02)
    return events.groupBy(F.window(ts, width).alias("w")).agg(n.alias("active_users")).select(F.col("w.start").alias("window_start"), "active_users")


def heartbeats_by_day(events: DataFrame, user: str, ts: str, ident: str) -> DataFrame:
    """The first heartbeat of each user and day."""
    day = F.col(ts).cast("date").alias("day")
    return events.groupBy(user, day).agg(F.min(F.struct(ts, ident)).alias("f")).select(user, "day", f"f.{ts}", f"f.{ident}")

