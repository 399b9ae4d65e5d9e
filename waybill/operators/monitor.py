"""Query-log, warehouse, credit, metric and health reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions.numbers import half_up, mean, ratio, total
from waybill.operators.ordered import newest_by_key, percentiles_floor

# fixed values: queries a warehouse of each size runs at once; unknown sizes count as the smallest
CAPACITY = {
    "X-SMALL": 8, "SMALL": 16, "MEDIUM": 32, "LARGE": 64,
    "X-LARGE": 128, "2X-LARGE": 256, "3X-LARGE": 512, "4X-LARGE": 1024,
}
# fixed values: histogram bounds in seconds
DEFAULT_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10]
DEPLOYMENT_BOUNDS = [1, 5, 10, 30, 60, 120, 300, 600]
QUERY_BOUNDS = [0.1, 0.5, 1, 5, 10, 30, 60]
# fixed values: health states from best to worst
HEALTH = ["UP", "UNKNOWN", "DEGRADED", "DOWN"]


def slow_queries(log: DataFrame, seconds: float) -> DataFrame:
    return log.where(F.col("exec_s") > seconds)


def query_log_aggregates() -> list[Column]:
    """Aggregates of a query log; 0 instead of NULL where there are no queries."""
    zero = F.lit(0.0)
    succeeded = F.count_if(F.col("status") == "SUCCESS")
    return [
        F.count("*").alias("total_queries"),
        succeeded.alias("succeeded"),
        (F.count("*") - succeeded).alias("failed"),
        F.coalesce(F.try_divide(total(F.col("exec_s")), F.count("*")), zero).alias("avg_exec_s"),
        F.coalesce(F.max("exec_s").cast("double"), zero).alias("max_exec_s"),
        F.coalesce(F.sum("scanned_bytes"), F.lit(0).cast("long")).alias("bytes_scanned"),
        credits().alias("credits"),
    ]


def credits() -> Column:
    """Compute and cloud credits, added as exact thousandths."""
    return F.coalesce(F.sum(F.col("compute_centi") * 10 + F.col("cloud_milli")).cast("double") / 1000.0, F.lit(0.0))


def query_log_summary(log: DataFrame) -> DataFrame:
    return log.agg(
        *query_log_aggregates(), ratio(F.sum("scanned_bytes"), F.count("*")).alias("avg_bytes"),
        (ratio(F.count_if(F.col("status") == "SUCCESS"), F.count("*")) * 100.0).alias("success_rate"),
    )


def warehouse_status(log: DataFrame, running: Column, queued: Column, sizes: Mapping[str, str], states: Mapping[str, str]) -> DataFrame:
    """Size, state and load of each warehouse seen in a query log."""
    lookup = lambda table, miss: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("warehouse")), F.lit(miss))
    return log.groupBy("warehouse").agg(F.count_if(running).alias("running"), F.count_if(queued).alias("queued"), credits().alias("credits")).select(
        "warehouse", lookup(sizes, "UNKNOWN").alias("size"), lookup(states, "RUNNING").alias("state"), "running", "queued", "credits"
    )


def warehouse_summary(status: DataFrame, hours: float) -> DataFrame:
    """Totals over warehouses; utilisation is running queries over capacity, for running warehouses."""
    capacity = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in CAPACITY.items() for x in kv]), F.col("size")), F.lit(8)
    )
    used = F.when(F.col("state") == "RUNNING", F.col("running").cast("double") / capacity).otherwise(0.0)
    return status.agg(
        F.count("*").alias("total_warehouses"),
        F.count_if(F.col("state") == "RUNNING").alias("active_warehouses"),
        F.sum("running").alias("running_queries"),
        F.sum("queued").alias("queued_queries"),
        half_up(F.avg(used), 6).alias("avg_utilization"),
        half_up(F.sum("credits") / F.lit(hours), 6).alias("credits_per_hour"),
    )


def credit_usage_daily(log: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return (
        log.where((F.col("start_time") >= as_of - F.expr(f"INTERVAL '{days}' DAY")) & (F.col("start_time") < as_of))
        .groupBy("warehouse", F.col("start_time").cast("date").alias("day"))
        .agg(
            (F.sum("compute_centi").cast("double") / 100.0).alias("compute_credits"),
            (F.sum("cloud_milli").cast("double") / 1000.0).alias("cloud_credits"),
            credits().alias("total_credits"),
            F.count("*").alias("query_count"),
            (credits() / F.count("*")).alias("credits_per_query"),
        )
    )


def credit_projection(log: DataFrame, monthly_limit: float) -> DataFrame:
    """Credits so far, mean per day seen, 30-day projection and share of the budget (0 without one).

    Days come first: the distinct-day count then works on one row per day.
    """
    daily = log.groupBy(F.col("start_time").cast("date").alias("day")).agg(
        F.sum(F.col("compute_centi") * 10 + F.col("cloud_milli")).alias("milli")
    )
    summed = daily.agg((F.coalesce(F.sum("milli"), F.lit(0)).cast("double") / 1000.0).alias("total_credits"), F.count("*").alias("days"))
    average = ratio(F.col("total_credits"), F.col("days"))
    used = average * 30.0 / monthly_limit * 100.0 if monthly_limit > 0 else F.lit(0.0)
    return summed.select(
        "total_credits", "days", average.alias("daily_average"), (average * 30.0).alias("projected_month"), used.alias("budget_used")
    )


def warehouse_recommendations(log: DataFrame, queue_limit: float = 5.0, idle_exec: float = 1.0, idle_credits: float = 100.0) -> DataFrame:
    per = log.groupBy("warehouse").agg(
        mean(F.col("queue_s")).alias("avg_queue_s"), mean(F.col("exec_s")).alias("avg_exec_s"), credits().alias("credits")
    )
    advice = F.when(F.col("avg_queue_s") > queue_limit, "scale up").when(
        (F.col("avg_exec_s") < idle_exec) & (F.col("credits") > idle_credits), "scale down"
    )
    return per.withColumn("recommendation", advice).where(F.col("recommendation").isNotNull())


def histogram_cumulative(rows: DataFrame, value: str, bounds: Mapping[str, Sequence[float]]) -> DataFrame:
    """Cumulative buckets ``value <= le`` of each named set of bounds, with ``+Inf``, sum and count, in one pass."""
    every = sorted({float(b) for bs in bounds.values() for b in bs})
    v = F.col(value)
    counted = rows.agg(
        F.count(v).alias("count"),
        (F.sum(v.cast("decimal(18,2)")).cast("double")).alias("sum"),
        *[F.count_if(v <= b).alias(f"b{i}") for i, b in enumerate(every)],
    )
    cells = []
    for name, bs in bounds.items():
        for b in bs:
            cells.append(F.struct(F.lit(name).alias("histogram"), F.lit(f"{float(b):g}").alias("le"), F.col(f"b{every.index(float(b))}").alias("bucket")))
        cells.append(F.struct(F.lit(name).alias("histogram"), F.lit("+Inf").alias("le"), F.col("count").alias("bucket")))
    return counted.select(F.explode(F.array(*cells)).alias("c"), "sum", "count").select("c.*", "sum", "count")


def latency_percentiles(rows: DataFrame, key: str, seconds: str, ok: Column) -> DataFrame:
    """p50, p95, p99 as the value at ``floor(p*n/100)``, with extremes, rates and operations per second."""
    marks = percentiles_floor(rows.select(key, seconds), [key], seconds, {"p50": 50, "p95": 95, "p99": 99})
    exact = F.col(seconds).cast("decimal(18,2)")
    stats = rows.groupBy(key).agg(
        F.count("*").alias("operations"),
        F.min(seconds).alias("min_s"),
        F.max(seconds).alias("max_s"),
        mean(exact).alias("avg_s"),
        (ratio(F.count_if(ok), F.count("*")) * 100.0).alias("success_percent"),
        (ratio(F.count_if(~ok), F.count("*")) * 100.0).alias("error_percent"),
        ratio(F.count("*"), F.sum(exact)).alias("throughput"),
    )
    return stats.join(marks, key)


def metric_rollup(points: DataFrame, name: str, ts: str, ident: str, value: str) -> DataFrame:
    return points.groupBy(name).agg(
        F.max_by(value, F.struct(ts, ident)).alias("last_value"),
        F.count("*").alias("count"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        mean(F.col(value).cast("decimal(18,2)")).alias("mean_value"),
    )


def batch_throughput(batches: DataFrame, statement_bytes: int) -> DataFrame:
    """Totals of a batch log (``rows_loaded`` statements, ``seconds``, ``ok``)."""
    statements = F.coalesce(F.sum("rows_loaded"), F.lit(0).cast("long"))
    return batches.agg(
        F.count("*").alias("batches"),
        statements.alias("statements"),
        (statements * statement_bytes).alias("bytes"),
        F.count_if("ok").alias("succeeded"),
        F.count_if(~F.col("ok")).alias("failed"),
        ratio(statements, F.count("*")).alias("avg_batch_size"),
        ratio(F.sum("seconds"), F.count("*")).alias("avg_seconds"),
        ratio(statements, F.sum("seconds")).alias("throughput"),
    )


def load_rate(log: DataFrame) -> DataFrame:
    return log.agg(ratio(F.sum("rows_loaded"), F.sum("seconds")).alias("rows_per_second"))


def usage_stats(events: DataFrame, parts: Mapping[str, Column], user: str) -> DataFrame:
    """Counts by category and name and of all events in one pass, plus distinct users overall."""
    parts = {**parts, "events": F.lit("total")}
    tags = F.array_compact(
        F.array(*[F.when(c.isNotNull(), F.struct(F.lit(k).alias("category"), c.alias("name"))) for k, c in parts.items()])
    )
    by_name = events.select(F.explode(tags).alias("t")).groupBy("t.category", "t.name").agg(F.count("*").alias("n"))
    users = events.agg(F.count_distinct(user).alias("n")).select(F.lit("users").alias("category"), F.lit("unique").alias("name"), "n")
    none = events.sparkSession.range(1).select(F.lit("events").alias("category"), F.lit("total").alias("name"), F.lit(0).cast("long").alias("n"))
    return by_name.unionByName(none).groupBy("category", "name").agg(F.sum("n").alias("n")).unionByName(users)


def error_rate(events: DataFrame, failed: Column) -> DataFrame:
    rate = ratio(F.count_if(failed), F.count("*"))
    return events.agg(
        F.count("*").alias("total"), F.count_if(failed).alias("failed"), rate.alias("error_rate"),
        F.when(F.count("*") == 0, 0.0).otherwise((F.lit(1.0) - rate) * 100.0).alias("success_percent"),
    )


def error_summary(errors: DataFrame, last: int = 10) -> DataFrame:
    """Errors by severity, by code and in all, counted in one pass, and the last entries, as tagged rows."""
    sections = {"severity": F.col("severity"), "code": F.col("code"), "total": F.lit("all")}
    tags = F.array(*[F.struct(F.lit(k).alias("section"), c.cast("string").alias("name")) for k, c in sections.items()])
    counted = errors.select(F.explode(tags).alias("t")).groupBy("t.section", "t.name").agg(F.count("*").alias("n"))
    none = errors.sparkSession.range(1).select(F.lit("total").alias("section"), F.lit("all").alias("name"), F.lit(0).cast("long").alias("n"))
    counted = counted.unionByName(none).groupBy("section", "name").agg(F.sum("n").alias("n"))
    newest = errors.orderBy(F.desc("ts"), F.desc("event_id")).limit(last)
    recent = newest.select(F.lit("recent").alias("section"), F.col("message").alias("name"), F.col("event_id").alias("n"))
    return counted.unionByName(recent)


def deployment_kpis(deployments: DataFrame, log: DataFrame, as_of: Column, hours: int = 6) -> DataFrame:
    """Four dashboard panels as rows (panel, first label, second label, value); deployments are read and counted once for three of them."""
    none, db, code = F.lit(""), F.col("database_name"), F.col("error_code")
    counted = deployments.groupBy(db, code).agg(
        F.count("*").alias("n"), F.count_if(F.col("state") == "completed").alias("done"), F.count_if(F.col("state") == "failed").alias("failed"),
        F.sum("minutes").alias("minutes"), F.count("minutes").alias("timed"),
    )

    def row(name: str, label: Column, detail: Column, part: Column, of: Column) -> Column:
        return F.struct(F.lit(name).alias("panel"), label.alias("label"), detail.alias("detail"), part.cast("long").alias("part"), of.cast("long").alias("of"))

    rows = [
        row("success_rate", none, none, F.col("done"), F.col("n")),
        row("mean_minutes", db, none, F.col("minutes"), F.col("timed")),
        row("failures", db, code, F.col("failed"), F.lit(None)),
    ]
    sums = counted.select(F.explode(F.array(*rows)).alias("r")).select("r.*").groupBy("panel", "label", "detail").agg(F.sum("part").alias("part"), F.sum("of").alias("of"))
    value = F.when(F.col("panel") == "failures", F.col("part").cast("double")).otherwise(F.col("part").cast("double") / F.col("of"))
    panels = sums.where("panel <> 'failures' OR part > 0").select("panel", "label", "detail", value.alias("value"))
    recent = log.where(F.col("start_time") >= as_of - F.expr(f"INTERVAL '{hours}' HOUR"))
    credited = recent.groupBy("warehouse").agg(credits().alias("value"))
    return panels.unionByName(credited.select(F.lit("credits").alias("panel"), F.col("warehouse").alias("label"), none.alias("detail"), "value"))


def health_rollup(checks: DataFrame, by: Sequence[Column]) -> DataFrame:
    """Worst state wins: DOWN, then DEGRADED, then UNKNOWN, then UP."""
    states = F.array(*[F.lit(s) for s in HEALTH])
    rank = F.max(F.array_position(states, F.col("status")).cast("int"))
    return checks.groupBy(*by).agg(F.element_at(states, rank).alias("status"), F.count("*").alias("checks"))


def severity_summary(findings: DataFrame, levels: Sequence[str] = ("CRITICAL", "HIGH", "MEDIUM", "LOW")) -> DataFrame:
    return findings.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in levels]
    )


def metric_history_tail(points: DataFrame, name: str, ts: str, ident: str, since: Column, keep: int = 100) -> DataFrame:
    """The newest ``keep`` points per metric, of those the ones inside the look-back."""
    newest = newest_by_key(points, [name], [F.desc(ts), F.desc(ident)], ident, keep, "__n").drop("__n")
    return newest.where(F.col(ts) >= since)


def recent_mean(timings: DataFrame, keys: Sequence[str], ts: str, ident: str, seconds: str, keep: int = 100) -> DataFrame:
    newest = newest_by_key(timings, keys, [F.desc(ts), F.desc(ident)], ident, keep, "__n")
    return newest.groupBy(*keys).agg(F.count("*").alias("points"), ratio(F.sum(F.col(seconds).cast("decimal(18,2)")), F.count("*")).alias("mean_s"))


def alerts_threshold(log: DataFrame, slow_s: float = 300, queue_s: float = 30, spill_bytes: int = 1 << 30, rules: Sequence[tuple[str, str, str, Column]] = ()) -> DataFrame:
    """Alerts of each query; one query may raise several. ``rules`` adds (id prefix, type, severity, test)."""
    builtin = [
        ("slow_query", "SLOW_QUERY", "WARNING", F.col("exec_s") > slow_s),
        ("queue_time", "LONG_QUEUE", "WARNING", F.col("queue_s") > queue_s),
        ("spillage", "MEMORY_SPILLAGE", "CRITICAL", F.col("spill_bytes") > spill_bytes),
    ]
    raised = [
        F.when(test, F.struct(F.concat(F.lit(f"{prefix}_"), F.col("query_id")).alias("alert_id"), F.lit(kind).alias("alert_type"), F.lit(level).alias("severity")))
        for prefix, kind, level, test in [*builtin, *rules]
    ]
    return log.select("event_id", "start_time", "warehouse", F.explode(F.array_compact(F.array(*raised))).alias("a")).select(
        "a.*", "event_id", "start_time", "warehouse"
    )


def recent_alerts(alerts: DataFrame, last: int = 10) -> DataFrame:
    return alerts.orderBy(F.desc("start_time"), F.desc("event_id"), F.asc("alert_type")).limit(last)


def event_bus_lag(bus: DataFrame) -> DataFrame:
    return bus.groupBy("source_service", "target_service").agg(
        F.count_if(F.col("state") == "pending").alias("pending"),
        F.count_if(F.col("state") == "processed").alias("processed"),
        F.max("wait_s").cast("double").alias("max_wait_s"),
        ratio(F.sum("wait_s"), F.count("wait_s")).alias("avg_wait_s"),
    )


def error_rate_by_window(events: DataFrame, ts: str, width: str, failed: Column, limit: float) -> DataFrame:
    """Windows whose share of failures is above ``limit``."""
    return (
        events.groupBy(F.window(ts, width).alias("w"))
        .agg(F.count("*").alias("total"), F.count_if(failed).alias("failed"))
        .withColumn("error_rate", ratio(F.col("failed"), F.col("total")))
        .where(F.col("error_rate") > limit)
        .select(F.col("w.start").alias("window_start"), "total", "failed", "error_rate")
    )


def event_sourced_state(events: DataFrame, entity: str, ts: str, ident: str, fields: Sequence[str]) -> DataFrame:
    """Latest state of each entity and how many events built it."""
    newest = F.max_by(F.struct(ts, *fields), F.struct(ts, ident))
    return events.groupBy(entity).agg(newest.alias("s"), F.count("*").alias("version")).select(entity, "s.*", "version")
