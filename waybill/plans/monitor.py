"""Query log, credits, metrics, health and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from waybill.operators import monitor, sketches
from waybill.plans.registry import query
from waybill.plans.tables import AS_OF_EVENTS, events_ts

CREDITS = "coalesce(CAST(sum(compute_centi * 10 + cloud_milli) AS DOUBLE) / 1000.0::DOUBLE, 0.0::DOUBLE)"


@query("slow_queries", "SELECT query_id, warehouse, CAST(exec_s AS DOUBLE) AS exec_s FROM {query_log} WHERE exec_s > 224")
def _(t):
    return monitor.slow_queries(t.query_log, 224).select("query_id", "warehouse", F.col("exec_s").cast("double").alias("exec_s"))


LOG_AGGS = f"""count(*) AS total_queries, count(*) FILTER (status = 'SUCCESS') AS succeeded, count(*) FILTER (status <> 'SUCCESS') AS failed,
    CAST(sum(exec_s) AS DOUBLE) / count(*) AS avg_exec_s, CAST(max(exec_s) AS DOUBLE) AS max_exec_s, CAST(sum(scanned_bytes) AS BIGINT) AS bytes_scanned, {CREDITS} AS credits"""


@query("query_log_summary", f"""SELECT {LOG_AGGS}, CAST(sum(scanned_bytes) AS DOUBLE) / count(*) AS avg_bytes,
    CAST(count(*) FILTER (status = 'SUCCESS') AS DOUBLE) / count(*) * 100.0::DOUBLE AS success_rate FROM {{query_log}}""")
def _(t):
    return monitor.query_log_summary(t.query_log)


@query("warehouse_summary", f"""
    WITH w AS (SELECT warehouse, CASE warehouse WHEN 'WH_0' THEN 'X-SMALL' WHEN 'WH_1' THEN 'SMALL' WHEN 'WH_2' THEN 'MEDIUM' WHEN 'WH_3' THEN 'LARGE' ELSE 'UNKNOWN' END AS size,
                      CASE warehouse WHEN 'WH_4' THEN 'SUSPENDED' ELSE 'RUNNING' END AS state, count(*) FILTER (event_id % 50 = 0) AS running,
                      count(*) FILTER (event_id % 50 = 1) AS queued, {CREDITS} AS credits FROM {{query_log}} GROUP BY 1)
    SELECT count(*) AS total_warehouses, count(*) FILTER (state = 'RUNNING') AS active_warehouses, CAST(sum(running) AS BIGINT) AS running_queries,
           CAST(sum(queued) AS BIGINT) AS queued_queries,
           floor(avg(CASE WHEN state = 'RUNNING' THEN CAST(running AS DOUBLE) / CASE size WHEN 'SMALL' THEN 16 WHEN 'MEDIUM' THEN 32 WHEN 'LARGE' THEN 64 ELSE 8 END ELSE 0.0::DOUBLE END) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS avg_utilization,
           floor(sum(credits) / 720.0::DOUBLE * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS credits_per_hour
    FROM w""")
def _(t):
    status = monitor.warehouse_status(
        t.query_log,
        running=F.col("event_id") % 50 == 0,
        queued=F.col("event_id") % 50 == 1,
        sizes={"WH_0": "X-SMALL", "WH_1": "SMALL", "WH_2": "MEDIUM", "WH_3": "LARGE"},
        states={"WH_4": "SUSPENDED"},
    )
    return monitor.warehouse_summary(status, hours=720.0)


@query("credit_usage_daily", f"""
    SELECT warehouse, CAST(start_time AS DATE) AS day, CAST(sum(compute_centi) AS DOUBLE) / 100.0::DOUBLE AS compute_credits,
           CAST(sum(cloud_milli) AS DOUBLE) / 1000.0::DOUBLE AS cloud_credits, {CREDITS} AS total_credits, count(*) AS query_count, {CREDITS} / count(*) AS credits_per_query
    FROM {{query_log}} WHERE start_time >= {AS_OF_EVENTS} - INTERVAL 7 DAY AND start_time < {AS_OF_EVENTS} GROUP BY 1, 2""")
def _(t):
    return monitor.credit_usage_daily(t.query_log, events_ts())


@query("credit_projection", f"""
    WITH s AS (SELECT {CREDITS} AS total_credits, count(DISTINCT CAST(start_time AS DATE)) AS days FROM {{query_log}})
    SELECT total_credits, days, total_credits / days AS daily_average, total_credits / days * 30.0::DOUBLE AS projected_month,
           total_credits / days * 30.0::DOUBLE / 5000.0::DOUBLE * 100.0::DOUBLE AS budget_used FROM s""")
def _(t):
    return monitor.credit_projection(t.query_log, 5000.0)


@query("warehouse_recommendations", f"""
    WITH w AS (SELECT warehouse, CAST(sum(queue_s) AS DOUBLE) / count(*) AS avg_queue_s, CAST(sum(exec_s) AS DOUBLE) / count(*) AS avg_exec_s, {CREDITS} AS credits FROM {{query_log}} GROUP BY 1),
    r AS (SELECT *, CASE WHEN avg_queue_s > 29.5 THEN 'scale up' WHEN avg_exec_s < 49 AND credits > 10 THEN 'scale down' END AS recommendation FROM w)
    SELECT * FROM r WHERE recommendation IS NOT NULL""")
def _(t):
    return monitor.warehouse_recommendations(t.query_log, 29.5, 49.0, 10.0)


BOUNDS = {"default": monitor.DEFAULT_BOUNDS, "deployment": monitor.DEPLOYMENT_BOUNDS, "query": monitor.QUERY_BOUNDS}


@query("histogram_cumulative", " UNION ALL ".join(
    f"SELECT '{n}' AS histogram, '{'+Inf' if b is None else f'{float(b):g}'}' AS le, count(*) FILTER ({'true' if b is None else f'value <= {b}'}) AS bucket, "
    "CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS sum, count(*) AS count FROM events"
    for n, bs in BOUNDS.items() for b in [*bs, None]))
def _(t):
    return monitor.histogram_cumulative(t.events, "value", BOUNDS)


@query("latency_percentiles", """
    WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, count(*) AS operations, min(value) AS min_s, max(value) AS max_s, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_s,
           CAST(count(*) FILTER (value <= 200) AS DOUBLE) / count(*) * 100.0::DOUBLE AS success_percent, CAST(count(*) FILTER (NOT value <= 200) AS DOUBLE) / count(*) * 100.0::DOUBLE AS error_percent,
           CAST(count(*) AS DOUBLE) / CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS throughput,
           max(value) FILTER (pos = least(50 * n // 100, n - 1)) AS p50, max(value) FILTER (pos = least(95 * n // 100, n - 1)) AS p95, max(value) FILTER (pos = least(99 * n // 100, n - 1)) AS p99
    FROM r GROUP BY 1""")
def _(t):
    return monitor.latency_percentiles(t.events, "event_type", "value", F.col("value") <= 200)


POINTS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


@query("latency_percentiles_estimates", " UNION ALL ".join(
    f"SELECT event_type, '{name}' AS point, count(*) AS n, true AS within_error FROM events WHERE value IS NOT NULL GROUP BY 1" for name in POINTS
))
def _(t):
    """Sketches by day, merged to the whole; the share of rows up to an estimate is 2 % away from the point asked for at most."""
    days = sketches.quantile_sketches(t.events.withColumn("day", F.col("ts").cast("date")), ["event_type", "day"], "value")
    found = sketches.quantiles(sketches.merged_quantiles(days.drop("day"), ["event_type"]), POINTS)
    at = F.explode(F.array(*[F.struct(F.lit(n).alias("point"), F.lit(p).alias("share"), F.col(n).alias("value_at")) for n, p in POINTS.items()])).alias("q")
    asked = found.select("event_type", F.col("rows").alias("n"), at).select("event_type", "n", "q.*")
    ranks = t.events.join(F.broadcast(asked), "event_type").groupBy("event_type", "point", "n", "share").agg(  # a few rows per type of event
        F.count_if(F.col("value") < F.col("value_at")).alias("below"), F.count_if(F.col("value") <= F.col("value_at")).alias("upto")
    )
    close = (F.col("below") / F.col("n") - 0.02 <= F.col("share")) & (F.col("share") <= F.col("upto") / F.col("n") + 0.02)
    return ranks.select("event_type", "point", "n", close.alias("within_error"))


@query("metric_rollup", """
    SELECT event_type, arg_max(value, (ts, event_id)) AS last_value, count(*) AS count, min(value) AS min_value, max(value) AS max_value,
           CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean_value FROM events GROUP BY 1""")
def _(t):
    return monitor.metric_rollup(t.events, "event_type", "ts", "event_id", "value")


@query("batch_throughput", """
    SELECT count(*) AS batches, CAST(sum(rows_loaded) AS BIGINT) AS statements, CAST(sum(rows_loaded) * 30 AS BIGINT) AS bytes, count(*) FILTER (ok) AS succeeded,
           count(*) FILTER (NOT ok) AS failed, CAST(sum(rows_loaded) AS DOUBLE) / count(*) AS avg_batch_size, CAST(sum(seconds) AS DOUBLE) / count(*) AS avg_seconds,
           CAST(sum(rows_loaded) AS DOUBLE) / CAST(sum(seconds) AS DOUBLE) AS throughput FROM {load_log}""")
def _(t):
    return monitor.batch_throughput(t.load_log, 30)


@query("load_rate", "SELECT CAST(sum(rows_loaded) AS DOUBLE) / CAST(sum(seconds) AS DOUBLE) AS rows_per_second FROM {load_log}")
def _(t):
    return monitor.load_rate(t.load_log)


@query("usage_stats", """
    SELECT 'command' AS category, event_type AS name, count(*) AS n FROM events GROUP BY 2
    UNION ALL SELECT 'deployment', CASE WHEN event_type = 'purchase' THEN 'ok' ELSE 'failed' END, count(*) FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 2
    UNION ALL SELECT 'os', 'os_' || user_id % 3, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'version', 'v' || user_id % 5, count(*) FROM events GROUP BY 2
    UNION ALL SELECT 'users', 'unique', count(DISTINCT user_id) FROM events UNION ALL SELECT 'events', 'total', count(*) FROM events""")
def _(t):
    kind = F.col("event_type")
    parts = {
        "command": kind,
        "deployment": F.when(kind == "purchase", "ok").when(kind == "error", "failed"),
        "os": F.concat(F.lit("os_"), F.col("user_id") % 3),
        "version": F.concat(F.lit("v"), F.col("user_id") % 5),
    }
    return monitor.usage_stats(t.events, parts, "user_id")


@query("error_rate", """
    SELECT count(*) AS total, count(*) FILTER (event_type = 'error') AS failed, CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) / count(*) AS error_rate,
           (1.0::DOUBLE - CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) / count(*)) * 100.0::DOUBLE AS success_percent FROM events""")
def _(t):
    return monitor.error_rate(t.events, F.col("event_type") == "error")


@query("error_summary", """
    SELECT 'severity' AS section, severity AS name, count(*) AS n FROM {error_log} GROUP BY 2 UNION ALL SELECT 'code', code, count(*) FROM {error_log} GROUP BY 2
    UNION ALL SELECT 'total', 'all', count(*) FROM {error_log}
    UNION ALL SELECT * FROM (SELECT 'recent', message, event_id FROM {error_log} ORDER BY ts DESC, event_id DESC LIMIT 10)""")
def _(t):
    return monitor.error_summary(t.error_log)


@query("deployment_kpis", f"""
    SELECT 'success_rate' AS panel, '' AS label, '' AS detail, CAST(count(*) FILTER (state = 'completed') AS DOUBLE) / count(*) AS value FROM {{deployments}}
    UNION ALL SELECT 'mean_minutes', database_name, '', CAST(sum(minutes) AS DOUBLE) / count(*) FROM {{deployments}} GROUP BY 2
    UNION ALL SELECT 'failures', database_name, error_code, CAST(count(*) AS DOUBLE) FROM {{deployments}} WHERE state = 'failed' GROUP BY 2, 3
    UNION ALL SELECT 'credits', warehouse, '', {CREDITS} FROM {{query_log}} WHERE start_time >= {AS_OF_EVENTS} - INTERVAL 6 HOUR GROUP BY 2""")
def _(t):
    return monitor.deployment_kpis(t.deployments, t.query_log, events_ts())


@query("health_rollup", """
    SELECT CAST(ts AS DATE) AS day, CASE WHEN count(*) FILTER (status = 'DOWN') > 0 THEN 'DOWN' WHEN count(*) FILTER (status = 'DEGRADED') > 0 THEN 'DEGRADED'
           WHEN count(*) FILTER (status = 'UNKNOWN') > 0 THEN 'UNKNOWN' ELSE 'UP' END AS status, count(*) AS checks FROM {health_log} GROUP BY 1""")
def _(t):
    return monitor.health_rollup(t.health_log, [F.col("ts").cast("date").alias("day")])


@query("metric_history_tail", """
    WITH r AS (SELECT event_type, ts, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events)
    SELECT event_type, ts, event_id, value FROM r WHERE n <= 100 AND ts >= TIMESTAMP '2024-01-30 06:00:00'""")
def _(t):
    points = t.events.select("event_type", "ts", "event_id", "value")
    return monitor.metric_history_tail(points, "event_type", "ts", "event_id", F.expr("TIMESTAMP_NTZ '2024-01-30 06:00:00'"))


@query("recent_mean", """
    WITH r AS (SELECT event_type AS hook, user_id % 5 AS plugin, value, row_number() OVER (PARTITION BY event_type, user_id % 5 ORDER BY ts DESC, event_id DESC) AS n FROM events)
    SELECT hook, plugin, count(*) AS points, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean_s FROM r WHERE n <= 100 GROUP BY 1, 2""")
def _(t):
    timings = t.events.select(F.col("event_type").alias("hook"), (F.col("user_id") % 5).alias("plugin"), "ts", "event_id", "value")
    return monitor.recent_mean(timings, ["hook", "plugin"], "ts", "event_id", "value")


ALERTS = """a AS (
    SELECT 'slow_query_' || query_id AS alert_id, 'SLOW_QUERY' AS alert_type, 'WARNING' AS severity, event_id, start_time, warehouse FROM {query_log} WHERE exec_s > 224
    UNION ALL SELECT 'queue_time_' || query_id, 'LONG_QUEUE', 'WARNING', event_id, start_time, warehouse FROM {query_log} WHERE queue_s > 30
    UNION ALL SELECT 'spillage_' || query_id, 'MEMORY_SPILLAGE', 'CRITICAL', event_id, start_time, warehouse FROM {query_log} WHERE spill_bytes > 1073741824)"""


def alerts(t):
    return monitor.alerts_threshold(t.query_log, slow_s=224)


@query("alerts_threshold", f"WITH {ALERTS} SELECT * FROM a")
def _(t):
    return alerts(t)


@query("custom_alert_rule", f"""WITH {ALERTS} SELECT * FROM a
    UNION ALL SELECT 'big_scan_' || query_id, 'BIG_SCAN', 'INFO', event_id, start_time, warehouse FROM {{query_log}} WHERE scanned_bytes > 1000000000""")
def _(t):
    own = ("big_scan", "BIG_SCAN", "INFO", F.col("scanned_bytes") > 1_000_000_000)
    return monitor.alerts_threshold(t.query_log, slow_s=224, rules=[own])


@query("recent_alerts", f"WITH {ALERTS} SELECT * FROM a ORDER BY start_time DESC, event_id DESC, alert_type LIMIT 10")
def _(t):
    return monitor.recent_alerts(alerts(t))


@query("event_bus_lag", """
    SELECT source_service, target_service, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'processed') AS processed,
           CAST(max(wait_s) AS DOUBLE) AS max_wait_s, coalesce(CAST(sum(wait_s) AS DOUBLE) / nullif(count(wait_s), 0), 0.0::DOUBLE) AS avg_wait_s FROM {event_bus} GROUP BY 1, 2""")
def _(t):
    return monitor.event_bus_lag(t.event_bus)


@query("error_rate_alert", """
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS total, count(*) FILTER (event_type = 'error') AS failed,
           CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) / count(*) AS error_rate
    FROM events GROUP BY 1 HAVING CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) / count(*) > 0.1""")
def _(t):
    return monitor.error_rate_by_window(t.events, "ts", "1 hour", F.col("event_type") == "error", 0.1)


@query("event_sourced_state", """
    SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value, count(*) AS version FROM events GROUP BY 1""")
def _(t):
    return monitor.event_sourced_state(t.events, "user_id", "ts", "event_id", ["event_type", "value"])
