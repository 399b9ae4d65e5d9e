"""Streaming jobs over the events table as a file stream, and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from waybill.operators import cooldown, monitor, sketches, windows
from waybill.plans.monitor import ALERTS, CREDITS, LOG_AGGS
from waybill.plans.registry import query
from waybill.plans.tables import DERIVED, _dialect
from waybill.session import fresh_dir
from waybill.streaming import jobs
from waybill.streaming.runner import file_stream


DELIVERIES = 3


def _deliveries(table):
    """The delivery of a row by the quantiles of the table's own times."""
    kind, steps = table.schema["ts"].dataType, [k / DELIVERIES for k in range(1, DELIVERIES)]
    ends = table.agg(F.percentile_approx("ts", steps, 1000).cast("array<string>")).first()[0] or []
    return sum((F.coalesce(F.col("ts") > F.lit(end).cast(kind), F.lit(False)).cast("int") for end in ends), F.lit(0))


def delivered(t, table, job, cut=None):
    """Run a job each time another part of a table has been delivered as files; the result after the last run.

    ``cut`` gives the delivery of a row; without it rows are dealt in the order of their times, as many to each; those without a time come first.
    """
    root = fresh_dir(t.spark, "stream")
    cut = _deliveries(table) if cut is None else cut
    for i in range(DELIVERIES):
        table.where(cut == i).write.mode("append").parquet(f"{root}/in")
        result = job(file_stream(t.spark, f"{root}/in", table.schema), f"{root}/job")
    return result


def _log(t, events):
    """The query log over a stream of events."""
    return t.spark.sql(_dialect(DERIVED["query_log"], 0), events=events)


SLIDING = f"""
    WITH x AS (SELECT *, unnest([0, 1, 2, 3, 4]) AS back FROM {{query_log}})
    SELECT time_bucket(INTERVAL 1 MINUTE, start_time) - INTERVAL 1 MINUTE * back AS window_start, {LOG_AGGS} FROM x GROUP BY 1"""


@query("query_metrics_sliding", SLIDING)
def _(t):
    return delivered(t, t.events, lambda events, root: jobs.sliding_query_metrics(_log(t, events), root))


@query("query_metrics_sliding_batch", f"""SELECT window_start, total_queries, succeeded, avg_exec_s, max_exec_s, bytes_scanned, credits FROM ({SLIDING.strip()})""")
def _(t):
    return windows.query_metrics_sliding(t.query_log)


TUMBLING = f"SELECT time_bucket(INTERVAL 1 DAY, start_time) AS window_start, warehouse, {CREDITS} AS credits, count(*) AS query_count FROM {{query_log}} GROUP BY 1, 2"


@query("credits_tumbling", TUMBLING)
def _(t):
    return delivered(t, t.events, lambda events, root: jobs.tumbling_credits(_log(t, events), root))


@query("credits_tumbling_batch", TUMBLING)
def _(t):
    return windows.credits_tumbling(t.query_log)


@query("stream_sessions", """
    WITH m AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 360 MINUTE THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM m)
    SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS events_count, count(*) FILTER (event_type = 'view') AS page_views,
           count(*) FILTER (event_type = 'purchase') > 0 AS conversion
    FROM n GROUP BY user_id, s HAVING max(ts) + INTERVAL 360 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 HOUR""")
def _(t):
    return delivered(t, t.events, lambda events, root: jobs.closed_sessions(events, root, "360 minutes", "1 hour"))


@query("watermark_retention", """
    WITH a AS (SELECT ts, least(3, greatest(0, date_diff('day', DATE '2024-01-01', CAST(CASE WHEN event_id % 200 = 0 THEN ts + INTERVAL 30 HOUR ELSE ts END AS DATE)) // 8)) AS step FROM events),
    m AS (SELECT step, max(max(ts)) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 24 HOUR AS mark FROM a GROUP BY step)
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n FROM a JOIN m USING (step)
    WHERE mark IS NULL OR time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR > mark GROUP BY 1""")
def _(t):
    root = fresh_dir(t.spark, "late")
    late = F.expr("INTERVAL '30' HOUR")
    arrival = F.when(F.col("event_id") % 200 == 0, F.col("ts") + late).otherwise(F.col("ts"))
    step = F.least(F.lit(3), F.greatest(F.lit(0), F.floor(F.datediff(arrival, F.expr("DATE '2024-01-01'")) / 8))).cast("int")
    arriving = t.events.withColumn("step", step)
    for i in range(4):  # files arrive in four deliveries; some rows are 30 hours late
        arriving.where(F.col("step") == i).drop("step").write.mode("append").parquet(f"{root}/arrivals")
        stream = file_stream(t.spark, f"{root}/arrivals", t.events.schema)
        counts, _ = jobs.hourly_counts_with_retention(stream, f"{root}/job")
    return counts


@query("stream_insert", "SELECT * FROM events")
def _(t):
    return delivered(t, t.events, jobs.stream_insert)


@query("pipe_ingest", """
    SELECT event_id, ts, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CASE WHEN event_id % 50 = 7 THEN 'rejected' ELSE 'loaded' END AS outcome
    FROM (SELECT CASE WHEN event_id % 50 = 7 THEN NULL ELSE event_id END AS event_id, CASE WHEN event_id % 50 = 7 THEN NULL ELSE ts END AS ts,
                 CASE WHEN event_id % 50 = 7 THEN NULL ELSE event_type END AS event_type, CASE WHEN event_id % 50 = 7 THEN NULL ELSE props END AS props, event_id AS e FROM events)
    WHERE e % 50 <> 7
    UNION ALL SELECT event_id, NULL, NULL, NULL, 'rejected' FROM events WHERE event_id % 50 = 7""")
def _(t):
    root = fresh_dir(t.spark, "pipe")
    line = F.concat(
        F.lit('{"event_id":'), F.col("event_id"), F.lit(',"ts":"'), F.col("ts").cast("string"), F.lit('","event_type":"'), F.col("event_type"),
        F.lit('","properties":'), F.col("props"), F.lit("}"),
    )
    broken = F.concat(F.lit("{broken "), F.col("event_id"))
    t.events.select(F.when(F.col("event_id") % 50 == 7, broken).otherwise(line).alias("value")).write.text(f"{root}/in")
    lines = t.spark.readStream.text(f"{root}/in")
    fields = {
        "event_id": ("$.event_id", "bigint"),
        "ts": ("$.ts", "timestamp_ntz"),
        "event_type": ("$.event_type", "string"),
        "k": ("$.properties.k", "int"),
    }
    loaded, rejected = jobs.pipe_ingest(lines, f"{root}/job", fields, ["event_id", "ts"])
    bad = rejected.select(
        F.regexp_extract("value", r"(\d+)", 1).cast("long").alias("event_id"), F.lit(None).cast("timestamp_ntz").alias("ts"),
        F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("int").alias("k"), F.lit("rejected").alias("outcome"),
    )
    return loaded.withColumn("outcome", F.lit("loaded")).unionByName(bad)


COOLDOWN = f"""WITH RECURSIVE {ALERTS},
    o AS (SELECT alert_type, start_time, min(event_id) AS event_id FROM a GROUP BY 1, 2),
    f AS (SELECT alert_type, min(start_time) AS start_time FROM o GROUP BY 1
          UNION ALL
          SELECT f.alert_type, min(o.start_time) FROM f JOIN o ON o.alert_type = f.alert_type AND o.start_time >= f.start_time + INTERVAL 6 HOUR GROUP BY f.alert_type)
    SELECT f.alert_type, f.start_time, o.event_id FROM f JOIN o ON o.alert_type = f.alert_type AND o.start_time = f.start_time"""


@query("alert_cooldown", COOLDOWN)
def _(t):
    alerts = monitor.alerts_threshold(t.query_log, slow_s=224)
    return cooldown.cooldown_fires(alerts, "alert_type", "start_time", "event_id", 6 * 3600)


@query("alert_cooldown_stream", COOLDOWN)
def _(t):
    def job(events, root):
        alerts = monitor.alerts_threshold(_log(t, events), slow_s=224)
        return jobs.cooldown_alerts(alerts, root, "alert_type", "start_time", "event_id", 6 * 3600)

    return delivered(t, t.events, job)


@query("error_rate_alert_stream", """
    SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS total, count(*) FILTER (event_type = 'error') AS failed,
           CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) / count(*) AS error_rate
    FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'error') > 0.2 * count(*)""")
def _(t):
    failed = F.col("event_type") == "error"
    return delivered(t, t.events, lambda events, root: jobs.error_rate_windows(events, root, "ts", "1 day", failed, 0.2))


@query("cdc_feed", """
    WITH f AS (SELECT o_orderkey % 5000 AS k, o_orderkey AS seq, o_totalprice AS v, CASE WHEN o_orderkey % 7 = 0 THEN 'delete' ELSE 'update' END AS change,
                      o_orderkey % 3 AS delivery FROM orders),
    l AS (SELECT k, arg_max(v, (delivery, seq)) AS v, arg_max(change, (delivery, seq)) AS change FROM f GROUP BY k)
    SELECT coalesce(l.k, c_custkey) AS k, coalesce(l.v, c_acctbal) AS v FROM l FULL JOIN customer ON c_custkey = l.k WHERE change IS NULL OR change = 'update'""")
def _(t):
    feed = t.orders.select(
        (F.col("o_orderkey") % 5000).alias("k"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("v"),
        F.when(F.col("o_orderkey") % 7 == 0, "delete").otherwise("update").alias("change"), (F.col("o_orderkey") % 3).alias("delivery"),
    )
    base = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return delivered(t, feed, lambda changes, root: jobs.apply_changes(changes.drop("delivery"), base, "k", root), F.col("delivery"))


@query("running_metric_state", """
    SELECT event_type, count(*) AS count, min(value) AS min_value, max(value) AS max_value, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean_value FROM events GROUP BY 1""")
def _(t):
    return delivered(t, t.events, lambda events, root: jobs.running_metrics(events, root, "event_type", "value"))


@query("heartbeat_dedup", "SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events")
def _(t):
    return delivered(t, t.events, lambda events, root: jobs.daily_heartbeats(events, root, "user_id", "ts"))


@query("heartbeat_24h", """
    WITH RECURSIVE o AS (SELECT user_id, ts, min(event_id) AS event_id FROM events GROUP BY 1, 2),
    f AS (SELECT user_id, min(ts) AS ts FROM o GROUP BY 1
          UNION ALL
          SELECT f.user_id, min(o.ts) FROM f JOIN o ON o.user_id = f.user_id AND o.ts >= f.ts + INTERVAL 24 HOUR GROUP BY f.user_id)
    SELECT f.user_id, f.ts, o.event_id FROM f JOIN o ON o.user_id = f.user_id AND o.ts = f.ts""")
def _(t):
    return delivered(t, t.events, lambda events, root: jobs.heartbeats(events, root, "user_id", "ts", "event_id"))


@query("heartbeat_24h_batch", """
    WITH RECURSIVE o AS (SELECT user_id, ts, min(event_id) AS event_id FROM events GROUP BY 1, 2),
    f AS (SELECT user_id, min(ts) AS ts FROM o GROUP BY 1
          UNION ALL
          SELECT f.user_id, min(o.ts) FROM f JOIN o ON o.user_id = f.user_id AND o.ts >= f.ts + INTERVAL 24 HOUR GROUP BY f.user_id)
    SELECT f.user_id, f.ts, o.event_id FROM f JOIN o ON o.user_id = f.user_id AND o.ts = f.ts""")
def _(t):
    return cooldown.cooldown_fires(t.events, "user_id", "ts", "event_id", 24 * 3600)


@query("heartbeat_dedup_batch", """
    SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2""")
def _(t):
    return windows.heartbeats_by_day(t.events, "user_id", "ts", "event_id")


USERS = "SELECT '{0}' AS period, date_trunc('{0}', ts)::TIMESTAMP AS period_start, count(*) AS n, true AS within_error FROM events GROUP BY ALL"


@query("active_users_stream", " UNION ALL ".join(USERS.format(p) for p in ("day", "week", "month")))
def _(t):
    """Sketches of days from a stream, merged to weeks and months; the estimates are held against exact counts, 3 standard errors apart at most."""
    days = delivered(t, t.events, lambda events, root: jobs.active_user_sketches(events, root, "user_id", "ts"))
    parts = []
    for period in ("day", "week", "month"):
        start = F.date_trunc(period, F.col("window_start")).cast("timestamp_ntz").alias("period_start")
        found = sketches.estimated(sketches.merged(days.select(start, "rows", "sketch"), ["period_start"]), "users")
        exact = t.events.groupBy(F.date_trunc(period, F.col("ts")).cast("timestamp_ntz").alias("period_start")).agg(F.countDistinct("user_id").alias("exact"))
        close = F.abs(F.col("users") - F.col("exact")) <= F.greatest(F.lit(1), 3 * 1.04 / 2 ** (sketches.LG / 2) * F.col("exact"))
        parts.append(found.join(exact, "period_start").select(F.lit(period).alias("period"), "period_start", F.col("rows").alias("n"), close.alias("within_error")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("active_users_window", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(DISTINCT user_id) AS active_users FROM events GROUP BY 1")
def _(t):
    return windows.active_users(t.events, "ts", "user_id")
