"""Deployment history, recovery points, journeys and type-2 history."""

from __future__ import annotations

from pyspark.sql import functions as F

from waybill.operators import history
from waybill.operators.ordered import ordered_by_key
from waybill.plans.registry import query

SCHEMA = ["database_name", "schema_name"]


@query("journey_steps", """
    SELECT event_id, user_id, ts, event_type, row_number() OVER w AS step_no, coalesce(date_sub('second', lag(ts) OVER w, ts), 0) AS seconds_since_previous
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def _(t):
    steps = t.events.select("event_id", "user_id", "ts", "event_type", F.lit(1).cast("long").alias("one"))
    seen = ordered_by_key(steps, ["user_id"], ["ts", "event_id"], lag={"before": "ts"}, running={"step_no": "one"})
    since = F.coalesce(F.timestamp_diff("SECOND", F.col("before"), F.col("ts")), F.lit(0).cast("long"))
    return seen.select("event_id", "user_id", "ts", "event_type", "step_no", since.alias("seconds_since_previous"))


@query("previous_deployment", """
    SELECT deployment_id, database_name, schema_name, started_at, lag(deployment_id) OVER (PARTITION BY database_name, schema_name ORDER BY started_at, deployment_id) AS previous_id FROM {deployments}""")
def _(t):
    records = t.deployments.select("deployment_id", *SCHEMA, "started_at")
    return history.previous_record(records, SCHEMA, "started_at", "deployment_id")


@query("latest_success", """
    SELECT database_name, schema_name, max(started_at) AS started_at, arg_max(deployment_id, (started_at, deployment_id)) AS deployment_id
    FROM {deployments} WHERE state = 'completed' GROUP BY 1, 2""")
def _(t):
    done = t.deployments.where("state = 'completed'").select(*SCHEMA, "started_at", "deployment_id")
    return history.latest_record(done, SCHEMA, "started_at", "deployment_id")


@query("retention_prune", """
    WITH y AS (SELECT *, row_number() OVER (PARTITION BY database_name, schema_name ORDER BY started_at DESC, deployment_id DESC) AS n FROM {deployments} WHERE started_at >= TIMESTAMP '1999-01-01')
    SELECT deployment_id, database_name, schema_name, started_at, state FROM y WHERE n <= 100""")
def _(t):
    records = t.deployments.select("deployment_id", *SCHEMA, "started_at", "state")
    return history.retention_prune(records, SCHEMA, "started_at", "deployment_id", F.expr("TIMESTAMP_NTZ '1999-01-01 00:00:00'"))


@query("history_newest", """
    SELECT deployment_id, started_at, state FROM {deployments} WHERE database_name = 'DB_1' AND schema_name = 'S_0' ORDER BY started_at DESC, deployment_id DESC LIMIT 20""")
def _(t):
    records = t.deployments.select("deployment_id", "started_at", "state", *SCHEMA)
    found = history.event_search(records, "started_at", "deployment_id", equal={"database_name": "DB_1", "schema_name": "S_0"}, limit=20)
    return found.drop(*SCHEMA)


@query("recovery_point_asof", """
    WITH p AS (SELECT o_custkey % 6 AS k, o_orderdate AS ts, o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'),
    r AS (SELECT o_custkey % 6 AS k, o_orderdate AS ts, o_orderkey AS id FROM orders WHERE o_orderstatus = 'O'),
    u AS (SELECT k, ts, id, 0 AS kind FROM p UNION ALL SELECT k, ts, id, 1 FROM r),
    f AS (SELECT *, max(CASE WHEN kind = 0 THEN (ts, id) END) OVER (PARTITION BY k ORDER BY ts RANGE UNBOUNDED PRECEDING) AS best FROM u)
    SELECT id AS request_id, k AS point_key, ts AS request_ts, best[2] AS point_id, best[1] AS point_ts FROM f WHERE kind = 1""")
def _(t):
    def side(status):
        return t.orders.where(F.col("o_orderstatus") == status).select(
            (F.col("o_custkey") % 6).alias("point_key"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("id")
        )

    return history.recovery_point_asof(side("O"), side("F"), "point_key", "ts", "id")


@query("scd2_customer", """
    SELECT c_custkey || '-' || effective_date AS customer_key, c_custkey, c_name, c_mktsegment, effective_date,
           lead(effective_date) OVER w AS expiration_date, lead(effective_date) OVER w IS NULL AS is_current
    FROM {customer_changes} WINDOW w AS (PARTITION BY c_custkey ORDER BY effective_date)""")
def _(t):
    seen = ordered_by_key(t.customer_changes, ["c_custkey"], ["effective_date"], lead={"expiration_date": "effective_date"})
    key = F.concat(F.col("c_custkey").cast("string"), F.lit("-"), F.col("effective_date").cast("string"))
    return seen.select(
        key.alias("customer_key"), "c_custkey", "c_name", "c_mktsegment", "effective_date", "expiration_date",
        F.col("expiration_date").isNull().alias("is_current"),
    )


@query("deployment_chain", """
    SELECT deployment_id, first_value(deployment_id) OVER w AS root, row_number() OVER w - 1 AS depth, 'ok' AS status
    FROM {deployments} WINDOW w AS (PARTITION BY chain_key ORDER BY started_at, deployment_id)""")
def _(t):
    records = t.deployments.select("deployment_id", "chain_key", "started_at")
    linked = history.previous_record(records, ["chain_key"], "started_at", "deployment_id")
    return history.chain_depths(linked, "deployment_id", "previous_id")


@query("rollback_candidates", """
    WITH done AS (SELECT database_name, schema_name, arg_max(deployment_id, (started_at, deployment_id)) AS latest
                  FROM {deployments} WHERE state = 'completed' GROUP BY ALL),
    f AS (SELECT deployment_id, count(*) AS affected_files FROM {deployment_files} GROUP BY 1)
    SELECT deployment_id, database_name, schema_name, state, true AS can_rollback,
           concat_ws('; ', CASE WHEN snapshot_id IS NULL THEN 'no snapshot' END, CASE WHEN latest <> deployment_id THEN 'schema modified since' END) AS warnings,
           CASE WHEN snapshot_id IS NOT NULL THEN 'snapshot' WHEN state = 'in_progress' THEN 'transaction' ELSE 'incremental' END AS strategy,
           coalesce(affected_files, 0) AS affected_files, count(*) OVER (PARTITION BY database_name, schema_name) AS deployments_in_schema
    FROM {deployments} LEFT JOIN done USING (database_name, schema_name) LEFT JOIN f USING (deployment_id)""")
def _(t):
    return history.rollback_candidates(t.deployments, t.deployment_files)
