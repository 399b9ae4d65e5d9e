"""Data quality, profiles and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from waybill.functions.numbers import price
from waybill.operators import quality, reconcile, sketches
from waybill.plans.registry import query
from waybill.sources import profile

STAR = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
# columns of the star tables as the checking SQL sees them: name -> Spark type
COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def _columns(table: str) -> list[tuple[str, str]]:
    return [tuple(c.split(" ")) for c in COLUMNS[table].split(", ")]


def _star(t):
    return {n: getattr(t, n) for n in STAR}


def _profile_sql() -> str:
    parts = []
    for table in STAR:
        for i, (c, kind) in enumerate(_columns(table), 1):
            shown = f"CAST(CAST({{f}}({c}) AS DECIMAL(38,2)) AS VARCHAR)" if kind == "double" else f"CAST({{f}}({c}) AS VARCHAR)"
            value = f"CAST({c} AS DECIMAL(38,2))" if kind == "double" else c
            parts.append(
                f"SELECT '{c}' AS column_name, '{table}' AS table_name, {i} AS position, '{kind}' AS data_type, true AS nullable, count(*) AS row_count, "
                f"count(*) FILTER ({c} IS NULL) AS nulls, {shown.replace('{f}', 'min')} AS min_value, {shown.replace('{f}', 'max')} AS max_value, "
                f"count(DISTINCT {value}) AS distinct_values FROM {table}"
            )
    return " UNION ALL ".join(parts)


@query("table_profile", _profile_sql())
def _(t):
    return profile.profiles(_star(t), exact_distinct=True)


def _bytes_sql() -> str:
    parts = []
    for table in STAR:
        texts = [c for c, kind in _columns(table) if kind == "string"]
        fixed = 8 * (len(_columns(table)) - len(texts))
        size = " + ".join([f"{fixed} * count(*)", *[f"coalesce(sum(octet_length(encode({c}))), 0)" for c in texts]])
        parts.append(f"SELECT '{table}' AS table_name, count(*) AS row_count, CAST({size} AS BIGINT) AS bytes FROM {table}")
    return " UNION ALL ".join(parts)


PROFILED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("table_profile_estimates", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) FILTER ({c} IS NULL) AS nulls, true AS within_error FROM {{orders_staged}}" for c in PROFILED
))
def _(t):
    """Estimates of one scan, held against exact counts, 3 standard errors apart at most."""
    table = t.orders_staged.select(*PROFILED)
    exact = table.agg(*[F.countDistinct(c).alias(c) for c in PROFILED])
    exact = exact.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("exact")) for c in PROFILED])).alias("e")).select("e.*")
    close = F.abs(F.col("distinct_estimate") - F.col("exact")) <= F.greatest(F.lit(1), 3 * 1.04 / 2 ** (sketches.LG / 2) * F.col("exact"))
    return sketches.profile_estimates(table).join(exact, "column_name").select("column_name", "rows", "nulls", close.alias("within_error"))


@query("readiness_rowstats", _bytes_sql())
def _(t):
    return profile.row_stats(_star(t))


@query("row_counts_union", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in STAR)
       + " UNION ALL SELECT 'orders_target', count(*) FROM {orders_target}")
def _(t):
    return quality.row_counts({**_star(t), "orders_target": t.orders_target})


@query("column_type_mismatch", """
    SELECT 'o_orderkey' AS column_name, 'string' AS staged_type, 'bigint' AS target_type, true AS mismatch, count(*) FILTER (TRY_CAST(o_orderkey AS BIGINT) IS NULL) AS unconvertible FROM {orders_staged}
    UNION ALL SELECT 'o_custkey', 'string', 'bigint', true, count(*) FILTER (TRY_CAST(o_custkey AS BIGINT) IS NULL) FROM {orders_staged}
    UNION ALL SELECT 'o_orderstatus', 'string', 'string', false, 0 FROM (SELECT count(*) FROM {orders_staged})
    UNION ALL SELECT 'o_totalprice', 'string', 'double', true, count(*) FILTER (o_totalprice = 'n/a') FROM {orders_staged}
    UNION ALL SELECT 'o_orderdate', 'string', 'timestamp_ntz', true, count(*) FILTER (o_orderdate IS NULL) FROM {orders_staged}
    UNION ALL SELECT 'o_orderpriority', 'string', 'string', false, 0 FROM (SELECT count(*) FROM {orders_staged})""")
def _(t):
    return profile.type_check(t.orders_staged, t.orders)


@query("dq_null_blank", """
    WITH n AS (SELECT count(*) AS n, count(*) FILTER (c_custkey IS NULL) AS n1, count(*) FILTER (c_name IS NULL) AS n2, count(*) FILTER (c_nationkey IS NULL) AS n3,
                      count(*) FILTER (c_acctbal IS NULL) AS n4, count(*) FILTER (c_mktsegment IS NULL) AS n5,
                      count(*) FILTER (trim(c_name) = '') AS b2, count(*) FILTER (trim(c_mktsegment) = '') AS b5 FROM {dirty_customer})
    SELECT 'c_custkey' AS column_name, n1 AS nulls, CAST(0 AS BIGINT) AS blanks, CAST(n - n1 AS DOUBLE) / n AS filled_ratio FROM n
    UNION ALL SELECT 'c_name', n2, b2, CAST(n - n2 AS DOUBLE) / n FROM n UNION ALL SELECT 'c_nationkey', n3, 0, CAST(n - n3 AS DOUBLE) / n FROM n
    UNION ALL SELECT 'c_acctbal', n4, 0, CAST(n - n4 AS DOUBLE) / n FROM n UNION ALL SELECT 'c_mktsegment', n5, b5, CAST(n - n5 AS DOUBLE) / n FROM n""")
def _(t):
    return quality.null_blank(t.dirty_customer)


REQUIRED = ["c_custkey", "c_name", "c_mktsegment"]


@query("dq_required", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, 'customer' AS table_name, count(*) FILTER ({c} IS NULL) AS null_count, count(*) FILTER ({c} IS NULL) = 0 AS passed FROM {{dirty_customer}}" for c in REQUIRED))
def _(t):
    return quality.required_nulls(t.dirty_customer, "customer", REQUIRED)


@query("required_nulls_union", " UNION ALL ".join(
    [f"SELECT 'customer' AS table_name, '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_count FROM {{dirty_customer}}" for c in REQUIRED]
    + [f"SELECT 'orders', '{c}', count(*) FILTER ({c} IS NULL) FROM {{orders_staged}}" for c in ("o_orderkey", "o_custkey")]))
def _(t):
    return (
        quality.required_nulls(t.dirty_customer, "customer", REQUIRED)
        .unionByName(quality.required_nulls(t.orders_staged, "orders", ["o_orderkey", "o_custkey"]))
        .select("table_name", "column_name", "null_count")
    )


@query("dq_row_count", """
    SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS source_rows, (SELECT count(*) FROM {orders_target}) AS target_rows,
           (SELECT count(*) FROM orders) = (SELECT count(*) FROM {orders_target}) AS passed""")
def _(t):
    return quality.count_check(t.orders, t.orders_target, "orders")


@query("check_fk_orphans", "SELECT o_custkey, count(*) AS orphan_rows FROM {orders_target} WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY 1")
def _(t):
    return quality.fk_orphans(t.orders_target, "o_custkey", t.customer, "c_custkey")


@query("dq_completeness", """
    SELECT count(*) AS source_keys, count(t.o_orderkey) AS present_keys, CAST(count(t.o_orderkey) AS DOUBLE) / count(*) AS present_ratio
    FROM orders s LEFT JOIN {orders_target} t ON s.o_orderkey = t.o_orderkey""")
def _(t):
    return quality.completeness(t.orders, t.orders_target, "o_orderkey")


COMPARED = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("dq_accuracy", " UNION ALL ".join(f"""
    SELECT '{c}' AS column_name, count(*) AS matched, count(*) FILTER (s.{c} IS NOT DISTINCT FROM t.{c}) AS equal,
           CAST(count(*) FILTER (s.{c} IS NOT DISTINCT FROM t.{c}) AS DOUBLE) / count(*) AS accuracy
    FROM orders s JOIN {{orders_target}} t ON s.o_orderkey = t.o_orderkey""" for c in COMPARED))
def _(t):
    return quality.accuracy(t.orders, t.orders_target, "o_orderkey", COMPARED)


@query("dq_business_rules", """
    WITH i AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS items, max(l_quantity) AS most, min(l_discount) AS least FROM lineitem GROUP BY 1),
    j AS (SELECT * FROM orders LEFT JOIN i ON o_orderkey = l_orderkey)
    SELECT 'total = sum(items)' AS rule, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS result, n AS failed_rows
    FROM (SELECT count(*) FILTER (NOT coalesce(CAST(o_totalprice AS DECIMAL(12,2)) = items, false)) AS n FROM j)
    UNION ALL SELECT 'price > 0', CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END, n FROM (SELECT count(*) FILTER (NOT coalesce(o_totalprice > 0, false)) AS n FROM j)
    UNION ALL SELECT 'quantity <= 50', CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END, n FROM (SELECT count(*) FILTER (NOT coalesce(most <= 50, false)) AS n FROM j)""")
def _(t):
    items = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(price("l_extendedprice")).alias("items"), F.max("l_quantity").alias("most")
    )
    joined = t.orders.join(items, "o_orderkey", "left")
    broken = lambda rule: F.count_if(~F.coalesce(rule, F.lit(False)))
    return quality.rule_report(
        joined,
        {
            "total = sum(items)": broken(price("o_totalprice") == F.col("items")),
            "price > 0": broken(F.col("o_totalprice") > 0),
            "quantity <= 50": broken(F.col("most") <= 50),
        },
    )


GATE = [
    quality.Rule("price set", "o_totalprice IS NOT NULL", "ERROR"),
    quality.Rule("no big orders", "o_totalprice < 400000", "WARNING"),
    quality.Rule("no partial", "o_orderstatus <> 'P'", "CRITICAL"),
    quality.Rule("never checked", "o_orderkey < 0", "ERROR", enabled=False),
]


@query("dq_gate", """
    WITH n AS (SELECT count(*) FILTER (o_totalprice IS NULL) AS a, count(*) FILTER (NOT o_totalprice < 400000) AS b, count(*) FILTER (NOT o_orderstatus <> 'P') AS c FROM orders),
    r AS (SELECT 'price set' AS rule, 'ERROR' AS severity, a AS failed_rows FROM n UNION ALL SELECT 'no big orders', 'WARNING', b FROM n UNION ALL SELECT 'no partial', 'CRITICAL', c FROM n)
    SELECT *, CASE WHEN failed_rows = 0 THEN 'PASS' ELSE 'FAILED' END AS result, failed_rows > 0 AND severity <> 'WARNING' AS stops FROM r""")
def _(t):
    return quality.rule_results(t.orders, GATE)


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return quality.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("latest_batch_per_table", """
    SELECT m.table_name, batch_id, status, rows_migrated, start_timestamp, end_timestamp, row_count AS source_rows
    FROM {migration_control} m JOIN {source_tables} s ON m.table_name = s.table_name
    WHERE batch_id = (SELECT max(batch_id) FROM {migration_control} x WHERE x.table_name = m.table_name)""")
def _(t):
    counts = t.source_tables.select("table_name", F.col("row_count").alias("source_rows"))
    return reconcile.latest_batch(t.migration_control).join(counts, "table_name")


@query("reconcile_row_counts", """
    WITH x AS (SELECT 'orders' AS table_name, count(*) AS row_count FROM {orders_target} UNION ALL SELECT 'customer', count(*) FROM {customers_extra}
               UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'orders_none', count(*) FROM orders WHERE o_orderkey < 0)
    SELECT s.table_name, s.row_count AS source_rows, x.row_count AS target_rows, s.row_count - x.row_count AS difference,
           CASE WHEN s.row_count = 0 THEN 0.0::DOUBLE ELSE floor(CAST(x.row_count AS DOUBLE) / s.row_count * 100.0::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE END AS match_percentage
    FROM {source_tables} s LEFT JOIN x ON s.table_name = x.table_name""")
def _(t):
    targets = {"orders": t.orders_target, "customer": t.customers_extra, "part": t.part, "orders_none": t.orders.where("o_orderkey < 0")}
    return reconcile.count_reconciliation(t.source_tables, quality.row_counts(targets))


SUMMARY = """
    WITH b AS (SELECT * FROM {migration_control} m WHERE batch_id = (SELECT max(batch_id) FROM {migration_control} x WHERE x.table_name = m.table_name)),
    r AS (SELECT b.table_name, b.status, rows_migrated, s.row_count AS source_rows, rows_migrated - s.row_count AS row_difference,
                 CASE WHEN s.row_count = 0 THEN 100.0::DOUBLE ELSE floor(CAST(rows_migrated AS DOUBLE) / s.row_count * 100.0::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE END AS completion_percentage,
                 start_timestamp, end_timestamp, date_sub('minute', start_timestamp, end_timestamp) AS duration_minutes
          FROM b JOIN {source_tables} s ON b.table_name = s.table_name)"""
ISSUES = """SELECT table_name, count(DISTINCT issue_type) AS issue_types, count(*) AS total_issues, CAST(sum(row_count) AS BIGINT) AS affected_rows,
                   max(discovered_at) AS last_discovered FROM {dq_issues} GROUP BY 1"""


@query("reconciliation_summary", SUMMARY + " SELECT * FROM r")
def _(t):
    return reconcile.reconciliation_summary(t.migration_control, t.source_tables)


@query("dq_summary", ISSUES)
def _(t):
    return reconcile.quality_summary(t.dq_issues)


@query("reconciliation_report", SUMMARY + f""", q AS ({ISSUES})
    SELECT '2024-02-05' AS report_date, r.*, total_issues, affected_rows AS quality_affected_rows FROM r LEFT JOIN q ON r.table_name = q.table_name""")
def _(t):
    return reconcile.reconciliation_report(t.migration_control, t.source_tables, t.dq_issues, "2024-02-05")


@query("migration_progress", """
    SELECT count(DISTINCT table_name) AS total_tables, count(DISTINCT table_name) FILTER (migration_status = 'completed') AS completed_tables,
           count(DISTINCT table_name) FILTER (migration_status = 'in_progress') AS in_progress_tables, count(DISTINCT table_name) FILTER (migration_status = 'pending') AS pending_tables,
           CAST(sum(CASE WHEN migration_status = 'completed' THEN row_count ELSE 0 END) AS BIGINT) AS total_rows_migrated,
           min(migration_started) AS migration_start_time, max(migration_completed) AS last_completion_time
    FROM {source_tables}""")
def _(t):
    return reconcile.migration_progress(t.source_tables)


@query("migration_impact", """
    WITH s AS (SELECT table_name, row_count * 1000 AS rows, row_count % 8 AS transforms, row_count % 4 AS dependencies FROM {source_tables}),
    a AS (SELECT count(*) AS tables, CAST(sum(rows) AS BIGINT) AS total_rows, count(*) FILTER (rows > 10000000) AS large_tables, count(*) FILTER (transforms > 5) AS complex_tables,
                 CAST(sum(dependencies) AS BIGINT) AS dependencies, CAST(sum(greatest(60, rows // 10000)) AS BIGINT) AS estimated_seconds FROM s),
    l AS (SELECT *, CASE WHEN large_tables > 3 OR total_rows > 100000000 THEN 'HIGH' WHEN large_tables > 0 OR total_rows > 10000000 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM a)
    SELECT *, concat_ws('; ', CASE WHEN large_tables > 0 THEN 'large tables' END, CASE WHEN complex_tables > 0 THEN 'complex transformations' END,
                        CASE WHEN dependencies > 10 THEN 'many dependencies' END, 'checkpoints off') AS risk_factors,
           concat_ws('; ', CASE WHEN risk_level = 'HIGH' THEN 'stream large tables; run at low traffic' END, CASE WHEN risk_level = 'MEDIUM' THEN 'watch progress' END,
                     CASE WHEN dependencies > 10 THEN 'split into phases' END, 'turn checkpoints on') AS recommendations
    FROM l""")
def _(t):
    stats = t.source_tables.select(
        "table_name",
        (F.col("row_count") * 1000).alias("rows"),
        (F.col("row_count") % 8).alias("transforms"),
        (F.col("row_count") % 4).alias("dependencies"),
    )
    return reconcile.migration_impact(stats, checkpoints=False, rollback=True)


@query("tables_function", """
    SELECT 'null_check' AS check_name, 'customer.c_name' AS subject, count(*) FILTER (c_name IS NULL) AS n FROM {dirty_customer}
    UNION ALL SELECT 'null_check', 'customer.c_mktsegment', count(*) FILTER (c_mktsegment IS NULL) FROM {dirty_customer}
    UNION ALL SELECT 'duplicates', 'lineitem', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
    UNION ALL SELECT 'unconvertible', 'orders.o_totalprice', count(*) FILTER (o_totalprice = 'n/a') FROM {orders_staged}
    UNION ALL SELECT 'row_difference', 'orders', (SELECT count(*) FROM orders) - (SELECT count(*) FROM {orders_target})""")
def _(t):
    def tagged(df, name, subject, n):
        return df.select(F.lit(name).alias("check_name"), subject.alias("subject"), n.alias("n"))

    nulls = quality.required_nulls(t.dirty_customer, "customer", ["c_name", "c_mktsegment"])
    again = quality.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"]).agg(F.count("*").alias("n"))
    types = profile.type_check(t.orders_staged, t.orders).where("unconvertible > 0")
    counts = quality.count_check(t.orders, t.orders_target, "orders")
    return (
        tagged(nulls, "null_check", F.concat_ws(".", "table_name", "column_name"), F.col("null_count"))
        .unionByName(tagged(again, "duplicates", F.lit("lineitem"), F.col("n")))
        .unionByName(tagged(types, "unconvertible", F.concat(F.lit("orders."), F.col("column_name")), F.col("unconvertible")))
        .unionByName(tagged(counts, "row_difference", F.lit("orders"), F.col("source_rows") - F.col("target_rows")))
    )
