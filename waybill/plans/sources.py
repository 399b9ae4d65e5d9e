"""Loads, exports, backups and staging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waybill.operators import monitor, rows, writes
from waybill.plans.registry import query
from waybill.session import fresh_dir
from waybill.sources import backup, bulk, export, hashtree


@query("table_copy", "SELECT * FROM orders")
def _(t):
    return writes.written(rows.full_table_copy(t.orders), fresh_dir(t.spark, "copy"))


@query("bulk_load", " UNION ALL ".join(f"SELECT '{f}' AS format, * FROM orders" for f in ("csv", "json", "orc", "parquet")))
def _(t):
    loaded = []
    for fmt in ("csv", "json", "orc", "parquet"):
        path = fresh_dir(t.spark, f"load-{fmt}")
        writer = t.orders.write.option("compression", "gzip" if fmt in ("csv", "json") else "zlib" if fmt == "orc" else "zstd")
        if fmt == "csv":
            writer = writer.options(sep="|", header=True, quote='"', escape="\\")
        writer.format(fmt).save(path)
        options = bulk.LoadOptions(field_delimiter="|", skip_header=True) if fmt == "csv" else bulk.LoadOptions()
        loaded.append(bulk.bulk_load(t.spark, path, fmt, t.orders.schema, options).select(F.lit(fmt).alias("format"), "*"))
    return reduce(DataFrame.unionByName, loaded)


NOTE = "chr(92) || '\"}, {[' || o_orderkey || chr(10)"


@query("bulk_load_json_array", f"SELECT *, {NOTE} AS note, o_orderkey % 3 AS depth FROM orders")
def _(t):
    """Orders as files of one array each, 20,000 keys to a file, with texts and inner objects full of braces and quotes."""
    path = fresh_dir(t.spark, "load-arrays")
    key = F.col("o_orderkey").cast("long")
    orders = t.orders.withColumn("note", F.expr(NOTE.replace("chr(92)", "char(92)").replace("chr(10)", "char(10)")))
    inner = F.struct((F.col("o_orderkey") % 3).alias("depth"), F.array(F.struct(F.lit("}]").alias("x"))).alias("list"))
    lines = orders.select(F.floor(key / 20000).alias("part"), key.alias("place"), F.to_json(F.struct(*orders.columns, inner.alias("inner"))).alias("value"))
    # brackets stand with the rows: as rows of a union they can get a task, and so a file, of their own
    order = Window.partitionBy("part").orderBy("place", "value")
    begin, end = (F.coalesce(step(F.lit(False)).over(order), F.lit(True)) for step in (F.lag, F.lead))
    text = F.concat(F.when(begin, "[\n ").otherwise(","), "value", F.when(end, "\n]").otherwise(""))
    rows = lines.select("part", "place", "value", text.alias("text"))
    rows.sortWithinPartitions("part", "place", "value").select("part", F.col("text").alias("value")).write.partitionBy("part").text(path)
    kinds = T.StructType([*t.orders.schema, T.StructField("note", T.StringType()), T.StructField("inner", T.StructType([T.StructField("depth", t.orders.schema["o_orderkey"].dataType)]))])
    loaded = bulk.bulk_load(t.spark, path, "json", kinds, bulk.LoadOptions(strip_outer_array=True))
    return loaded.select(*t.orders.columns, "note", F.col("inner.depth").alias("depth"))


def _staged_csv(t, name: str) -> str:
    """Orders as CSV text in one folder per batch: a price in fifty is unreadable, and some lines more have a wrong number of columns."""
    path = fresh_dir(t.spark, name)
    number = F.col("o_orderkey").cast("long")
    orders = t.orders_staged.withColumn("batch", number % 5)
    orders.hint("rebalance", F.col("batch")).write.partitionBy("batch").csv(path)
    columns = [c for c in orders.columns if c != "batch"]
    long = F.concat_ws(",", *columns, F.lit("EXTRA"))
    short = F.concat_ws(",", *columns[:2])
    lines = orders.where(number % 61 < 2).select("batch", F.when(number % 61 == 0, long).otherwise(short).alias("value"))
    lines.write.partitionBy("batch").mode("append").text(path)
    return path


LOADED = """SELECT CAST(s.o_orderkey AS BIGINT) AS o_orderkey, TRY_CAST(s.o_totalprice AS DOUBLE) AS o_totalprice, o.o_orderdate,
           CASE WHEN s.o_totalprice = 'n/a' THEN 'o_totalprice: n/a' END AS error
    FROM {orders_staged} s JOIN orders o ON CAST(s.o_orderkey AS BIGINT) = o.o_orderkey
    UNION ALL SELECT o_orderkey, NULL, NULL, CASE o_orderkey % 61 WHEN 0 THEN 'too many columns: 7 instead of 6' ELSE 'too few columns: 2 instead of 6' END
    FROM orders WHERE o_orderkey % 61 < 2"""


@query("bulk_load_on_error", f"""WITH l AS ({LOADED})
    SELECT 'loaded' AS outcome, o_orderkey, o_totalprice, o_orderdate, error FROM l WHERE error IS NULL
    UNION ALL SELECT 'rejected', o_orderkey, CAST(NULL AS DOUBLE), CAST(NULL AS TIMESTAMP), error FROM l WHERE error IS NOT NULL""")
def _(t):
    good, rejects = bulk.load_with_errors(t.spark, _staged_csv(t, "on-error"), t.orders.schema, "CONTINUE")
    bad = rejects.select(F.get_json_object("raw", "$.o_orderkey").cast("long").alias("o_orderkey"), "error")
    return good.select(F.lit("loaded").alias("outcome"), "o_orderkey", "o_totalprice", "o_orderdate", F.lit(None).cast("string").alias("error")).unionByName(
        bad.select(F.lit("rejected").alias("outcome"), "o_orderkey", F.lit(None).cast("double").alias("o_totalprice"), F.lit(None).cast("timestamp_ntz").alias("o_orderdate"), "error")
    )


@query("load_audit", f"""WITH l AS ({LOADED})
    SELECT 'batch=' || (o_orderkey % 5) AS stage, count(*) AS rows_parsed, count(*) FILTER (error IS NULL) AS rows_loaded, count(error) AS errors_seen,
           min(error) AS first_error,
           CASE WHEN count(error) = 0 THEN 'LOADED' WHEN count(error) < count(*) THEN 'PARTIALLY_LOADED' ELSE 'LOAD_FAILED' END AS status
    FROM l GROUP BY 1""")
def _(t):
    parsed = bulk.parsed_rows(t.spark, _staged_csv(t, "audit"), t.orders.schema)
    return bulk.load_audit(parsed.withColumn("stage", F.regexp_extract("file", r"(batch=\d+)", 1)), "stage")


@query("external_raw_scan", """
    SELECT event_id, event_type, user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, true AS has_file,
           row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) AS file_row_number
    FROM events""")
def _(t):
    path = fresh_dir(t.spark, "raw-events")
    # a file per day, its lines in the order of the events
    days = t.events.select("event_id", "event_type", "user_id", F.col("ts").cast("date").cast("string").alias("day"))
    days.repartition("day").sortWithinPartitions("day", "event_id").write.partitionBy("day").json(path)
    raw = bulk.external_raw_scan(t.spark, path)
    return raw.select(
        F.variant_get("event_data", "$.event_id", "bigint").alias("event_id"),
        F.variant_get("event_data", "$.event_type", "string").alias("event_type"),
        F.variant_get("event_data", "$.user_id", "bigint").alias("user_id"),
        F.regexp_extract("filename", r"day=([0-9-]+)", 1).alias("day"),
        F.col("filename").endswith(".json").alias("has_file"),
        F.col("file_row_number").cast("long").alias("file_row_number"),
    )


@query("staging_load", """
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, CAST(o_totalprice AS VARCHAR) AS o_totalprice,
           CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority, 'orders_db' AS source_system FROM orders""")
def _(t):
    return bulk.staging_load(t.orders, "orders_db").drop("load_timestamp")


@query("staging_to_typed", """
    SELECT CAST(s.o_orderkey AS BIGINT) AS o_orderkey, CAST(s.o_custkey AS BIGINT) AS o_custkey, s.o_orderstatus, TRY_CAST(s.o_totalprice AS DECIMAL(18,2)) AS o_totalprice,
           CAST(o.o_orderdate AS DATE) AS o_orderdate, CASE WHEN s.o_totalprice = 'n/a' THEN 1 ELSE 0 END AS unparseable
    FROM {orders_staged} s JOIN orders o ON CAST(s.o_orderkey AS BIGINT) = o.o_orderkey""")
def _(t):
    types = {"o_orderkey": "BIGINT", "o_custkey": "BIGINT", "o_orderstatus": "VARCHAR", "o_totalprice": "DECIMAL(18,2)", "o_orderdate": "DATE"}
    return bulk.staging_to_typed(t.orders_staged, types)


@query("bulk_export", """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, (SELECT count(*) FROM orders WHERE o_totalprice > 50000) AS exported_rows, true AS has_bytes
    FROM orders WHERE o_totalprice > 50000""")
def _(t):
    path = fresh_dir(t.spark, "export")
    picked = t.orders.where("o_totalprice > 50000").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    result = export.bulk_export(picked, path, "csv", "gzip", "|", max_rows_per_file=1_000_000)
    back = t.spark.read.schema(picked.schema).options(sep="|", header=True).csv(path)
    return back.withColumns({"exported_rows": F.lit(result.rows).cast("long"), "has_bytes": F.lit(result.bytes > 0)})


@query("table_backup", "SELECT 'nation' AS table_name, count(*) AS row_count FROM nation UNION ALL SELECT 'orders', count(*) FROM orders")
def _(t):
    tables = {"nation": t.nation, "region": t.region, "orders": t.orders}
    return backup.table_backup(tables, fresh_dir(t.spark, "backup"), include=["nation", "re*", "ord*"], exclude=["region"])


@query("backup_verify", """
    SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS source_rows, (SELECT count(*) FROM orders) AS backup_rows, true AS verified
    UNION ALL SELECT 'changed', (SELECT count(*) FROM orders), (SELECT count(*) FROM orders), false""")
def _(t):
    root = fresh_dir(t.spark, "verify")
    changed = t.orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") == 7, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    backup.table_backup({"orders": t.orders, "changed": changed}, root)
    stored = {n: t.spark.read.parquet(f"{root}/{n}") for n in ("orders", "changed")}
    return backup.backup_verify({"orders": t.orders, "changed": t.orders}, stored)


@query("backup_verify_stored", """
    SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS source_rows, (SELECT count(*) FROM orders) AS backup_rows, true AS verified, 0::BIGINT AS changed_rows
    UNION ALL SELECT 'changed', (SELECT count(*) FROM orders WHERE o_orderkey % 1000 <> 8), (SELECT count(*) FROM orders), false,
                     (SELECT count(*) FROM orders WHERE o_orderkey % 1000 BETWEEN 7 AND 8)""")
def _(t):
    root = fresh_dir(t.spark, "stored")
    hashtree.store(t.orders, "o_orderkey", root)
    price = F.when(F.col("o_orderkey") % 1000 == 7, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    changed = t.orders.where("o_orderkey % 1000 <> 8").withColumn("o_totalprice", price)
    checks = {name: hashtree.stored_verify(table, root, "o_orderkey") for name, table in (("orders", t.orders), ("changed", changed))}
    parts = [check.select(F.lit(name).alias("table_name"), "*") for name, check in checks.items()]
    return parts[0].unionByName(parts[1])


@query("restore_filtered", "SELECT * FROM {orders_target} UNION ALL SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {orders_target})")
def _(t):
    root = fresh_dir(t.spark, "restore")
    backup.table_backup({"orders": t.orders}, root)
    stored = t.spark.read.parquet(f"{root}/orders")
    restored = backup.restore(stored, t.orders_target, "o_orderkey", skip_existing=True, expected=backup.table_checksum(t.orders))
    return writes.written(restored, f"{root}/restored")


@query("history_export", "SELECT deployment_id, started_at, state FROM {deployments} WHERE state = 'failed' AND started_at >= TIMESTAMP '1998-01-01'")
def _(t):
    records = t.deployments.select("deployment_id", "started_at", "state")
    keep = (F.col("state") == "failed") & (F.col("started_at") >= F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'"))
    return export.history_export(records, keep, "started_at", "deployment_id", fresh_dir(t.spark, "history"))


@query("stats_export", """
    WITH s AS (SELECT count(*) AS total, count(*) FILTER (event_type = 'error') AS failed FROM events)
    SELECT 'total' AS metric, CAST(total AS DOUBLE) AS value FROM s UNION ALL SELECT 'failed', CAST(failed AS DOUBLE) FROM s
    UNION ALL SELECT 'error_rate', CAST(failed AS DOUBLE) / total FROM s""")
def _(t):
    path = fresh_dir(t.spark, "stats")
    stats = export.stats_table(monitor.error_rate(t.events, F.col("event_type") == "error"), ["total", "failed", "error_rate"])
    stats.write.csv(path, header=True)
    return t.spark.read.schema(stats.schema).csv(path, header=True)
