"""Catalog and row differences, sync plans and write modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from waybill.operators import diff, rows, writes
from waybill.operators.skew import skew_join
from waybill.plans.registry import query
from waybill.plans.streams import delivered
from waybill.session import fresh_dir
from waybill.sources import changelog, hashtree


def _norm(c: str) -> str:
    return (
        f"upper(trim(regexp_replace(regexp_replace(regexp_replace({c}, '/\\*[\\s\\S]*?\\*/', '', 'g'), "
        f"'--[^\\n]*', '', 'g'), '\\s+', ' ', 'g')))"
    )


# written out, so that a wrong entry in the code does not pass on both sides
COMPARED = {
    "Owner": "owner", "Comment": "comment", "Definition": "definition", "ColumnCount": "column_count", "IsSecure": "is_secure",
    "IsMaterialized": "is_materialized", "Language": "language", "ReturnType": "return_type",
}


def _diff_sql(src: str, tgt: str) -> str:
    """CTE ``d`` with one row per difference: key, diff_type, list of changed properties, text of the details."""
    props = []
    for label, c in COMPARED.items():
        test = f"s.{c} IS DISTINCT FROM t.{c}"
        if label == "Definition":
            test = f"coalesce(s.{c}, '') <> '' AND coalesce(t.{c}, '') <> '' AND {_norm(f's.{c}')} <> {_norm(f't.{c}')}"
        props.append((label, c, test))
    names = ", ".join(f"CASE WHEN {test} THEN '{label}' END" for label, c, test in props)
    texts = ", ".join(f"CASE WHEN {test} THEN '{label}:' || coalesce(s.{c}, '') || '->' || coalesce(t.{c}, '') END" for label, c, test in props)
    return f"""
    j AS (
        SELECT database_name, schema_name, object_type, object_name, s.owner AS s_owner, t.owner AS t_owner,
               s.definition AS s_definition, s.comment AS s_comment, t.comment AS t_comment,
               s.p_one AS in_source, t.p_one AS in_target,
               list_filter([{names}], lambda x: x IS NOT NULL) AS changed, list_filter([{texts}], lambda x: x IS NOT NULL) AS texts
        FROM (SELECT *, 1 AS p_one FROM {src}) s FULL OUTER JOIN (SELECT *, 1 AS p_one FROM {tgt}) t
             USING (database_name, schema_name, object_type, object_name)),
    d AS (
        SELECT *, CASE WHEN in_target IS NULL THEN 'REMOVED' WHEN in_source IS NULL THEN 'ADDED' ELSE 'MODIFIED' END AS diff_type,
               CASE WHEN in_source = 1 AND in_target = 1 THEN array_to_string(texts, '|') ELSE '' END AS details
        FROM j WHERE in_source IS NULL OR in_target IS NULL OR len(changed) > 0)"""


DIFF = "WITH " + _diff_sql("{catalog_src}", "{catalog_tgt}")
KEYS = "database_name, schema_name, object_type, object_name"


def _shown(diffs):
    return diffs.select(*diff.KEY, "diff_type", diff.detail_text(F.col("details")).alias("details"))


@query("catalog_diff", f"{DIFF} SELECT {KEYS}, diff_type, details FROM d")
def _(t):
    return _shown(diff.catalog_diff(t.catalog_src, t.catalog_tgt))


@query("object_filter", f"""{DIFF} SELECT {KEYS}, diff_type, details FROM d
    WHERE NOT regexp_matches(object_name, '^temp_.*') AND NOT regexp_matches(object_name, '_BACKUP$')
      AND regexp_matches(object_name, 'OBJ_[0-9]*[02468]$') AND object_type <> 'SEQUENCE' AND object_type IN ('TABLE', 'VIEW', 'SEQUENCE')""")
def _(t):
    found = diff.object_filter(
        diff.catalog_diff(t.catalog_src, t.catalog_tgt),
        include_names=["OBJ_[0-9]*[02468]$"],
        exclude_names=["^temp_.*", "_BACKUP$"],
        include_types=["TABLE", "VIEW", "SEQUENCE"],
        exclude_types=["SEQUENCE"],
    )
    return _shown(found)


@query("ignore_rules", f"""{DIFF} SELECT {KEYS}, diff_type, details FROM d
    WHERE NOT (object_type = 'TABLE' AND regexp_matches(object_name, '^TEMP_.*'))
      AND NOT (diff_type = 'MODIFIED' AND len(list_filter(changed, lambda x: NOT (x = 'Owner' OR (x = 'Comment' AND object_type = 'VIEW')))) = 0)""")
def _(t):
    rules = [
        diff.IgnoreRule(object_type="TABLE", pattern="^TEMP_.*"),
        diff.IgnoreRule(property="Owner"),
        diff.IgnoreRule(object_type="VIEW", property="Comment"),
    ]
    return _shown(diff.apply_ignore_rules(diff.catalog_diff(t.catalog_src, t.catalog_tgt), rules))


@query("diff_summary", f"""{DIFF},
    k AS (SELECT object_type, count(*) FILTER (diff_type = 'ADDED') AS added, count(*) FILTER (diff_type = 'REMOVED') AS removed,
                 count(*) FILTER (diff_type = 'MODIFIED') AS modified FROM d GROUP BY 1),
    n AS (SELECT object_type, CAST(sum(s) AS BIGINT) AS source_objects, CAST(sum(t) AS BIGINT) AS target_objects
          FROM (SELECT object_type, 1 AS s, 0 AS t FROM {{catalog_src}} UNION ALL SELECT object_type, 0, 1 FROM {{catalog_tgt}}) GROUP BY 1),
    p AS (SELECT n.object_type, source_objects, target_objects, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed,
                 coalesce(modified, 0) AS modified, greatest(source_objects, target_objects) AS total FROM n LEFT JOIN k ON n.object_type = k.object_type),
    a AS (SELECT * FROM p UNION ALL SELECT 'ALL', CAST(sum(source_objects) AS BIGINT), CAST(sum(target_objects) AS BIGINT), CAST(sum(added) AS BIGINT),
                 CAST(sum(removed) AS BIGINT), CAST(sum(modified) AS BIGINT), CAST(sum(total) AS BIGINT) FROM p)
    SELECT *, added + removed + modified AS different, total - (added + removed + modified) AS matching,
           source_objects - removed - modified AS matched_keys FROM a""")
def _(t):
    diffs = diff.catalog_diff(t.catalog_src, t.catalog_tgt)
    return diff.diff_summary(diffs, t.catalog_src, t.catalog_tgt)


@query("diff_sorted", f"{DIFF} SELECT {KEYS}, diff_type, details FROM d ORDER BY object_type, database_name, schema_name, object_name")
def _(t):
    return diff.diff_sorted(_shown(diff.catalog_diff(t.catalog_src, t.catalog_tgt)))


FULL = "database_name || '.' || schema_name || '.' || object_name"


@query("sync_plan", f"""{DIFF},
    o AS (
        SELECT {KEYS}, CAST(list_position(['SEQUENCE', 'FILE_FORMAT', 'STAGE', 'TABLE', 'VIEW', 'FUNCTION', 'PROCEDURE', 'STREAM', 'PIPE', 'TASK'], object_type) AS INTEGER) AS type_order,
               CASE diff_type WHEN 'ADDED' THEN 1 WHEN 'MODIFIED' THEN 2 ELSE 3 END AS step,
               CASE diff_type WHEN 'ADDED' THEN 'DROP' WHEN 'MODIFIED' THEN 'ALTER' ELSE 'CREATE' END AS op,
               'DROP ' || object_type || ' IF EXISTS ' || {FULL} || CASE WHEN object_type = 'TABLE' THEN ' CASCADE;' ELSE ';' END AS dropping,
               CASE WHEN coalesce(s_definition, '') <> '' THEN s_definition ELSE '-- definition not available: ' || object_type || ' ' || {FULL} END AS creating,
               changed, s_owner, s_comment FROM d),
    q AS (
        SELECT type_order, step, {KEYS}, op, CASE op WHEN 'DROP' THEN dropping WHEN 'CREATE' THEN creating ELSE
            array_to_string(list_filter([
                CASE WHEN list_contains(changed, 'Owner') AND coalesce(s_owner, '') <> '' THEN 'GRANT OWNERSHIP ON ' || object_type || ' ' || {FULL} || ' TO ROLE ' || s_owner || ';' END,
                CASE WHEN list_contains(changed, 'Comment') THEN 'COMMENT ON ' || object_type || ' ' || {FULL} || ' IS ''' || replace(coalesce(s_comment, ''), '''', '''''') || ''';' END,
                CASE WHEN list_contains(changed, 'Definition') AND object_type IN ('VIEW', 'PROCEDURE', 'FUNCTION') THEN dropping || chr(10) || chr(10) || creating END,
                CASE WHEN list_contains(changed, 'ColumnCount') THEN '-- ColumnCount of ' || object_type || ' ' || {FULL} || ' differs' END,
                CASE WHEN list_contains(changed, 'IsSecure') THEN '-- IsSecure of ' || object_type || ' ' || {FULL} || ' differs' END,
                CASE WHEN list_contains(changed, 'IsMaterialized') THEN '-- IsMaterialized of ' || object_type || ' ' || {FULL} || ' differs' END,
                CASE WHEN list_contains(changed, 'Language') THEN '-- Language of ' || object_type || ' ' || {FULL} || ' differs' END,
                CASE WHEN list_contains(changed, 'ReturnType') THEN '-- ReturnType of ' || object_type || ' ' || {FULL} || ' differs' END], lambda x: x IS NOT NULL), chr(10) || chr(10)) END AS statement
        FROM o)
    SELECT * FROM q WHERE statement <> '' ORDER BY type_order, step, database_name, schema_name, object_name""")
def _(t):
    return diff.sync_plan(diff.catalog_diff(t.catalog_src, t.catalog_tgt), include_drops=True, safe_mode=False)


@query("version_compare", "WITH " + _diff_sql("(SELECT * FROM {catalog_versions} WHERE version = 1)", "(SELECT * FROM {catalog_versions} WHERE version = 2)") + f"""
    SELECT {KEYS}, diff_type, details, (SELECT count(DISTINCT version) FROM {{catalog_versions}}) AS stored_versions FROM d""")
def _(t):
    stored = t.catalog_versions.agg(F.count_distinct("version").alias("n")).scalar()
    return _shown(diff.version_compare(t.catalog_versions, 1, 2)).withColumn("stored_versions", stored)


def _env_sql(env: str) -> str:
    return f"""SELECT '{env}' AS environment, count(*) FILTER (diff_type = 'ADDED') AS added, count(*) FILTER (diff_type = 'REMOVED') AS removed,
        count(*) FILTER (diff_type = 'MODIFIED') AS modified, count(*) > 0 AS drift FROM (
            WITH {_diff_sql(f"(SELECT * FROM kept WHERE environment = 'dev')", f"(SELECT * FROM kept WHERE environment = '{env}')")} SELECT * FROM d)"""


@query("drift_matrix", f"""
    WITH kept AS (SELECT * FROM {{catalog_envs}} WHERE NOT regexp_matches(object_name, '^TEMP_.*') AND NOT regexp_matches(object_name, '.*_BACKUP$'))
    {_env_sql('staging')} UNION ALL {_env_sql('prod')}""")
def _(t):
    return diff.drift_matrix(t.catalog_envs, "dev", ["staging", "prod"])


VERDICT = """
    WITH v AS (SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey,
                      CASE WHEN s.o_orderkey IS NULL THEN 'added' WHEN t.o_orderkey IS NULL THEN 'removed'
                           WHEN (s.o_custkey, s.o_orderstatus, s.o_totalprice, s.o_orderdate, s.o_orderpriority)
                             IS DISTINCT FROM (t.o_custkey, t.o_orderstatus, t.o_totalprice, t.o_orderdate, t.o_orderpriority) THEN 'modified' ELSE 'equal' END AS verdict
               FROM orders s FULL OUTER JOIN {orders_target} t ON s.o_orderkey = t.o_orderkey)"""


@query("row_snapshot_diff", VERDICT + " SELECT o_orderkey, verdict FROM v WHERE verdict <> 'equal'")
def _(t):
    return diff.row_snapshot_diff(t.orders, t.orders_target, "o_orderkey").select("o_orderkey", "verdict")


@query("restore_operations", VERDICT + """
    SELECT o_orderkey, CASE verdict WHEN 'added' THEN 'DROP' WHEN 'modified' THEN 'REPLACE' ELSE 'CREATE' END AS op FROM v WHERE verdict <> 'equal'""")
def _(t):
    return diff.restore_operations(t.orders, t.orders_target, "o_orderkey")


@query("row_snapshot_diff_stored", VERDICT + " SELECT o_orderkey, verdict FROM v WHERE verdict <> 'equal'")
def _(t):
    old, new = _stored_versions(t)
    return hashtree.stored_diff(old, new, t.orders, "o_orderkey").select("o_orderkey", "verdict")


@query("restore_operations_stored", VERDICT + """
    SELECT o_orderkey, CASE verdict WHEN 'added' THEN 'DROP' WHEN 'modified' THEN 'REPLACE' ELSE 'CREATE' END AS op FROM v WHERE verdict <> 'equal'""")
def _(t):
    old, new = _stored_versions(t)
    return hashtree.stored_restore(old, new, t.orders, "o_orderkey")


def _stored_versions(t):
    """Two versions of the orders with their hash trees."""
    roots = [fresh_dir(t.spark, "version") for _ in range(2)]
    for table, root in zip((t.orders, t.orders_target), roots, strict=True):
        hashtree.store(table.select(*t.orders_target.columns), "o_orderkey", root)
    return roots


@query("only_in_source", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {orders_target})")
def _(t):
    return diff.only_in_left(t.orders, t.orders_target, "o_orderkey")


@query("only_in_target", "SELECT o_orderkey FROM {orders_target} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def _(t):
    return diff.only_in_left(t.orders_target, t.orders, "o_orderkey")


@query("deps_in_scope", "SELECT child_id, parent_id FROM {dep_edges} WHERE parent_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _(t):
    scope = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("parent_id")).distinct()
    return skew_join(t.dep_edges, scope, "parent_id").select("child_id", "parent_id")


@query("row_multiset_diff", """
    SELECT *, 'source' AS only_in, count(*) AS copies FROM (SELECT * FROM orders EXCEPT ALL SELECT * FROM {orders_target}) GROUP BY ALL
    UNION ALL SELECT *, 'target', count(*) FROM (SELECT * FROM {orders_target} EXCEPT ALL SELECT * FROM orders) GROUP BY ALL""")
def _(t):
    return diff.row_multiset_diff(t.orders, t.orders_target)


@query("cdc_changes", """
    SELECT CASE WHEN t.o_orderkey IS NULL THEN 'delete' WHEN s.o_orderkey IS NULL THEN 'insert' ELSE 'update' END AS change,
           coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey,
           CASE WHEN t.o_orderkey IS NULL THEN s.o_custkey ELSE t.o_custkey END AS o_custkey,
           CASE WHEN t.o_orderkey IS NULL THEN s.o_orderstatus ELSE t.o_orderstatus END AS o_orderstatus,
           CASE WHEN t.o_orderkey IS NULL THEN s.o_totalprice ELSE t.o_totalprice END AS o_totalprice,
           CASE WHEN t.o_orderkey IS NULL THEN s.o_orderdate ELSE t.o_orderdate END AS o_orderdate,
           CASE WHEN t.o_orderkey IS NULL THEN s.o_orderpriority ELSE t.o_orderpriority END AS o_orderpriority
    FROM orders s FULL OUTER JOIN {orders_target} t ON s.o_orderkey = t.o_orderkey
    WHERE s.o_orderkey IS NULL OR t.o_orderkey IS NULL OR (s.o_custkey, s.o_orderstatus, s.o_totalprice, s.o_orderdate, s.o_orderpriority)
          IS DISTINCT FROM (t.o_custkey, t.o_orderstatus, t.o_totalprice, t.o_orderdate, t.o_orderpriority)""")
def _(t):
    return diff.cdc_changes(t.orders, t.orders_target, "o_orderkey")


# write modes


@query("write_append", "SELECT * FROM orders")
def _(t):
    path = fresh_dir(t.spark, "append")
    writes.written(t.orders.where("o_orderkey % 2 = 0"), path)
    return writes.append(t.spark, t.orders.where("o_orderkey % 2 = 1"), path)


@query("write_upsert", "SELECT * FROM orders UNION ALL SELECT * FROM {orders_target} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def _(t):
    return writes.written(writes.upserted(t.orders_target, t.orders, "o_orderkey"), fresh_dir(t.spark, "upsert"))


@query("write_replace", """
    SELECT *, CAST(year(o_orderdate) AS INTEGER) AS order_year FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01'
    UNION ALL SELECT *, CAST(year(o_orderdate) AS INTEGER) FROM {orders_target} WHERE o_orderdate < TIMESTAMP '1999-01-01'""")
def _(t):
    path, year = fresh_dir(t.spark, "replace"), F.year("o_orderdate").alias("order_year")
    target = t.orders_target.select("*", year)
    writes.written(target, path, ["order_year"])
    fresh = t.orders.where("o_orderdate >= TIMESTAMP_NTZ '1999-01-01 00:00:00'").select("*", year)
    writes.replace_partitions(fresh, path, ["order_year"])
    return t.spark.read.parquet(path)


@query("write_sync", """
    SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey,
           CASE WHEN t.o_orderkey IS NULL THEN 'INSERT' WHEN s.o_orderkey IS NULL THEN 'DELETE'
                WHEN (s.o_custkey, s.o_orderstatus, s.o_totalprice, s.o_orderdate, s.o_orderpriority)
                  IS DISTINCT FROM (t.o_custkey, t.o_orderstatus, t.o_totalprice, t.o_orderdate, t.o_orderpriority) THEN 'UPDATE' ELSE 'KEEP' END AS op,
           s.o_custkey, s.o_orderstatus, s.o_totalprice, s.o_orderdate, s.o_orderpriority
    FROM orders s FULL OUTER JOIN {orders_target} t ON s.o_orderkey = t.o_orderkey""")
def _(t):
    operations = writes.sync_operations(t.orders_target, t.orders, "o_orderkey")
    # the operations are written once and serve both the log and the new image
    return writes.written(operations, fresh_dir(t.spark, "sync"))


@query("write_sync_image", "SELECT * FROM orders")
def _(t):
    operations = writes.written(writes.sync_operations(t.orders_target, t.orders, "o_orderkey"), fresh_dir(t.spark, "sync"))
    return writes.written(writes.synced(operations), fresh_dir(t.spark, "image")).select(*t.orders.columns)


@query("write_sync_counts", """
    SELECT CASE WHEN t.o_orderkey IS NULL THEN 'INSERT' WHEN s.o_orderkey IS NULL THEN 'DELETE'
                WHEN (s.o_custkey, s.o_orderstatus, s.o_totalprice, s.o_orderdate, s.o_orderpriority)
                  IS DISTINCT FROM (t.o_custkey, t.o_orderstatus, t.o_totalprice, t.o_orderdate, t.o_orderpriority) THEN 'UPDATE' ELSE 'KEEP' END AS op,
           count(*) AS operations
    FROM orders s FULL OUTER JOIN {orders_target} t ON s.o_orderkey = t.o_orderkey GROUP BY 1""")
def _(t):
    operations = writes.sync_operations(t.orders_target, t.orders, "o_orderkey")
    return operations.groupBy("op").agg(F.count("*").alias("operations"))


@query("rollback_batch", "SELECT *, o_orderkey % 4 AS migration_id FROM orders WHERE o_orderkey % 4 <> 2")
def _(t):
    loaded = t.orders.withColumn("migration_id", F.col("o_orderkey") % 4)
    return writes.written(writes.rollback_batch(loaded, "migration_id", 2), fresh_dir(t.spark, "rollback"))


@query("resume_from_checkpoint", "SELECT *, CAST(o_orderkey % 4 AS INTEGER) AS batch FROM orders")
def _(t):
    path, done = fresh_dir(t.spark, "resume"), fresh_dir(t.spark, "resume-done")
    source = t.orders.withColumn("batch", (F.col("o_orderkey") % 4).cast("int"))
    # a run that finished two batches and was cut off inside the third
    first = source.where("batch < 2").unionByName(source.where("batch = 2 AND o_orderkey % 3 = 0"))
    writes.written(first, path, ["batch"])
    writes.written(source.where("batch < 2").select("batch").distinct(), done)
    return writes.copy_batches(source, "batch", path, done)


MIGRATED = """
    SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS BIGINT) AS customer_id,
           CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'unknown' END AS status,
           CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount, CASE WHEN o_totalprice > 300000 THEN 'LARGE' END AS size_class, 'EUR' AS currency
    FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_totalprice > 1000"""


@query("migrate_pipeline", MIGRATED)
@query("migrate_table", MIGRATED)
def _(t):
    from waybill.operators.quality import Rule, gate

    out = rows.migrate(
        t.orders,
        [rows.Filter("o_orderdate >= TIMESTAMP_NTZ '1996-01-01 00:00:00'"), rows.Filter("o_totalprice > 1000")],
        [
            rows.Transform("o_orderstatus", "o_orderstatus", "MAP", {"mapping": {"F": "finished", "O": "open"}, "default": "unknown"}),
            rows.Transform("o_totalprice", "size_class", "COMPUTE", {"expression": "'LARGE'"}, condition="o_totalprice > 300000"),
        ],
        [
            rows.Mapping("o_orderkey", "order_id", "VARCHAR", required=True),
            rows.Mapping("o_custkey", "customer_id", "BIGINT", required=True),
            rows.Mapping("o_orderstatus", "status", "VARCHAR"),
            rows.Mapping("o_totalprice", "total_amount", "DECIMAL(18,2)"),
            rows.Mapping("size_class", "size_class"),
            rows.Mapping("currency", "currency", default="EUR"),
        ],
    )
    # staged once, checked on the staged rows, and only then handed on
    staged = writes.written(out, fresh_dir(t.spark, "migrate"))
    return gate(staged, [Rule("id given", "order_id IS NOT NULL", "ERROR"), Rule("positive", "total_amount > 0", "CRITICAL")])


LOGGED = """f AS (SELECT o_custkey AS k, o_orderkey AS seq, o_totalprice AS v, CASE o_orderkey % 5 WHEN 0 THEN 'insert' WHEN 1 THEN 'delete' ELSE 'update' END AS change,
                o_orderkey // 4 % 3 AS version FROM orders)"""


def _net(name: str, after: int) -> str:
    """The changes of versions after one, as a consumer sees them."""
    return f"""SELECT '{name}' AS consumer, k, CASE WHEN first = 'insert' THEN 'insert' WHEN last = 'delete' THEN 'delete' ELSE 'update' END AS change, v
        FROM (SELECT k, arg_min(change, (version, seq)) AS first, arg_max(change, (version, seq)) AS last, arg_max(v, (version, seq)) AS v FROM f WHERE version > {after} GROUP BY k)
        WHERE NOT (first = 'insert' AND last = 'delete')"""


@query("cdc_since_last_read", f"WITH {LOGGED} {_net('ahead', 1)} UNION ALL {_net('behind', 0)} UNION ALL {_net('new', -1)}")
def _(t):
    """Three deliveries; one consumer reads after each, one after the first only, one never before the end."""
    kind = F.when(F.col("seq") % 5 == 0, "insert").when(F.col("seq") % 5 == 1, "delete").otherwise("update").alias("change")
    feed = t.orders.select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"))
    feed = feed.select(kind, "seq", "k", "v", F.expr("seq div 4 % 3").alias("delivery"))
    schema, seen = feed.drop("delivery").schema, []

    def job(changes, root):
        changelog.log_changes(changes.drop("delivery"), f"{root}/log")
        readers = {name: changelog.Consumer(t.spark, f"{root}/log", name, schema, "k") for name in ("ahead", "behind", "new")}
        seen.append(1)
        found = [r.read().select(F.lit(name).alias("consumer"), "k", "change", "v") for name, r in readers.items()]
        if len(seen) < 3:
            for name in ("ahead",) if len(seen) == 2 else ("ahead", "behind"):
                readers[name].done()
        return found[0].unionByName(found[1]).unionByName(found[2])

    return delivered(t, feed, job, F.col("delivery"))
