"""Small cases with known answers."""

import pytest
from pyspark.sql import functions as F

from waybill.functions import privacy, sampling, sqltext, text
from waybill.functions.convert import convert, parse_date_multi, value_map
from waybill.operators import diff, marts, monitor
from waybill.operators.diff import IgnoreRule

CATALOG = "database_name string, schema_name string, object_type string, object_name string, owner string, comment string, definition string, column_count string, is_secure string"


def catalog(spark, *objects):
    rows = []
    for kind, name, *rest in objects:
        extra = dict(zip(("owner", "comment", "definition"), rest))
        rows.append(("DB1", "SCHEMA1", kind, name, extra.get("owner", "USER1"), extra.get("comment"), extra.get("definition"), None, None))
    return spark.createDataFrame(rows, CATALOG)


BASE = [("TABLE", "table1"), ("VIEW", "view1")]


@pytest.mark.parametrize(
    ("source", "target", "kinds"),
    [
        (BASE, BASE, []),
        (BASE, [*BASE, ("TABLE", "table2")], ["ADDED"]),
        ([*BASE, ("TABLE", "table2")], BASE, ["REMOVED"]),
        ([("TABLE", "table1", "USER1")], [("TABLE", "table1", "USER2")], ["MODIFIED"]),
        ([("VIEW", "v", "U", None, "select 1 -- a")], [("VIEW", "v", "U", None, "SELECT  1 -- b")], []),
        ([("VIEW", "v", "U", None, "select 1 -- a\nfrom t")], [("VIEW", "v", "U", None, "select 1 -- a\nfrom u")], ["MODIFIED"]),
        ([("VIEW", "v", "U", None, "")], [("VIEW", "v", "U", None, "select 1")], []),
    ],
)
def test_catalog_diff(spark, source, target, kinds):
    got = diff.catalog_diff(catalog(spark, *source), catalog(spark, *target))
    assert sorted(r["diff_type"] for r in got.collect()) == kinds


def test_diff_options(spark):
    changed = diff.catalog_diff(catalog(spark, ("TABLE", "t", "A")), catalog(spark, ("TABLE", "t", "B")), {"Comment": "comment"})
    assert changed.count() == 0
    diffs = diff.catalog_diff(catalog(spark, *BASE, ("TABLE", "temp_table")), catalog(spark, ("TABLE", "table1")))
    assert diff.object_filter(diffs, include_types=["TABLE"], exclude_names=["^temp_.*"]).count() == 0


def test_ignore_rules(spark):
    diffs = diff.catalog_diff(
        catalog(spark, ("TABLE", "TEMP_TABLE"), ("TABLE", "REAL_TABLE", "A")), catalog(spark, ("TABLE", "REAL_TABLE", "B"))
    )
    rules = [IgnoreRule("TABLE", "^TEMP_.*"), IgnoreRule(property="Owner")]
    assert diffs.count() == 2
    assert diff.apply_ignore_rules(diffs, rules).count() == 0
    # a property rule alone does not hide an object that is missing altogether
    assert [r["object_name"] for r in diff.apply_ignore_rules(diffs, rules[1:]).collect()] == ["TEMP_TABLE"]


def test_sync_plan(spark):
    made = catalog(spark, ("TABLE", "new_table", "U", None, "CREATE TABLE new_table (id INT);"))
    none = catalog(spark).where("false")
    assert diff.sync_plan(diff.catalog_diff(made, none)).first()["statement"] == "CREATE TABLE new_table (id INT);"
    extra = diff.catalog_diff(none, catalog(spark, ("TABLE", "old_table")))
    assert diff.sync_plan(extra, include_drops=True, safe_mode=True).count() == 0
    assert diff.sync_plan(extra, include_drops=True, safe_mode=False).first()["statement"] == "DROP TABLE IF EXISTS DB1.SCHEMA1.old_table CASCADE;"
    old = catalog(spark, ("TABLE", "table1", "U", "Old comment"))
    new = catalog(spark, ("TABLE", "table1", "U", "New comment"))
    written = diff.sync_plan(diff.catalog_diff(old, new), alter_value="target").first()["statement"]
    assert written == "COMMENT ON TABLE DB1.SCHEMA1.table1 IS 'New comment';"


def test_diff_summary_counts_matches_soundly(spark):
    a, b = catalog(spark, ("TABLE", "x")), catalog(spark, ("TABLE", "y"))
    row = diff.diff_summary(diff.catalog_diff(a, b), a, b).where("object_type = 'TABLE'").first()
    assert (row["different"], row["matching"], row["matched_keys"]) == (2, -1, 0)


def test_null_and_empty_differ_in_checksums(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "", "b"), ("a", "b", None)], "x string, y string, z string")
    assert df.select(diff.row_checksum(["x", "y", "z"]).alias("c")).distinct().count() == 3


def test_metric_rollup(spark):
    points = spark.createDataFrame([("m", 1, 1, 10.5), ("m", 2, 2, 15.2), ("m", 3, 3, 12.8)], "name string, ts int, id int, value double")
    r = monitor.metric_rollup(points, "name", "ts", "id", "value").first()
    assert (r["count"], r["min_value"], r["max_value"], r["last_value"]) == (3, 10.5, 15.2, 12.8)
    assert abs(r["mean_value"] - 12.833) < 0.01


def test_histogram(spark):
    values = spark.createDataFrame([(0.3,), (0.8,), (2.0,)], "v double")
    got = {r["le"]: r["bucket"] for r in monitor.histogram_cumulative(values, "v", {"h": [0.1, 0.5, 1, 5]}).collect()}
    assert got == {"0.1": 0, "0.5": 1, "1": 2, "5": 3, "+Inf": 3}


def test_statements_and_errors(spark):
    texts = [
        "INSERT INTO table VALUES (1)", "UPDATE table SET col = 1", "DELETE FROM table WHERE id = 1", "CREATE TABLE test (id INT)",
        "ALTER TABLE test ADD COLUMN", "DROP TABLE test", "MERGE INTO target USING source", "COPY INTO table FROM stage", "SELECT * FROM table",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r[0] for r in df.select(sqltext.statement_type(F.col("s"))).collect()]
    assert got == ["INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP", "MERGE", "COPY", "UNKNOWN"]
    big = spark.createDataFrame([("SELECT a FROM t WHERE a IN (" + "1," * 600 + "1)", 5)], "s string, n int")
    assert [h["rule"] for h in big.select(sqltext.lint(F.col("s"), F.col("n"))).first()[0]] == ["large_in_clause"]


def test_error_rate(spark):
    files = spark.range(50).select((F.col("id") < 3).alias("bad"))
    r = monitor.error_rate(files, F.col("bad")).first()
    assert r["error_rate"] == 0.06 and r["error_rate"] > 0.05 and r["success_percent"] < 95
    assert monitor.error_rate(files.where("false"), F.col("bad")).first()["error_rate"] == 0.0


def test_sampling(spark):
    ids = spark.range(1000).select(F.col("id").cast("string").alias("i"))
    assert ids.where(sampling.keep_trace(F.col("i"), 0)).count() == 0
    assert ids.where(sampling.keep_trace(F.col("i"), 1)).count() == 1000
    assert ids.select(sampling.sample_hash(F.lit(""))).first()[0] == 0


def test_values_and_dates(spark):
    df = spark.createDataFrame([("2024-03-01",), ("03/01/2024",), ("2024-03-01T10:00:00Z",), ("2024-03-01 10:00:00",), ("x",), (None,)], "d string")
    got = [r[0] for r in df.select(parse_date_multi(F.col("d")).cast("date").cast("string")).collect()]
    assert got == ["2024-03-01"] * 4 + [None, None]
    with pytest.raises(Exception, match="not a date"):
        df.select(convert(F.col("d"), "DATE")).collect()
    assert df.where("d = 'x'").select(convert(F.col("d"), "DATE", "null")).first()[0] is None
    flags = spark.createDataFrame([(0,), (2,)], "i long").select(convert(F.col("i"), "BOOLEAN")).collect()
    assert [r[0] for r in flags] == [False, True]
    mapped = df.select(value_map(F.col("d"), {"x": None}).alias("m")).collect()
    assert mapped[4]["m"] is None and mapped[0]["m"] == "2024-03-01"


def test_redaction(spark):
    df = spark.createDataFrame([("pin ssn 123 and /home/ann/x from a.b@c.de at 10.0.0.1 token=abc, shopping list",)], "t string")
    got = df.select(privacy.redact(F.col("t"))).first()[0]
    for secret in ("123", "ann", "a.b@", "10.0.0.1", "abc"):
        assert secret not in got
    assert "shopping list" in got
    assert "shopping" not in df.select(privacy.redact(F.col("t"), strict=False)).first()[0]
    with pytest.raises(Exception):
        privacy.redact(F.col("t"), extra=["("])


def test_masking_keeps_colliding_keys(spark):
    m = F.create_map(*[F.lit(x) for x in ("password", "1", "api_key", "2", "plain", "3")])
    got = spark.range(1).select(privacy.mask_sensitive_keys(m)).first()[0]
    assert got == {"plain": "3", "[SENSITIVE_KEY]": "2", "[SENSITIVE_KEY]_2": "1"}


def test_globs():
    assert text.glob_regex("*_test.go") == "^.*_test\\.go$"


POC_ORDERS = [(1, 1, 1029.98), (2, 2, 579.98), (3, 3, 309.98), (4, 1, 219.98), (5, 4, 1299.97)]
POC_ITEMS = [
    (1, 1, 1, 999.99), (1, 2, 1, 29.99), (2, 5, 1, 199.99), (2, 6, 1, 499.99), (2, 7, 8, 9.99), (3, 4, 1, 299.99),
    (3, 8, 1, 19.99), (4, 5, 1, 199.99), (4, 8, 1, 19.99), (5, 1, 1, 999.99), (5, 4, 1, 299.99),
]


@pytest.fixture(scope="module")
def poc(spark):
    names = ["Alice Johnson", "Bob Smith", "Charlie Brown", "Diana Prince", "Eve Davis"]
    customers = spark.createDataFrame([(i, n) for i, n in enumerate(names, 1)], "c_custkey long, c_name string")
    kinds = ["Electronics"] * 4 + ["Furniture"] * 2 + ["Office Supplies"] * 2
    products = ["Laptop", "Mouse", "Keyboard", "Monitor", "Desk Chair", "Standing Desk", "Notebook", "Pen Set"]
    parts = spark.createDataFrame([(i, n, k) for i, (n, k) in enumerate(zip(products, kinds), 1)], "p_partkey long, p_name string, p_type string")
    orders = spark.createDataFrame(POC_ORDERS, "o_orderkey long, o_custkey long, o_totalprice double").withColumn(
        "o_orderdate", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")
    )
    items = spark.createDataFrame([(o, p, float(q), v) for o, p, q, v in POC_ITEMS], "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double")
    return customers, parts, orders, items


def test_poc_marts(poc):
    customers, parts, orders, items = poc
    counts = {r["o_orderkey"]: r["item_count"] for r in marts.order_summary_left(orders, customers, items).collect()}
    assert counts == {1: 2, 2: 3, 3: 2, 4: 2, 5: 2}
    top = [(r["c_name"].split()[0], r["order_count"], r["total_revenue"]) for r in marts.top_customers(customers, orders).collect()]
    assert top == [("Diana", 1, 1299.97), ("Alice", 2, 1249.96), ("Bob", 1, 579.98), ("Charlie", 1, 309.98)]
    by_type = {r["p_type"]: (r["product_count"], r["category_revenue"]) for r in marts.category_performance(parts, items, orders).collect()}
    assert by_type == {"Electronics": (4, 2629.95), "Furniture": (2, 899.97), "Office Supplies": (2, 119.90)}
    kinds = {r["c_name"].split()[0]: r["customer_type"] for r in marts.customer_patterns(customers, orders).collect()}
    assert kinds["Alice"] == "Repeat Customer" and kinds["Eve"] == "No Purchase"
