"""What the physical plans must and must not hold."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as contract
from waybill.operators.ordered import ordered_by_key
from waybill.plans.tables import Tables

SF = "/root/testdata/sf0.001"
# queries that start jobs while they are built are covered by their results
BUILT_LAZILY = [
    k for k in sorted(contract.queries())
    if contract.module_of(k) in ("marts", "monitor", "quality") or k in ("catalog_diff", "row_snapshot_diff", "recovery_point_asof", "journey_steps", "access_decisions")
]


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("key", BUILT_LAZILY)
def test_no_cross_join_and_no_python(spark, key):
    text = plan(contract.queries()[key](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "Pandas" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(contract.queries()["incremental_filter"](spark, SF))
    assert re.search(r"PushedFilters: \[.*GreaterThan\(o_orderdate", text)
    text = plan(contract.queries()["top_customers"](spark, SF))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in text


def test_cut_points_are_literals(spark):
    events = Tables(spark, SF).events.select("user_id", "ts", "event_id")
    text = plan(ordered_by_key(events, ["user_id"], ["ts", "event_id"], lag={"before": "event_id"}))
    assert "Subquery" not in text and "percentile_approx" not in text


def test_top_n_limits_before_the_shuffle(spark):
    text = plan(contract.queries()["metric_history_tail"](spark, SF))
    assert text.count("WindowGroupLimit") >= 4


def test_window_partitions_carry_a_slice(spark):
    text = plan(contract.queries()["journey_steps"](spark, SF))
    for line in re.findall(r"Arguments: hashpartitioning\(([^)]*)\)", text):
        assert "__key" in line  # the struct of the keys, user_id


def test_rows_of_a_slice_move_once(spark):
    """One exchange of the rows serves the windows and the join; the other three carry a row per key and slice."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(contract.queries()["journey_steps"](spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(re.findall(r"Arguments: hashpartitioning\(([^)]*)\)", text)) <= 4
    moved = re.findall(r"Exchange\nInput \[\d+\]: \[([^\]]*)\]", text)
    assert sum("event_id" in columns and "event_type" in columns for columns in moved) <= 1


@pytest.mark.parametrize(("key", "scans"), [("security_scan", 2), ("severity_summary", 2), ("custom_scan_rule", 2), ("deployment_kpis", 2), ("line_diff", 2), ("order_products_list", 3)])
def test_inputs_are_read_once(spark, key, scans):
    """The scan's corpus is a union of two reads; the orders of a list are found beforehand."""
    text = plan(contract.queries()[key](spark, SF))
    assert len(re.findall(r"^.*\(\d+\) Scan parquet", text, re.MULTILINE)) == scans


def test_keys_of_the_newest_orders_reach_the_scan(spark):
    text = plan(contract.queries()["order_products_list"](spark, SF))
    assert re.search(r"PushedFilters: \[In\(l_orderkey", text)


def test_columns_are_named(spark):
    for key in ("customer_order_summary", "ltv_cohorts"):
        assert all(re.fullmatch(r"[a-z_0-9]+", c) for c in contract.queries()[key](spark, SF).columns)
