"""Sliced windows against plain windows, with a hot key, a hot instant and NULLs."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from waybill.operators import ordered
from waybill.operators.skew import heavy_keys, skew_join


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    key = F.when(i % 3 == 0, F.lit(1)).when(i % 101 == 0, F.lit(None)).otherwise(i % 17)
    ts = F.when(i % 3 == 1, F.lit(500)).when(i % 97 == 0, F.lit(None)).otherwise((i * 7919) % 1000)
    return spark.range(6000).select(i, key.alias("k"), ts.alias("t"), ((i * 31) % 211).cast("double").alias("v")).cache()


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_lag_lead_running_last(rows):
    w = Window.partitionBy("k").orderBy("t", "id")
    rows = rows.withColumn("q", F.when(F.col("id") % 5 == 0, F.col("v")))
    got = ordered.ordered_by_key(
        rows, ["k"], ["t", "id"], lag={"before": "id", "before_v": "v"}, lead={"after": "id"}, running={"upto": "v"}, last_known={"known": "q"}
    )
    want = rows.select(
        "*", F.lag("id").over(w).alias("before"), F.lag("v").over(w).alias("before_v"), F.lead("id").over(w).alias("after"),
        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.last("q", True).over(w).alias("known"),
    )
    assert same(got, want)


def test_row_number_and_rank(rows):
    w = Window.partitionBy("k").orderBy("t", "id")
    assert same(ordered.row_number_by_key(rows, ["k"], ["t", "id"], "n"), rows.withColumn("n", F.row_number().over(w).cast("long")))
    by_time = Window.partitionBy("k").orderBy("t")
    assert same(ordered.rank_by_key(rows, ["k"], ["t", "id"], "n"), rows.withColumn("n", F.rank().over(by_time).cast("long")))


def test_slices_split_a_hot_key_and_a_hot_instant(rows):
    cut = ordered.sliced(rows, ["t", "id"])
    largest = cut.groupBy("k", *ordered.SLICE_COLUMNS).count().agg(F.max("count")).first()[0]
    assert rows.groupBy("k").count().agg(F.max("count")).first()[0] > 2000
    assert largest < 200


def test_cut_points_of_many_groups(rows):
    """Cut points merged from many groups of input splits divide the rows evenly, and repeat a frequent value."""
    from collections import Counter

    spread = rows.repartition(150)
    ((cuts, _), (ids, _)) = ordered._cut_points(spread, ["t", "id"], 64)
    assert len(cuts) == len(ids) == 63
    assert Counter(cuts)["500"] >= 20  # a third of the rows
    ids = [int(i) for i in ids]
    assert ids == sorted(ids) and max(b - a for a, b in zip(ids, ids[1:], strict=False)) < 3 * 6000 / 64
    assert ordered._merged([], 64) == []


def test_keys_of_several_columns_with_nulls(spark):
    made = spark.range(900).selectExpr("id", "CASE WHEN id % 4 > 0 THEN id % 4 END AS a", "CASE WHEN id % 3 > 0 THEN CONCAT('k', id % 3) END AS b", "id * 37 % 500 AS t")
    w = Window.partitionBy("a", "b").orderBy("t", "id")
    got = ordered.ordered_by_key(made, ["a", "b"], ["t", "id"], lag={"before": "id"}, slices=7)
    assert same(got, made.withColumn("before", F.lag("id").over(w)))
    assert same(ordered.row_number_by_key(made, [], ["t", "id"], "n"), made.withColumn("n", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("t", "id")).cast("long")))


def test_percentiles(rows):
    got = ordered.percentiles_cont(rows, ["k"], "v", {"p50": 0.5, "p90": 0.9})
    want = rows.groupBy("k").agg(F.percentile("v", 0.5).alias("p50"), F.percentile("v", 0.9).alias("p90"))
    a = {r["k"]: (round(r["p50"], 9), round(r["p90"], 9)) for r in got.collect()}
    assert a == {r["k"]: (round(r["p50"], 9), round(r["p90"], 9)) for r in want.collect()}
    lists = {r["k"]: sorted(r["vs"]) for r in rows.groupBy("k").agg(F.collect_list("v").alias("vs")).collect()}
    for r in ordered.percentiles_floor(rows, ["k"], "v", {"p50": 50, "p99": 99, "p100": 100}).collect():
        vs = lists[r["k"]]
        for name, p in (("p50", 50), ("p99", 99), ("p100", 100)):
            assert r[name] == vs[min(p * len(vs) // 100, len(vs) - 1)]


def test_newest_by_key(rows):
    order = [F.desc("t"), F.desc("id")]
    want = rows.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(*order))).where("rn <= 7")
    assert same(ordered.newest_by_key(rows, ["k"], order, "id", 7), want)


def test_skew_join(spark, rows):
    dims = spark.range(12).select(F.col("id").alias("k"), F.concat(F.lit("d"), "id").alias("name"))
    assert [r[0] for r in heavy_keys(rows, "k", 10).collect()] == [1]
    for how in ("inner", "left"):
        want = rows.join(dims, "k", how)
        assert same(skew_join(rows, dims, "k", how).select(want.columns), want)
    with pytest.raises(ValueError):
        skew_join(rows, dims, "k", "full_outer")


def test_empty(spark, rows):
    none = rows.where("id < 0")
    assert ordered.ordered_by_key(none, ["k"], ["t", "id"], lag={"b": "id"}, running={"s": "v"}).count() == 0
    assert ordered.percentiles_cont(none, ["k"], "v", {"p": 0.5}).count() == 0
    assert skew_join(none, rows.select("k").distinct(), "k").count() == 0


def test_instants_across_a_clock_change(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        start = 1729987200  # the night in which clocks go back
        df = spark.range(2000).select("id", F.lit(1).alias("k"), F.timestamp_seconds(F.lit(start) + F.col("id") * 5).alias("t"))
        want = df.withColumn("b", F.lag("id").over(Window.partitionBy("k").orderBy("t", "id")))
        assert same(ordered.ordered_by_key(df, ["k"], ["t", "id"], lag={"b": "id"}), want)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
