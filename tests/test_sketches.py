"""Sketches that are kept and merged against exact distinct counts."""

from pyspark.sql import functions as F

from waybill.operators import sketches


def test_sketches_of_parts_give_the_whole(spark):
    table = spark.range(60_000).selectExpr("id % 17000 AS user", "id % 30 AS day", "CAST(id / 7 AS DOUBLE) AS x")
    days = sketches.distinct_sketches(table, ["day"], "user")
    weeks = sketches.estimated(sketches.merged(days.withColumn("week", F.floor(F.col("day") / 7)), ["week"]), "users")
    exact = {r["week"]: (r["n"], r["rows"]) for r in table.groupBy(F.floor(F.col("day") / 7).alias("week")).agg(F.countDistinct("user").alias("n"), F.count("*").alias("rows")).collect()}
    got = {r["week"]: (r["users"], r["rows"]) for r in weeks.collect()}
    assert got.keys() == exact.keys()
    for week, (n, rows) in exact.items():
        assert got[week][1] == rows and abs(got[week][0] - n) <= 0.03 * n
    # batch after batch: the sketch so far and that of new rows, some of them known already
    whole = sketches.merged(sketches.distinct_sketches(table, ["day"], "user").drop("day").withColumn("all", F.lit(1)), ["all"])
    more = sketches.distinct_sketches(spark.range(10_000, 20_000).withColumn("all", F.lit(1)), ["all"], "id")
    both = sketches.estimated(sketches.merged(whole.unionByName(more), ["all"]), "n").first()["n"]
    assert abs(both - 20_000) <= 0.03 * 20_000


def test_profile_in_one_scan(spark):
    table = spark.range(3000).selectExpr("id", "IF(id % 3 = 0, NULL, CONCAT('v', id % 100)) AS `odd name`", "CAST(id % 50 AS DECIMAL(9,2)) AS d", "TIMESTAMP_SECONDS(id % 10) AS t", "CAST(NULL AS STRING) AS none")
    got = {r["column_name"]: (r["rows"], r["nulls"], r["distinct_estimate"]) for r in sketches.profile_estimates(table).collect()}
    assert abs(got.pop("id")[2] - 3000) <= 90
    assert got == {"odd name": (3000, 1000, 100), "d": (3000, 0, 50), "t": (3000, 0, 10), "none": (3000, 3000, 0)}
    plan = sketches.profile_estimates(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Expand" not in plan  # a row of sketches per task is all that moves
    assert [r["rows"] for r in sketches.profile_estimates(table.limit(0)).collect()] == [0] * 5


def test_quantiles_of_merged_sketches(spark):
    """A hot key over many input splits, values in no order; two levels; days to the whole."""
    table = spark.range(0, 90_000, 1, 150).selectExpr("IF(id % 3 = 0, id % 11, 99) AS k", "id % 7 AS day", "IF(id % 13 = 0, NULL, CAST(id * 7919 % 90000 AS DOUBLE)) AS v")
    days = sketches.quantile_sketches(table, ["k", "day"], "v")
    got = {r["k"]: r for r in sketches.quantiles(sketches.merged_quantiles(days.drop("day"), ["k"]), {"low": 0.01, "mid": 0.5, "top": 0.99}).collect()}
    for r in table.where("v IS NOT NULL").groupBy("k").agg(F.array_sort(F.collect_list("v")).alias("vs")).collect():
        vs, found = r["vs"], got.pop(r["k"])
        assert found["rows"] == len(vs)
        for name, share in (("low", 0.01), ("mid", 0.5), ("top", 0.99)):
            at = sum(v <= found[name] for v in vs) / len(vs)
            assert abs(at - share) < 0.02, (r["k"], name)
    assert not got
    none = sketches.quantile_sketches(table.where("v < 0"), ["k"], "v")
    assert sketches.quantiles(none, {"p": 0.5}).count() == 0
