"""Customer, product and engagement marts.

Facts are aggregated to the join key before they are joined, so a hot customer or product
travels as one row per map task; where row detail is needed, ``skew_join`` spreads hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.functions.numbers import half_up, mean, money, price, ratio, total
from waybill.operators.ordered import newest_by_key, percentiles_cont, rank_by_key
from waybill.operators.sessions import sessions
from waybill.operators.skew import skew_join


def customer_order_summary(orders: DataFrame, customers: DataFrame, as_of: Column) -> DataFrame:
    per_customer = orders.groupBy("o_custkey").agg(
        F.count_distinct("o_orderkey").alias("total_orders"),
        total(money("o_totalprice")).alias("lifetime_value"),
        mean(money("o_totalprice")).alias("avg_order_value"),
        F.min("o_orderdate").cast("date").alias("first_order_date"),
        F.max("o_orderdate").cast("date").alias("last_order_date"),
    )
    return per_customer.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        "c_custkey",
        "c_name",
        "c_mktsegment",
        "total_orders",
        "lifetime_value",
        "avg_order_value",
        "first_order_date",
        "last_order_date",
        F.date_diff(as_of, "last_order_date").cast("long").alias("days_since_last_order"),
    )


def order_summary_left(orders: DataFrame, customers: DataFrame, items: DataFrame) -> DataFrame:
    counted = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("l_partkey").alias("n"))
    names = customers.select(F.col("c_custkey").alias("o_custkey"), "c_name")
    named = skew_join(orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"), names, "o_custkey")
    return named.join(counted, "o_orderkey", "left").select(
        "o_orderkey", "c_name", "o_orderdate", "o_totalprice", F.coalesce("n", F.lit(0).cast("long")).alias("item_count")
    )


def user_metrics_left(customers: DataFrame, orders: DataFrame, active: Column) -> DataFrame:
    per_customer = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("order_count"), total(money("o_totalprice")).alias("total_revenue")
    )
    return (
        customers.where(active)
        .join(per_customer, "c_custkey", "left")
        .select("c_custkey", "c_name", "order_count", "total_revenue")
    )


def top_customers(customers: DataFrame, orders: DataFrame) -> DataFrame:
    per_customer = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count_distinct("o_orderkey").alias("order_count"), total(money("o_totalprice")).alias("total_revenue")
    )
    return (
        customers.join(per_customer, "c_custkey")
        .select("c_custkey", "c_name", "order_count", "total_revenue")
        .orderBy(F.desc("total_revenue"), "c_custkey")
    )


def product_sales(parts: DataFrame, items: DataFrame) -> DataFrame:
    per_part = items.groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.sum(price("l_quantity")).alias("units"),
        F.sum(price("l_quantity") * price("l_extendedprice")).alias("amount"),
    )
    return (
        parts.join(per_part, "p_partkey")
        .groupBy("p_name", "p_type")
        .agg(total(F.col("units")).alias("units_sold"), total(F.col("amount")).alias("revenue"))
        .orderBy(F.desc("revenue"), "p_name", "p_type")
    )


def order_products_list(orders, customers, items, parts, newest: int = 10) -> DataFrame:
    """The newest orders that have items, each with the sorted names of its products.

    These orders are found once; their keys, ``newest`` numbers, are literals of the plan and reach the scan of the items.
    """
    with_items = orders.join(items.select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "left_semi")
    newest_orders = (
        with_items.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
        .orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
        .limit(newest)
    )
    found = newest_orders.toArrow()
    newest_orders = orders.sparkSession.createDataFrame(found, newest_orders.schema)
    per_part = (
        items.where(F.col("l_orderkey").isin(found.column("o_orderkey").to_pylist()))
        .select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
        .groupBy("o_orderkey", "p_partkey")
        .agg(F.count("*").alias("n"))
    )
    names = per_part.join(parts.select("p_partkey", "p_name"), "p_partkey").groupBy("o_orderkey", "p_name").agg(F.sum("n").cast("int").alias("n"))
    listed = names.groupBy("o_orderkey").agg(F.sort_array(F.collect_list(F.struct("p_name", "n"))).alias("names"))
    repeated = F.flatten(F.transform("names", lambda x: F.array_repeat(x["p_name"], x["n"])))
    return (
        newest_orders.join(listed, "o_orderkey")
        .join(customers.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
        .select("o_orderkey", "c_name", "o_orderdate", "o_totalprice", F.array_join(repeated, ", ").alias("products"))
    )


def category_performance(parts: DataFrame, items: DataFrame, orders: DataFrame) -> DataFrame:
    sold = skew_join(
        items.select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_quantity", "l_extendedprice"),
        parts.select("p_partkey", "p_type"),
        "p_partkey",
    )
    per_order = sold.groupBy("p_type", "l_orderkey").agg(
        F.sum(price("l_quantity")).alias("units"),
        F.sum(price("l_quantity") * price("l_extendedprice")).alias("amount"),
    )
    known = orders.select("o_orderkey")
    per_category = (
        per_order.join(known, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .groupBy("p_type")
        .agg(
            F.count("o_orderkey").alias("orders_with_category"),
            total(F.col("units")).alias("total_units_sold"),
            total(F.col("amount")).alias("category_revenue"),
        )
    )
    products = parts.groupBy("p_type").agg(F.count_distinct("p_partkey").alias("product_count"))
    return products.join(per_category, "p_type", "left").select(
        "p_type",
        "product_count",
        F.coalesce("orders_with_category", F.lit(0).cast("long")).alias("orders_with_category"),
        "total_units_sold",
        "category_revenue",
    )


def customer_patterns(customers: DataFrame, orders: DataFrame) -> DataFrame:
    per_customer = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count_distinct("o_orderkey").alias("n"),
        mean(money("o_totalprice")).alias("mean"),
        F.date_diff(F.max("o_orderdate"), F.min("o_orderdate")).cast("long").alias("customer_lifetime_days"),
    )
    n = F.coalesce("n", F.lit(0).cast("long"))
    return customers.join(per_customer, "c_custkey", "left").select(
        "c_custkey",
        "c_name",
        n.alias("order_count"),
        half_up(F.col("mean"), 2).alias("avg_order_value"),
        "customer_lifetime_days",
        F.when(n >= 2, "Repeat Customer").when(n == 1, "Single Purchase").otherwise("No Purchase").alias("customer_type"),
    )


def user_sessions(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    kind = F.col("event_type")
    found = sessions(
        events.select("user_id", "ts", "event_id", "event_type"),
        "user_id",
        "ts",
        "event_id",
        gap_minutes,
        {"page_views": kind == "view", "__purchases": kind == "purchase"},
    )
    return found.select(
        "user_id",
        "session_no",
        "session_start",
        "session_end",
        F.timestamp_diff("SECOND", F.col("session_start"), F.col("session_end")).alias("duration_seconds"),
        "page_views",
        "events_count",
        (F.col("events_count") == 1).alias("bounce"),
        (F.col("__purchases") > 0).alias("conversion"),
    )


def daily_active_users(user_sessions: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    return (
        user_sessions.where(F.col("session_start") >= as_of - F.expr(f"INTERVAL '{days}' DAY"))
        .groupBy(F.col("session_start").cast("date").alias("day"))
        .agg(
            F.count_distinct("user_id").alias("dau"),
            F.count("*").alias("total_sessions"),
            mean(F.col("duration_seconds")).alias("avg_session_duration"),
            (F.count_if("bounce").cast("double") / F.count("*")).alias("bounce_rate"),
        )
    )


def ltv_cohorts(orders: DataFrame, approximate: bool = False) -> DataFrame:
    """Customers by month of first order; exact interpolated percentiles unless ``approximate``."""
    per_customer = (
        orders.groupBy("o_custkey")
        .agg(F.min("o_orderdate").alias("first"), F.sum(money("o_totalprice")).alias("ltv"))
        .select(F.trunc(F.col("first").cast("date"), "month").alias("cohort_month"), F.col("ltv").cast("decimal(18,2)").alias("ltv"), F.col("ltv").cast("double").alias("value"))
    )
    sums = per_customer.groupBy("cohort_month").agg(
        F.count("*").alias("customers"),
        mean(F.col("ltv")).alias("avg_ltv"),
        total(F.col("ltv")).alias("total_ltv"),
        *(
            [F.percentile_approx("value", 0.5).alias("median_ltv"), F.percentile_approx("value", 0.9).alias("p90_ltv")]
            if approximate
            else []
        ),
    )
    if approximate:
        return sums
    marks = percentiles_cont(per_customer, ["cohort_month"], "value", {"median_ltv": 0.5, "p90_ltv": 0.9})
    return sums.join(marks, "cohort_month").select(
        "cohort_month",
        "customers",
        "avg_ltv",
        half_up(F.col("median_ltv"), 4).alias("median_ltv"),
        half_up(F.col("p90_ltv"), 4).alias("p90_ltv"),
        "total_ltv",
    )


def ab_test_summary(results: DataFrame, min_n: int = 100, min_change: float = 0.05) -> DataFrame:
    rate = F.sum("conversion").cast("double") / F.count("*")
    per_variant = results.groupBy("test_id", "variant").agg(
        F.count_distinct("user_id").alias("users"),
        F.count("*").alias("n"),
        F.sum("conversion").alias("conversions"),
        rate.alias("conversion_rate"),
        mean(F.col("revenue")).alias("avg_revenue_per_user"),
        total(F.col("revenue")).alias("total_revenue"),
    )
    before = F.lag("conversion_rate").over(Window.partitionBy("test_id").orderBy("variant"))
    moved = (F.col("n") > min_n) & (F.abs(F.col("conversion_rate") - before) > min_change)
    return per_variant.withColumn(
        "significance", F.when(moved, "Significant").otherwise("Not Significant")
    ).drop("n")


def daily_score_stats(rows: DataFrame, ts: str, score: str, as_of: Column, days: int = 30) -> DataFrame:
    return (
        rows.where(F.col(ts) > as_of - F.expr(f"INTERVAL '{days}' DAY"))
        .groupBy(F.date_trunc("day", ts).cast("date").alias("day"))
        .agg(
            F.count("*").alias("count"),
            mean(money(score)).alias("avg_score"),
            F.max(score).alias("max_score"),
            F.min(score).alias("min_score"),
        )
        .orderBy(F.desc("day"))
    )


def category_view(rows: DataFrame, category: str, score: str, active: Column) -> DataFrame:
    return rows.where(active).groupBy(category).agg(F.count("*").alias("user_count"), mean(money(score)).alias("avg_score"))


def category_stddev(rows: DataFrame, category: str, score: str) -> DataFrame:
    return rows.groupBy(category).agg(
        F.count("*").alias("user_count"),
        mean(money(score)).alias("avg_score"),
        half_up(F.stddev_samp(score), 6).alias("stddev_score"),
    )


def top_n_per_category(rows: DataFrame, category: str, score: str, key: str, n: int = 10) -> DataFrame:
    best = newest_by_key(rows.select(category, score, key), [category], [F.desc(score), F.asc(key)], key, n, "rank")
    stats = category_stddev(rows, category, score)
    middle = percentiles_cont(rows.select(category, score), [category], score, {"median_score": 0.5})
    # at most n rows per category remain on the left
    return (
        best.join(stats, category)
        .join(middle, category)
        .select(
            key,
            category,
            score,
            F.col("rank").cast("long").alias("rank"),
            F.col("avg_score").alias("category_avg"),
            half_up(F.col("median_score"), 6).alias("median_score"),
            "user_count",
            "stddev_score",
            half_up(F.col(score) - F.col("avg_score"), 6).alias("score_diff"),
        )
    )


def graded_top(rows: DataFrame, key: str, score: str, active: Column, grades: list[tuple[float, str]], otherwise: str, n: int = 100) -> DataFrame:
    """Letter grade by descending lower bounds, best ``n`` rows first."""
    grade = None
    for bound, letter in grades:
        hit = F.col(score) > bound
        grade = F.when(hit, letter) if grade is None else grade.when(hit, letter)
    return (
        rows.where(active)
        .select(key, score, grade.otherwise(otherwise).alias("grade"))
        .orderBy(F.desc(score), F.asc(key))
        .limit(n)
    )


def update_from_aggregate(rows: DataFrame, category: str, score: str, recent: Column, factor: float = 1.05) -> DataFrame:
    """Image of the table after raising below-average scores to ``factor`` times the category mean."""
    means = rows.where(recent).groupBy(category).agg(mean(money(score)).alias("__mean"))
    raised = F.col("__mean").isNotNull() & (F.col(score) < F.col("__mean"))
    return (
        skew_join(rows, means, category, "left")
        .withColumn("updated", raised)
        .withColumn(score, F.when(raised, half_up(F.col("__mean") * F.lit(factor), 4)).otherwise(F.col(score)))
        .drop("__mean")
    )


def product_metrics(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    views, buys = F.count_if(kind == "view"), F.count_if(kind == "purchase")
    return events.groupBy(F.col("ts").cast("date").alias("day"), "product_id").agg(
        views.alias("views"),
        F.count_if(kind == "click").alias("add_to_carts"),
        buys.alias("purchases"),
        F.coalesce(total(F.when(kind == "purchase", F.col("value"))), F.lit(0.0)).alias("revenue"),
        ratio(buys, views).alias("conversion_rate"),
    )


def product_rolling_rank(items: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Seven-row rolling revenue per product and the product's revenue rank of the day."""
    recent = items.where((F.col("l_shipdate") >= as_of - F.expr(f"INTERVAL '{days}' DAY")) & (F.col("l_shipdate") < as_of))
    daily = recent.groupBy(F.col("l_shipdate").cast("date").alias("day"), "l_partkey").agg(
        F.sum(price("l_extendedprice")).alias("amount")
    )
    # a product has at most one row per day of the window, so this partition is bounded
    week = Window.partitionBy("l_partkey").orderBy("day").rowsBetween(-6, 0)
    rolled = daily.withColumn("revenue_7day_rolling", F.sum("amount").over(week).cast("double"))
    falling = rolled.withColumn("__falling", -F.col("amount"))
    return rank_by_key(falling, ["day"], ["__falling", "l_partkey"], "daily_revenue_rank").select(
        "day", "l_partkey", F.col("amount").cast("double").alias("revenue"), "revenue_7day_rolling", "daily_revenue_rank"
    )


def monthly_sales_trends(orders: DataFrame) -> DataFrame:
    month = [F.year("o_orderdate").cast("long").alias("year"), F.month("o_orderdate").cast("long").alias("month")]
    # one distinct count per aggregate: two in one would repeat every row before the shuffle
    sales = orders.groupBy(*month).agg(
        F.count_distinct("o_orderkey").alias("order_count"),
        total(money("o_totalprice")).alias("total_revenue"),
        mean(money("o_totalprice")).alias("avg_order_value"),
    )
    buyers = orders.groupBy(*month).agg(F.count_distinct("o_custkey").alias("unique_customers"))
    monthly = sales.join(buyers, ["year", "month"])
    # one row per month: a single window partition holds the calendar, not the data
    before = F.lag("total_revenue").over(Window.orderBy("year", "month"))
    return monthly.withColumn("prev_month_revenue", before).withColumn(
        "month_over_month_growth",
        F.try_divide(F.col("total_revenue") - F.col("prev_month_revenue"), F.nullif(F.col("prev_month_revenue"), F.lit(0.0))) * 100,
    )


def customer_segments(orders: DataFrame, as_of: Column) -> DataFrame:
    """Lifetime value, last activity and churn risk = min(1, days since last order / 365)."""
    per_customer = orders.groupBy("o_custkey").agg(
        total(money("o_totalprice")).alias("lifetime_value"), F.max("o_orderdate").cast("date").alias("last_activity_date")
    )
    risk = F.least(F.lit(1.0), F.date_diff(as_of, "last_activity_date").cast("double") / F.lit(365.0))
    return per_customer.withColumn("churn_risk_score", half_up(risk, 2)).withColumn(
        "segment_name",
        F.when(F.col("churn_risk_score") >= 1.0, "Lost")
        .when(F.col("churn_risk_score") >= 0.5, "At Risk")
        .when(F.col("lifetime_value") >= 2000000, "Champion")
        .otherwise("Active"),
    )
