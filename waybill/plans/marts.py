"""Marts over orders, line items, parts and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from waybill.operators import marts
from waybill.plans.registry import query
from waybill.plans.tables import AS_OF_EVENTS, AS_OF_ORDERS, events_ts, orders_day, orders_ts

M = "CAST({} AS DECIMAL(18,2))"
TOTAL = "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)"

SESSIONS_CTE = """
    marked AS (
        SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 360 MINUTE THEN 1 ELSE 0 END AS opens
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM marked),
    user_sessions AS (
        SELECT user_id, CAST(session_no AS BIGINT) AS session_no, min(ts) AS session_start, max(ts) AS session_end,
               date_sub('second', min(ts), max(ts)) AS duration_seconds,
               count(*) FILTER (event_type = 'view') AS page_views, count(*) AS events_count,
               count(*) = 1 AS bounce, count(*) FILTER (event_type = 'purchase') > 0 AS conversion
        FROM numbered GROUP BY user_id, session_no)"""


@query("customer_order_summary", f"""
    SELECT c.c_custkey, c.c_name, c.c_mktsegment, count(DISTINCT o_orderkey) AS total_orders, {TOTAL} AS lifetime_value,
           {TOTAL} / count(*) AS avg_order_value, CAST(min(o_orderdate) AS DATE) AS first_order_date,
           CAST(max(o_orderdate) AS DATE) AS last_order_date,
           date_diff('day', CAST(max(o_orderdate) AS DATE), {AS_OF_ORDERS}) AS days_since_last_order
    FROM orders JOIN customer c ON o_custkey = c_custkey GROUP BY 1, 2, 3""")
def _(t):
    return marts.customer_order_summary(t.orders, t.customer, orders_day())


@query("order_summary_left", """
    SELECT o_orderkey, c_name, o_orderdate, o_totalprice, count(l_partkey) AS item_count
    FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4""")
def _(t):
    return marts.order_summary_left(t.orders, t.customer, t.lineitem)


@query("user_metrics_left", f"""
    SELECT c_custkey, c_name, order_count, total_revenue FROM {{customers_extra}}
    LEFT JOIN (SELECT o_custkey, count(*) AS order_count FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey
    LEFT JOIN (SELECT o_custkey, {TOTAL} AS total_revenue FROM orders GROUP BY 1) b ON b.o_custkey = c_custkey
    WHERE c_acctbal >= 0""")
def _(t):
    return marts.user_metrics_left(t.customers_extra, t.orders, F.col("c_acctbal") >= 0)


@query("top_customers", f"""
    SELECT c_custkey, c_name, count(DISTINCT o_orderkey) AS order_count, {TOTAL} AS total_revenue
    FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2 ORDER BY 4 DESC""")
def _(t):
    return marts.top_customers(t.customer, t.orders)


UNITS = "CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE)"
REVENUE = "CAST(sum(CAST(l_quantity AS DECIMAL(12,2)) * CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE)"


@query("product_sales", f"""
    SELECT p_name, p_type, {UNITS} AS units_sold, {REVENUE} AS revenue
    FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY 1, 2""")
def _(t):
    return marts.product_sales(t.part, t.lineitem)


@query("order_products_list", """
    SELECT o_orderkey, c_name, o_orderdate, o_totalprice, string_agg(p_name, ', ' ORDER BY p_name) AS products
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
    GROUP BY 1, 2, 3, 4 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10""")
def _(t):
    return marts.order_products_list(t.orders, t.customer, t.lineitem, t.part)


@query("category_performance", f"""
    SELECT p_type, count(DISTINCT p_partkey) AS product_count, count(DISTINCT o_orderkey) AS orders_with_category,
           {UNITS} AS total_units_sold, {REVENUE} AS category_revenue
    FROM part LEFT JOIN lineitem ON p_partkey = l_partkey LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def _(t):
    return marts.category_performance(t.part, t.lineitem, t.orders)


@query("customer_patterns", f"""
    WITH m AS (
        SELECT c_custkey, c_name, count(DISTINCT o_orderkey) AS order_count, {TOTAL} / count(o_orderkey) AS mean,
               date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS customer_lifetime_days
        FROM {{customers_extra}} LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2)
    SELECT c_custkey, c_name, order_count, floor(mean * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS avg_order_value, customer_lifetime_days,
           CASE WHEN order_count >= 2 THEN 'Repeat Customer' WHEN order_count = 1 THEN 'Single Purchase' ELSE 'No Purchase' END AS customer_type
    FROM m""")
def _(t):
    return marts.customer_patterns(t.customers_extra, t.orders)


@query("user_sessions", f"WITH {SESSIONS_CTE} SELECT * FROM user_sessions")
def _(t):
    return marts.user_sessions(t.events, 360)


@query("daily_active_users", f"""
    WITH {SESSIONS_CTE}
    SELECT CAST(session_start AS DATE) AS day, count(DISTINCT user_id) AS dau, count(*) AS total_sessions,
           CAST(sum(duration_seconds) AS DOUBLE) / count(*) AS avg_session_duration,
           CAST(count(*) FILTER (bounce) AS DOUBLE) / count(*) AS bounce_rate
    FROM user_sessions WHERE session_start >= {AS_OF_EVENTS} - INTERVAL 90 DAY GROUP BY 1""")
def _(t):
    return marts.daily_active_users(marts.user_sessions(t.events, 360), events_ts())


@query("ltv_cohorts", f"""
    WITH c AS (SELECT o_custkey, min(o_orderdate) AS first, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS ltv FROM orders GROUP BY 1)
    SELECT CAST(date_trunc('month', first) AS DATE) AS cohort_month, count(*) AS customers, CAST(sum(ltv) AS DOUBLE) / count(*) AS avg_ltv,
           floor(quantile_cont(CAST(ltv AS DOUBLE), 0.5) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS median_ltv,
           floor(quantile_cont(CAST(ltv AS DOUBLE), 0.9) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS p90_ltv,
           CAST(sum(ltv) AS DOUBLE) AS total_ltv
    FROM c GROUP BY 1""")
def _(t):
    return marts.ltv_cohorts(t.orders)


@query("ab_test_summary", """
    WITH g AS (
        SELECT test_id, variant, count(DISTINCT user_id) AS users, count(*) AS n, CAST(sum(conversion) AS BIGINT) AS conversions,
               CAST(sum(conversion) AS DOUBLE) / count(*) AS conversion_rate,
               CAST(sum(revenue) AS DOUBLE) / count(*) AS avg_revenue_per_user, CAST(sum(revenue) AS DOUBLE) AS total_revenue
        FROM {ab_results} GROUP BY 1, 2)
    SELECT test_id, variant, users, conversions, conversion_rate, avg_revenue_per_user, total_revenue,
           CASE WHEN n > 50 AND abs(conversion_rate - lag(conversion_rate) OVER (PARTITION BY test_id ORDER BY variant)) > 0.05
                THEN 'Significant' ELSE 'Not Significant' END AS significance
    FROM g""")
def _(t):
    return marts.ab_test_summary(t.ab_results, min_n=50)


@query("daily_score_stats", f"""
    SELECT CAST(ts AS DATE) AS day, count(*) AS count, CAST(sum({M.format('value')}) AS DOUBLE) / count(*) AS avg_score,
           max(value) AS max_score, min(value) AS min_score
    FROM events WHERE ts > {AS_OF_EVENTS} - INTERVAL 30 DAY GROUP BY 1""")
def _(t):
    return marts.daily_score_stats(t.events, "ts", "value", events_ts())


PART_MEAN = f"CAST(sum({M.format('p_retailprice')}) AS DOUBLE) / count(*)"
PART_DEV = "floor(stddev_samp(p_retailprice) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE"


@query("category_view", f"""
    SELECT p_type, count(*) AS user_count, {PART_MEAN} AS avg_score FROM part WHERE p_size >= 5 GROUP BY 1""")
def _(t):
    return marts.category_view(t.part, "p_type", "p_retailprice", F.col("p_size") >= 5)


@query("category_stddev", f"""
    SELECT p_type, count(*) AS user_count, {PART_MEAN} AS avg_score, {PART_DEV} AS stddev_score FROM part GROUP BY 1""")
def _(t):
    return marts.category_stddev(t.part, "p_type", "p_retailprice")


@query("top_n_per_category", f"""
    WITH s AS (
        SELECT p_type, count(*) AS user_count, {PART_MEAN} AS avg_score, {PART_DEV} AS stddev_score,
               quantile_cont(p_retailprice, 0.5) AS med FROM part GROUP BY 1),
    r AS (SELECT p_partkey, p_type, p_retailprice, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part)
    SELECT p_partkey, r.p_type, p_retailprice, rank, avg_score AS category_avg,
           floor(med * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS median_score, user_count, stddev_score,
           floor((p_retailprice - avg_score) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS score_diff
    FROM r JOIN s ON r.p_type = s.p_type WHERE rank <= 10""")
def _(t):
    return marts.top_n_per_category(t.part, "p_type", "p_retailprice", "p_partkey")


@query("graded_top100", """
    SELECT p_partkey, p_retailprice, CASE WHEN p_retailprice > 1500 THEN 'A' WHEN p_retailprice > 1200 THEN 'B'
           WHEN p_retailprice > 1000 THEN 'C' ELSE 'D' END AS grade
    FROM part WHERE p_size >= 5 ORDER BY p_retailprice DESC, p_partkey LIMIT 100""")
def _(t):
    return marts.graded_top(
        t.part, "p_partkey", "p_retailprice", F.col("p_size") >= 5, [(1500, "A"), (1200, "B"), (1000, "C")], "D"
    )


@query("update_from_aggregate", f"""
    WITH s AS (SELECT p_type, {PART_MEAN} AS m FROM part WHERE p_size > 10 GROUP BY 1)
    SELECT p_partkey, part.p_type,
           CASE WHEN m IS NOT NULL AND p_retailprice < m THEN floor(m * 1.05::DOUBLE * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE ELSE p_retailprice END AS p_retailprice,
           m IS NOT NULL AND p_retailprice < m AS updated
    FROM part LEFT JOIN s ON part.p_type = s.p_type""")
def _(t):
    return marts.update_from_aggregate(
        t.part.select("p_partkey", "p_type", "p_retailprice", "p_size"), "p_type", "p_retailprice", F.col("p_size") > 10
    ).drop("p_size")


@query("product_metrics", """
    SELECT CAST(ts AS DATE) AS day, product_id, count(*) FILTER (event_type = 'view') AS views,
           count(*) FILTER (event_type = 'click') AS add_to_carts, count(*) FILTER (event_type = 'purchase') AS purchases,
           coalesce(CAST(sum(value) FILTER (event_type = 'purchase') AS DOUBLE), 0.0::DOUBLE) AS revenue,
           coalesce(CAST(count(*) FILTER (event_type = 'purchase') AS DOUBLE) / nullif(count(*) FILTER (event_type = 'view'), 0), 0.0::DOUBLE) AS conversion_rate
    FROM {product_events} GROUP BY 1, 2""")
def _(t):
    return marts.product_metrics(t.product_events)


@query("product_rolling_rank", f"""
    WITH d AS (
        SELECT CAST(l_shipdate AS DATE) AS day, l_partkey, sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS amount
        FROM lineitem WHERE l_shipdate >= {AS_OF_ORDERS} - INTERVAL 30 DAY AND l_shipdate < {AS_OF_ORDERS} GROUP BY 1, 2)
    SELECT day, l_partkey, CAST(amount AS DOUBLE) AS revenue,
           CAST(sum(amount) OVER (PARTITION BY l_partkey ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS DOUBLE) AS revenue_7day_rolling,
           rank() OVER (PARTITION BY day ORDER BY amount DESC) AS daily_revenue_rank
    FROM d""")
def _(t):
    return marts.product_rolling_rank(t.lineitem, orders_ts())


@query("monthly_sales_trends", f"""
    WITH m AS (
        SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, count(DISTINCT o_orderkey) AS order_count,
               count(DISTINCT o_custkey) AS unique_customers, {TOTAL} AS total_revenue, {TOTAL} / count(*) AS avg_order_value
        FROM orders GROUP BY 1, 2)
    SELECT *, lag(total_revenue) OVER w AS prev_month_revenue,
           (total_revenue - lag(total_revenue) OVER w) / nullif(lag(total_revenue) OVER w, 0) * 100 AS month_over_month_growth
    FROM m WINDOW w AS (ORDER BY year, month)""")
def _(t):
    return marts.monthly_sales_trends(t.orders)


@query("customer_segments", f"""
    WITH c AS (SELECT o_custkey, {TOTAL} AS lifetime_value, CAST(max(o_orderdate) AS DATE) AS last_activity_date FROM orders GROUP BY 1),
    r AS (SELECT *, floor(least(1.0::DOUBLE, CAST(date_diff('day', last_activity_date, {AS_OF_ORDERS}) AS DOUBLE) / 365.0::DOUBLE) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS churn_risk_score FROM c)
    SELECT *, CASE WHEN churn_risk_score >= 1.0 THEN 'Lost' WHEN churn_risk_score >= 0.5 THEN 'At Risk'
                   WHEN lifetime_value >= 2000000 THEN 'Champion' ELSE 'Active' END AS segment_name FROM r""")
def _(t):
    return marts.customer_segments(t.orders, orders_day())
