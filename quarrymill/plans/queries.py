"""Queries over the driver's star schema, each with equal SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import cleaning
from ..functions.numeric import dsum, half_even
from ..operators import anomalies, metrics, tables, validation

JOINS = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sales(spark: SparkSession, d: str) -> DataFrame:
    """Sales rows from the star schema; discounts and some quantities are stretched, so that all branches occur.

    No hints: dimension sizes vary, so the planner and adaptive execution choose broadcast or shuffled joins by size. Orders
    meet their customers first, so that lines are shuffled twice at most, and not once for each dimension.
    """
    o = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    j = _t(spark, d, "lineitem").join(_t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    s = j.select(
        F.col("o_orderkey").cast("string").alias("order_id"), F.col("p_name").alias("product_name"), F.col("p_type").alias("category"),
        (F.col("l_quantity").cast("int") * F.when(F.col("l_partkey") % 97 == 0, 40).otherwise(1)).alias("quantity"), F.col("p_retailprice").alias("unit_price"),
        F.when(F.col("l_partkey") % 7 == 0, F.col("l_discount") * 5).otherwise(F.col("l_discount")).alias("discount_percent"), F.col("r_name").alias("region"), F.col("o_orderdate").alias("sale_date"),
        F.concat(F.lower(F.translate("c_name", "#", "_")), F.lit("@example.com")).alias("customer_email"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"),
    )
    return s.withColumn("revenue", (F.rint(F.col("quantity") * F.col("unit_price") * (1 - F.col("discount_percent")) * 10000) / 10000))


SALES = f"""sales AS (SELECT *, round_even(quantity * unit_price * (1 - discount_percent) * 10000, 0) / 10000 AS revenue FROM (SELECT o_orderkey::VARCHAR AS order_id, p_name AS product_name, p_type AS category,
    (trunc(l_quantity)::INT * CASE WHEN l_partkey % 97 = 0 THEN 40 ELSE 1 END) AS quantity, p_retailprice AS unit_price, CASE WHEN l_partkey % 7 = 0 THEN l_discount * 5 ELSE l_discount END AS discount_percent,
    r_name AS region, o_orderdate AS sale_date, lower(replace(c_name, '#', '_')) || '@example.com' AS customer_email, l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier {JOINS}))"""


def _r(x: str, n: int = 2) -> str:
    return f"(round_even(({x}) * {10**n}.0::DOUBLE, 0) / {10**n}.0::DOUBLE)"


def _s(x: str) -> str:
    return f"sum(CAST({x} AS DECIMAL(20,6)))::DOUBLE"


def _a(x: str) -> str:
    return f"({_s(x)} / nullif(count({x}), 0))"


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, make, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, d: make(sales(spark, d))
    if sql:
        ORACLES[name] = f"WITH {SALES} {sql}"


MONTHLY = f"""SELECT *, {_r('total_revenue / nullif(unique_orders, 0)')} AS avg_order_value FROM (SELECT strftime(sale_date, '%Y-%m') AS month, {_r(_s('revenue'))} AS total_revenue, count(revenue) AS transaction_count,
    sum(quantity)::BIGINT AS total_quantity, {_r(_a('discount_percent'))} AS avg_discount, count(DISTINCT order_id) AS unique_orders FROM sales WHERE sale_date IS NOT NULL GROUP BY 1)"""
_query("agg1_monthly_sales_summary", tables.monthly_sales_summary, MONTHLY)

PRODUCTS = f"""SELECT product_name, {_r(_s('revenue'))} AS total_revenue, sum(quantity)::BIGINT AS total_units, {_r(_a('unit_price'))} AS avg_unit_price, {_r(_a('discount_percent'))} AS avg_discount,
    count(DISTINCT order_id) AS order_count, min(category) AS category FROM sales WHERE product_name IS NOT NULL GROUP BY 1"""
_query("agg2_top_products", tables.top_products, f""", p AS ({PRODUCTS}), r AS (SELECT *, dense_rank() OVER (ORDER BY total_revenue DESC)::INT AS revenue_rank, dense_rank() OVER (ORDER BY total_units DESC)::INT AS units_rank,
    row_number() OVER (ORDER BY total_revenue DESC, product_name) AS a, row_number() OVER (ORDER BY total_units DESC, product_name) AS b FROM p)
    SELECT * EXCLUDE (a, b), CASE WHEN revenue_rank <= 10 THEN 'Revenue' WHEN units_rank <= 10 THEN 'Units' ELSE 'Both' END AS top_reason FROM r WHERE a <= 10 OR b <= 10""")

_query("agg3_region_wise_performance", tables.region_wise_performance, f""", g AS (SELECT region, {_r(_s('revenue'))} AS total_revenue, {_r(_a('revenue'))} AS avg_revenue_per_transaction, sum(quantity)::BIGINT AS total_quantity,
    {_r(_a('unit_price'))} AS avg_unit_price, {_r(_a('discount_percent'))} AS avg_discount, count(DISTINCT order_id) AS unique_orders FROM sales GROUP BY 1),
    c AS (SELECT region, category AS top_category, row_number() OVER (PARTITION BY region ORDER BY {_s('revenue')} DESC, category) AS n FROM sales GROUP BY region, category)
    SELECT g.*, top_category, {_r('total_revenue / nullif(unique_orders, 0)')} AS avg_order_value, {_r('total_quantity / nullif(unique_orders, 0)')} AS avg_items_per_order,
    {_r('total_revenue / ' + _s('total_revenue').replace('::DOUBLE', '') + ' OVER ()::DOUBLE * 100')} AS market_share_pct, row_number() OVER (ORDER BY total_revenue DESC, region)::INT AS performance_rank FROM g JOIN c USING (region) WHERE n = 1""")

_query("agg4_category_discount_map", tables.category_discount_map, f""", g AS (SELECT category, {_r(_a('discount_percent'), 4)} AS avg_discount, {_r('quantile_cont(discount_percent, 0.5)', 4)} AS median_discount, {_r('stddev_samp(discount_percent)', 4)} AS discount_std,
    {_r('min(discount_percent)', 4)} AS min_discount, {_r('max(discount_percent)', 4)} AS max_discount, {_r(_s('revenue'), 4)} AS total_revenue, sum(quantity)::BIGINT AS total_quantity, count(DISTINCT order_id) AS order_count,
    count(DISTINCT CASE WHEN discount_percent > 0 THEN order_id END) AS d FROM sales GROUP BY 1)
    SELECT * EXCLUDE (d), {_r('total_revenue * avg_discount')} AS discount_effectiveness_score, {_r('d / order_count * 100')} AS discount_penetration_pct, {_r('total_revenue * avg_discount / order_count')} AS avg_discount_amount,
    CASE WHEN avg_discount < 0.05 THEN 'Low Discount' WHEN avg_discount < 0.15 THEN 'Moderate Discount' WHEN avg_discount < 0.3 THEN 'High Discount' ELSE 'Very High Discount' END AS discount_strategy FROM g""")

_query("alt2_dashboard_products", tables.dashboard_products, f""", p AS ({PRODUCTS}), b AS (SELECT * FROM p ORDER BY total_revenue DESC, product_name LIMIT 20)
    SELECT *, row_number() OVER (ORDER BY total_revenue DESC, product_name)::INT AS revenue_rank, row_number() OVER (ORDER BY total_units DESC, product_name)::INT AS units_rank FROM b""")
_query("alt1_dashboard_monthly", lambda s: tables.dashboard_monthly(s).withColumns({c: half_even(F.col(c), 4) for c in ("total_revenue", "avg_discount", "avg_order_value")}),
       f"""SELECT month, {_r('t', 4)} AS total_revenue, total_quantity, {_r('d', 4)} AS avg_discount, unique_orders, {_r('t / unique_orders', 4)} AS avg_order_value FROM (SELECT strftime(sale_date, '%Y-%m') AS month, {_s('revenue')} AS t, sum(quantity)::BIGINT AS total_quantity,
       {_a('discount_percent')} AS d, count(DISTINCT order_id) AS unique_orders FROM sales GROUP BY 1)""")
_query("alt4_dashboard_discounts", lambda s: tables.dashboard_discounts(s).withColumns({c: half_even(F.col(c), 4) for c in ("total_revenue", "avg_discount", "discount_penetration", "discount_effectiveness")}),
       f"""SELECT category, {_r('d', 4)} AS avg_discount, discount_count, {_r('t', 4)} AS total_revenue, {_r('discount_count / n * 100', 4)} AS discount_penetration, {_r('t / (d * 100 + 1)', 4)} AS discount_effectiveness FROM (SELECT category, {_a('discount_percent')} AS d,
       count(*) FILTER (discount_percent > 0) AS discount_count, {_s('revenue')} AS t, count(*) AS n FROM sales GROUP BY 1)""")
_query("dsh1_dashboard_metrics", lambda s: tables.dashboard_metrics(tables.monthly_sales_summary(s)))

_MARKS = {0.25: "revenue_25th_percentile", 0.5: "median_revenue_per_transaction", 0.75: "revenue_75th_percentile", 0.9: "revenue_90th_percentile", 0.95: "revenue_95th_percentile", 0.99: "revenue_99th_percentile"}
_LOOSE = ("avg_monthly_growth_rate", "monthly_growth_volatility", "total_growth_rate", "top_10_percent_customer_contribution", "avg_customer_lifetime_value", "median_customer_lifetime_value")


def _met1_sql(rows: str) -> str:
    """rows: SQL for the sales rows; some may have no date."""
    return f""", a AS ({rows}), d AS (SELECT * FROM a WHERE sale_date IS NOT NULL), m AS (SELECT strftime(sale_date, '%Y-%m') AS month, {_s('revenue')} AS r FROM d GROUP BY 1), g AS (SELECT *, (r - lag(r) OVER (ORDER BY month)) / lag(r) OVER (ORDER BY month) AS g FROM m),
       k AS (SELECT revenue, row_number() OVER (ORDER BY revenue DESC) AS n, count(*) OVER () AS c FROM d), u AS (SELECT customer_email, {_s('revenue')} AS r FROM d GROUP BY 1), v AS (SELECT r, row_number() OVER (ORDER BY r DESC) AS n, count(*) OVER () AS c FROM u)
       SELECT {_r(_s('revenue'))} AS total_revenue, {_r(_a('revenue'))} AS avg_revenue_per_transaction, {_r('stddev_samp(revenue)')} AS revenue_standard_deviation, {', '.join(f"{_r(f'quantile_cont(revenue, {p})')} AS {n}" for p, n in _MARKS.items())},
       (SELECT count(*) FROM d) AS total_transactions, (SELECT {_r(_a('quantity'))} FROM d) AS avg_transaction_size, (SELECT {_r(_a('unit_price'))} FROM d) AS avg_unit_price,
       {_r('(SELECT ' + _s('revenue') + ' FROM k WHERE n <= floor(c * 0.05)) / ' + _s('revenue'), 4)} AS revenue_concentration_ratio, {_r('(SELECT avg(g) FROM g)', 6)} AS avg_monthly_growth_rate, {_r('(SELECT stddev_samp(g) FROM g)', 6)} AS monthly_growth_volatility,
       {_r('(SELECT (max_by(r, month) - min_by(r, month)) / min_by(r, month) FROM m)', 6)} AS total_growth_rate, {_r('(SELECT ' + _s('r') + ' FROM v WHERE n <= floor(c * 0.1)) / ' + _s('revenue'), 6)} AS top_10_percent_customer_contribution,
       {_r('(SELECT ' + _a('r') + ' FROM u)', 6)} AS avg_customer_lifetime_value, {_r('(SELECT quantile_cont(r, 0.5) FROM u)', 6)} AS median_customer_lifetime_value FROM a"""


def _met1(s: DataFrame) -> DataFrame:
    return metrics.revenue_metrics(s).withColumns({c: half_even(F.col(c), 6) for c in _LOOSE})


_query("met1_revenue_metrics", _met1, _met1_sql("SELECT * FROM sales"))
_query("met1_some_dates_missing", lambda s: _met1(s.withColumn("sale_date", F.when(F.col("part") % 5 != 0, F.col("sale_date")))), _met1_sql("SELECT * REPLACE (CASE WHEN part % 5 <> 0 THEN sale_date END AS sale_date) FROM sales"))
_query("met2_discount_effectiveness", metrics.discount_effectiveness)
_query("met2_category_effectiveness", metrics.category_effectiveness, f"SELECT category, coalesce({_r(_a('CASE WHEN discount_percent > 0 THEN revenue END') + ' / ' + _a('CASE WHEN discount_percent = 0 THEN revenue END'), 4)}, 0) AS effectiveness_ratio FROM sales GROUP BY 1")
_query("met3_regional_performance", metrics.regional_performance)


def _anomaly_sql(m: str, c: str) -> str:
    lo, hi = f"{m}_a - 1.5 * ({m}_b - {m}_a)", f"{m}_b + 1.5 * ({m}_b - {m}_a)"
    iqr = f"{c} > {hi}" if m == "quantity" else f"({c} > {hi} OR {c} < {lo})"
    return f"count(*) FILTER (abs({c} - {m}_m) / {m}_s > 3) AS {m}_zscore, count(*) FILTER ({iqr}) AS {m}_iqr"


_STATS = ", ".join(f"avg({c}) AS {m}_m, stddev_samp({c}) AS {m}_s, quantile_cont({c}, 0.25) AS {m}_a, quantile_cont({c}, 0.75) AS {m}_b" for m, c in anomalies.MEASURES.items())
_ANY = " OR ".join(f"abs({c} - {m}_m) / {m}_s > 3 OR {c} > {m}_b + 1.5 * ({m}_b - {m}_a)" + ("" if m == "quantity" else f" OR {c} < {m}_a - 1.5 * ({m}_b - {m}_a)") for m, c in anomalies.MEASURES.items())
_query("ano_report", lambda s: anomalies.report(anomalies.detect(s)), f", t AS (SELECT {_STATS} FROM sales) SELECT count(*) AS total_records, count(*) FILTER ({_ANY}) AS total_anomalies, {', '.join(_anomaly_sql(m, c) for m, c in anomalies.MEASURES.items())} FROM sales, t")
_query("ano5_top_anomaly_records", lambda s: anomalies.top_records(anomalies.detect(s), 5, ("order_id", "line", "part", "supplier", "quantity", "revenue")).select("order_id", "line", "part", "revenue", "composite_anomaly_score", "anomaly_types", "anomaly_rank"),
       f""", t AS (SELECT {_STATS} FROM sales), x AS (SELECT *, {_r(' + '.join(f'abs({c} - {m}_m) / {m}_s' for m, c in anomalies.MEASURES.items()), 6)} AS composite_anomaly_score,
       concat_ws(', ', {', '.join(f"CASE WHEN abs({c} - {m}_m) / {m}_s > 3 OR {c} > {m}_b + 1.5 * ({m}_b - {m}_a)" + ('' if m == 'quantity' else f' OR {c} < {m}_a - 1.5 * ({m}_b - {m}_a)') + f" THEN '{m.capitalize()}' END" for m, c in anomalies.MEASURES.items())}) AS anomaly_types FROM sales, t WHERE {_ANY})
       SELECT order_id, line, part, revenue, composite_anomaly_score, anomaly_types, row_number() OVER (ORDER BY composite_anomaly_score DESC, order_id, line, part, supplier, quantity, revenue)::INT AS anomaly_rank FROM x ORDER BY anomaly_rank LIMIT 5""")
_query("sta2_thresholds", lambda s: anomalies.thresholds(s, "revenue").select("method", half_even(F.col("lower"), 4).alias("lower"), half_even(F.col("upper"), 4).alias("upper")),
       f""", s AS (SELECT avg(revenue) AS m, stddev_samp(revenue) AS d, quantile_cont(revenue, [0.25, 0.5, 0.75, 0.025, 0.975]) AS q FROM sales), w AS (SELECT quantile_cont(abs(revenue - q[2]), 0.5) * 3.5 * 1.4826 AS w FROM sales, s)
       SELECT 'zscore' AS method, {_r('m - 3 * d', 4)} AS lower, {_r('m + 3 * d', 4)} AS upper FROM s UNION ALL SELECT 'iqr', {_r('q[1] - 1.5 * (q[3] - q[1])', 4)}, {_r('q[3] + 1.5 * (q[3] - q[1])', 4)} FROM s
       UNION ALL SELECT 'percentile', {_r('q[4]', 4)}, {_r('q[5]', 4)} FROM s UNION ALL SELECT 'modified_zscore', {_r('q[2] - w', 4)}, {_r('q[2] + w', 4)} FROM s, w""")
_query("sta4_fraud_patterns", lambda s: anomalies.fraud(s, anomalies.PRESETS["high"]).groupBy("fraud_reasons").agg(F.count(F.lit(1)).alias("n"), F.count_if("fraud_flag").alias("flagged"), half_even(dsum("fraud_score"), 1).alias("score")))
_query("val17_rules", lambda s: validation.validate(s))
_query("val19_by_field", lambda s: validation.by_field(validation.validate(s)))
_query("val2_duplicate_orders", lambda s: validation.duplicate_order_ids(s).groupBy("is_duplicate").agg(F.count(F.lit(1)).alias("n")), "SELECT n > 1 AS is_duplicate, sum(n)::BIGINT AS n FROM (SELECT order_id, count(*) AS n FROM sales GROUP BY 1) GROUP BY 1")

# Dirty spellings by part key, for the cleaning queries.
DIRTY_QUANTITY = "CASE p_partkey % 9 WHEN 0 THEN '20 units' WHEN 1 THEN '-2' WHEN 2 THEN 'abc' WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN '10.5' WHEN 6 THEN '15000' WHEN 7 THEN '0.9' ELSE '7' END"
DIRTY_DISCOUNT = "CASE p_partkey % 8 WHEN 0 THEN '25%' WHEN 1 THEN '-0.1' WHEN 2 THEN 'abc' WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN '150' WHEN 6 THEN '15' ELSE '0.5' END"
DIRTY_REGION = "CASE p_partkey % 6 WHEN 0 THEN ' NORT ' WHEN 1 THEN 'south  east' WHEN 2 THEN NULL WHEN 3 THEN '' WHEN 4 THEN 'unknown_region' ELSE 'w' END"
DIRTY_DATE = "CASE p_partkey % 5 WHEN 0 THEN '2023-1-5' WHEN 1 THEN '15/01/2023' WHEN 2 THEN '2023-02-29' WHEN 3 THEN NULL ELSE '2023-01-15 10:30:00' END"


def _dirty(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").selectExpr("p_partkey", f"{DIRTY_QUANTITY} AS quantity", f"{DIRTY_DISCOUNT} AS discount_percent", f"{DIRTY_REGION} AS region", f"{DIRTY_DATE} AS sale_date")


QUERIES["cln_clean"] = lambda spark, d: cleaning.clean(_dirty(spark, d)).withColumn("sale_date", F.date_format("sale_date", "yyyy-MM-dd HH:mm:ss"))
ORACLES["cln_clean"] = """SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 20 WHEN 5 THEN 10 WHEN 6 THEN 10000 WHEN 8 THEN 7 ELSE 1 END::INT AS quantity, CASE p_partkey % 8 WHEN 0 THEN 0.25 WHEN 5 THEN 1.0 WHEN 6 THEN 0.15 WHEN 7 THEN 0.5 ELSE 0.0 END::DOUBLE AS discount_percent,
    CASE p_partkey % 6 WHEN 0 THEN 'North' WHEN 1 THEN 'Southeast' WHEN 4 THEN 'Unknown_region' WHEN 5 THEN 'West' ELSE 'Unknown' END AS region, CASE p_partkey % 5 WHEN 0 THEN '2023-01-05 00:00:00' WHEN 1 THEN '2023-01-15 00:00:00' WHEN 4 THEN '2023-01-15 10:30:00' END AS sale_date FROM part"""
QUERIES["cln9_issues"] = lambda spark, d: cleaning.issues(_dirty(spark, d))
ORACLES["cln9_issues"] = """SELECT 'quantity' AS field, CASE p_partkey % 9 WHEN 2 THEN 'conversion_error' WHEN 6 THEN 'capped_high' ELSE 'non_positive' END AS issue, count(*) AS n FROM part WHERE p_partkey % 9 IN (1, 2, 6, 7) GROUP BY ALL
    UNION ALL SELECT 'discount_percent', CASE p_partkey % 8 WHEN 2 THEN 'conversion_error' WHEN 1 THEN 'negative_value' WHEN 5 THEN 'over_100_percent' ELSE 'converted_from_percentage' END, count(*) FROM part WHERE p_partkey % 8 IN (0, 1, 2, 5, 6) GROUP BY ALL"""
QUERIES["ops4_performance_by_category"] = lambda spark, d: _t(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), half_even(F.avg("value"), 4).alias("avg_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))
ORACLES["ops4_performance_by_category"] = f"SELECT event_type, count(*) AS n, {_r('avg(value)', 4)} AS avg_value, min(value) AS min_value, max(value) AS max_value FROM events GROUP BY 1"
