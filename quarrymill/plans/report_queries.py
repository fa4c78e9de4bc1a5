"""Queries over dashboards, field rules, operational summaries and cleaning reports, and further SQL for sales queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import cleaning
from ..functions.numeric import half_even
from ..operators import anomalies, dashboards, field_rules, operations, tables, validation
from .queries import _STATS, DIRTY_DISCOUNT, DIRTY_QUANTITY, MONTHLY, PRODUCTS, SALES, _a, _r, _s, _t, sales

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, make, sql: str) -> None:
    QUERIES[name] = lambda spark, d: make(sales(spark, d))
    ORACLES[name] = f"WITH {SALES} {sql}"


def _more_sql(name: str, sql: str) -> None:
    """SQL for a query that is registered elsewhere."""
    ORACLES[name] = f"WITH {SALES} {sql}"


def _rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: half_even(F.col(c), digits) for c in columns})


# Dashboards
REGIONS = f"""g AS (SELECT region, {_s('revenue')} AS t, count(DISTINCT order_id) AS o, sum(quantity)::BIGINT AS q FROM sales GROUP BY 1),
    c AS (SELECT region, category AS top_category, row_number() OVER (PARTITION BY region ORDER BY {_s('revenue')} DESC, category) AS n FROM sales GROUP BY region, category),
    regions AS (SELECT region, {_r('t', 4)} AS total_revenue, o AS unique_orders, q AS total_quantity, top_category, {_r('t / o', 4)} AS avg_order_value, {_r('t / sum(t::DECIMAL(20,6)) OVER ()::DOUBLE * 100', 4)} AS market_share_pct FROM g JOIN c USING (region) WHERE n = 1)"""
_query("alt3_dashboard_regions", lambda s: _rounded(dashboards.dashboard_regions(s), "total_revenue", "avg_order_value", "market_share_pct"), f", {REGIONS} SELECT * FROM regions")

ANOMALIES = f"""z AS (SELECT avg(revenue) AS rm, stddev_samp(revenue) AS rs, avg(quantity) AS qm, stddev_samp(quantity) AS qs FROM sales),
    x AS (SELECT *, abs(revenue - rm) / rs AS a, abs(quantity - qm) / qs AS b FROM sales, z),
    anomalies AS (SELECT order_id, product_name, revenue, quantity, unit_price, {_r('greatest(a, b)', 6)} AS anomaly_score, CASE WHEN a > b THEN 'High Revenue' ELSE 'High Quantity' END AS anomaly_type, '{dashboards.DEFAULT_REASON}' AS reason
    FROM x WHERE greatest(a, b) > 3 ORDER BY anomaly_score DESC, order_id, product_name, revenue, quantity, unit_price, anomaly_type LIMIT 100)"""
_query("alt5_anomaly_records", dashboards.anomaly_records, f", {ANOMALIES} SELECT * FROM anomalies")
_query("dsh3_kpis", lambda s: dashboards.kpis(dashboards.dashboard_regions(s), tables.dashboard_products(s), dashboards.anomaly_records(s)),
       f""", {REGIONS}, {ANOMALIES}, p AS (SELECT product_name, {_r(_s('revenue'))} AS t FROM sales GROUP BY 1 ORDER BY t DESC, product_name LIMIT 20)
       SELECT (SELECT count(*) FROM regions) AS total_regions, (SELECT region FROM regions ORDER BY total_revenue DESC, region LIMIT 1) AS top_region, (SELECT count(*) FROM p) AS total_products, (SELECT product_name FROM p ORDER BY t DESC, product_name LIMIT 1) AS top_product,
       (SELECT count(*) FROM anomalies) AS total_anomalies, (SELECT {_r('avg(anomaly_score)', 4)} FROM anomalies) AS avg_anomaly_score""")
_query("dsh8_anomaly_kpis", lambda s: dashboards.anomaly_kpis(dashboards.anomaly_records(s)),
       f""", {ANOMALIES} SELECT count(*) AS anomalies, {_r(_s('anomaly_score') + ' / count(*)', 4)} AS avg_score, {_r(_s('revenue'))} AS revenue_impact, (SELECT anomaly_type FROM anomalies GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS most_common_type FROM anomalies""")
_query("dsh7_recent_months", lambda s: dashboards.recent_months(tables.monthly_sales_summary(s)), f", m AS ({MONTHLY}) SELECT * FROM m ORDER BY month DESC LIMIT 6")
_HEAT = ("avg_discount", "total_revenue")
_query("dsh4_heat_map", lambda s: _rounded(tables.normalised(_rounded(tables.dashboard_discounts(s), *_HEAT), *_HEAT), *(f"{c}_norm" for c in _HEAT), digits=6).select("category", *(f"{c}_norm" for c in _HEAT)),
       f""", g AS (SELECT category, {_r(_a('discount_percent'), 4)} AS avg_discount, {_r(_s('revenue'), 4)} AS total_revenue FROM sales GROUP BY 1)
       SELECT category, {', '.join(f"CASE WHEN max({c}) OVER () > min({c}) OVER () THEN " + _r(f'({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())', 6) + f" ELSE 0.5 END AS {c}_norm" for c in _HEAT)} FROM g""")
_query("dsh2_filtered_metrics", lambda s: tables.dashboard_metrics(tables.monthly_sales_summary(tables.filtered(s, region=["ASIA", "EUROPE"]))).select("total_revenue", "total_orders", "avg_order_value", "revenue_growth"),
       f""", f AS (SELECT * FROM sales WHERE region IN ('ASIA', 'EUROPE')), m AS ({MONTHLY.replace('FROM sales', 'FROM f')}), l AS (SELECT *, lag(total_revenue) OVER (ORDER BY month) AS w FROM m)
       SELECT {_r(_s('total_revenue'))} AS total_revenue, sum(unique_orders)::BIGINT AS total_orders, {_r(_a('avg_order_value'))} AS avg_order_value, coalesce((SELECT format('{{:+.1f}}%', (total_revenue - w) / w * 100) FROM l WHERE w > 0 ORDER BY month DESC LIMIT 1), 'N/A') AS revenue_growth FROM m""")
_GROWTH = ", ".join(f"coalesce(format('{{:+.1f}}%', max_by(({c} - w_{c})::DOUBLE / w_{c} * 100, month)), 'N/A') AS {to}" for c, to in (("total_revenue", "revenue_growth"), ("unique_orders", "orders_growth"), ("avg_order_value", "aov_growth")))
_more_sql("dsh1_dashboard_metrics", f""", m AS ({MONTHLY}), l AS (SELECT *, {', '.join(f'lag({c}) OVER (ORDER BY month) AS w_{c}' for c in ('total_revenue', 'unique_orders', 'avg_order_value'))} FROM m)
    SELECT {_r(_s('total_revenue'))} AS total_revenue, sum(unique_orders)::BIGINT AS total_orders, {_r(_a('avg_order_value'))} AS avg_order_value, {_r(_a('avg_discount'), 4)} AS avg_discount, {_GROWTH} FROM l""")

# Metric bundles
_D, _N = "discount_percent > 0", "discount_percent = 0"


def _mean_if(c: str, rows: str) -> str:
    return f"coalesce({_r(_a(f'(CASE WHEN {rows} THEN {c} END)'))}, 0)"


_TIERS = ", ".join(
    f"{_mean_if('revenue', t)} AS {n}_discount_avg_revenue, {_mean_if('quantity', t)} AS {n}_discount_avg_quantity, count(*) FILTER ({t}) AS {n}_discount_transaction_count"
    for n, t in (("low", "discount_percent > 0 AND discount_percent <= 0.1"), ("medium", "discount_percent > 0.1 AND discount_percent <= 0.3"), ("high", "discount_percent > 0.3"))
)
_more_sql("met2_discount_effectiveness", f""", g AS (SELECT {_r(_s('quantity * unit_price * discount_percent'))} AS total_discount_amount, {_r(_a('discount_percent'), 4)} AS avg_discount_rate, {_r(f'count(*) FILTER ({_D}) / count(*)', 4)} AS discount_penetration_rate,
    count(*) FILTER ({_D}) AS discounted_transactions, count(*) FILTER ({_N}) AS non_discounted_transactions, {_mean_if('revenue', _D)} AS avg_discounted_transaction_value, {_mean_if('quantity', _D)} AS avg_discounted_quantity,
    {_mean_if('revenue', _N)} AS avg_non_discounted_transaction_value, {_mean_if('quantity', _N)} AS avg_non_discounted_quantity, {_TIERS} FROM sales),
    h AS (SELECT *, coalesce({_r('avg_discounted_transaction_value / nullif(avg_non_discounted_transaction_value, 0)', 4)}, 0) AS revenue_impact_ratio, coalesce({_r('avg_discounted_quantity / nullif(avg_non_discounted_quantity, 0)', 4)}, 0) AS quantity_impact_ratio FROM g)
    SELECT *, CASE WHEN revenue_impact_ratio > 0 THEN {_r('(revenue_impact_ratio - 1) * 100')} ELSE 0.0::DOUBLE END AS discount_roi FROM h""")
_more_sql("met3_regional_performance", f""", g AS (SELECT region, {_r(_s('revenue'))} AS total_revenue, sum(quantity)::BIGINT AS total_quantity, count(*) AS total_orders, count(DISTINCT customer_email) AS unique_customers, {_r(_a('revenue'))} AS avg_order_value,
    {_r(_a('quantity'))} AS avg_items_per_order, {_r(_a('unit_price'))} AS avg_unit_price, {_r(_a('discount_percent'), 4)} AS avg_discount_rate FROM sales GROUP BY 1),
    c AS (SELECT region, category, {_s('revenue')} AS r FROM sales GROUP BY 1, 2), t AS (SELECT region, first(category ORDER BY r DESC, category) AS top_category, {_r('max(r)')} AS top_category_revenue, count(*) AS category_diversity_count FROM c GROUP BY 1),
    m AS (SELECT region, strftime(sale_date, '%Y-%m') AS month, {_s('revenue')} AS r FROM sales GROUP BY 1, 2), w AS (SELECT *, r / lag(r) OVER (PARTITION BY region ORDER BY month) AS q, (r - lag(r) OVER (PARTITION BY region ORDER BY month)) / lag(r) OVER (PARTITION BY region ORDER BY month) AS g FROM m),
    u AS (SELECT region, {_r(_a('r'))} AS avg_monthly_revenue, {_r('stddev_samp(r)')} AS monthly_revenue_volatility, {_r('avg(g)', 4)} AS avg_monthly_growth_rate FROM w GROUP BY 1)
    SELECT *, {_r('avg_order_value * (1 - avg_discount_rate)')} AS efficiency_score, {_r('total_revenue / unique_customers')} AS avg_customer_lifetime_value, {_r('total_orders / unique_customers')} AS avg_orders_per_customer, {_r('top_category_revenue / total_revenue', 4)} AS top_category_share,
    {_r('total_revenue / sum(total_revenue::DECIMAL(20,6)) OVER ()::DOUBLE', 4)} AS market_share, {_r('avg_order_value / sum(avg_order_value::DECIMAL(20,6)) OVER ()::DOUBLE * count(*) OVER ()', 4)} AS performance_index FROM g JOIN t USING (region) JOIN u USING (region)""")

# Fraud patterns, with the bounds of the high preset
_TRIPLE = " OR ".join(f"contains(lower(customer_email), '{c * 3}')" for c in "abcdefghijklmnopqrstuvwxyz")
_FRAUD = (
    ("High quantity + High discount", 2.0, "quantity > 100 AND discount_percent > 0.5"), ("High price + Extreme discount", 3.0, "unit_price > 10000 AND discount_percent > 0.7"), ("Low price + High quantity", 1.5, "unit_price < 1 AND quantity > 50"),
    ("Weekend high-value sale", 1.0, "isodow(sale_date) >= 6 AND revenue > 50000"),
    ("Suspicious email pattern", 0.5, f"({_TRIPLE} OR length(customer_email) - length(replace(customer_email, '.', '')) > 3 OR length(split_part(customer_email, '@', 1)) < 3)"),
    ("Round number combination", 0.8, "quantity % 10 = 0 AND unit_price % 100 = 0 AND quantity > 10 AND unit_price > 100"), ("Extreme unit price", 1.2, "unit_price > 100000"),
    ("Suspicious product name pattern", 0.3, "len(list_distinct(string_split(lower(replace(product_name, ' ', '')), ''))) < 5 AND length(replace(product_name, ' ', '')) > 10"),
)
_more_sql("sta4_fraud_patterns", f""", x AS (SELECT concat_ws('; ', {', '.join(f"CASE WHEN {t} THEN '{n}' END" for n, _, t in _FRAUD)}) AS fraud_reasons, {_r(' + '.join(f'CASE WHEN {t} THEN {w}::DOUBLE ELSE 0 END' for _, w, t in _FRAUD), 1)} AS score FROM sales)
    SELECT fraud_reasons, count(*) AS n, count(*) FILTER (score >= 1) AS flagged, {_r(_s('score'), 1)} AS score FROM x GROUP BY 1""")
_query("sta5_reason_frequency", lambda s: anomalies.reason_counts(anomalies.fraud(s), "fraud_reasons"),
       f""", x AS (SELECT concat_ws('; ', {', '.join(f"CASE WHEN {t} THEN '{n}' END" for n, _, t in _FRAUD)}) AS r FROM sales) SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(r, '; ')) AS reason FROM x WHERE r <> '') GROUP BY 1""")
_query("flt9_without_outliers", lambda s: anomalies.without_outliers(s, "revenue").agg(F.count(F.lit(1)).alias("n"), half_even(F.sum(F.col("revenue").cast("decimal(20,6)")).cast("double")).alias("revenue")),
       f", t AS (SELECT {_STATS} FROM sales) SELECT count(*) AS n, {_r(_s('revenue'))} AS revenue FROM sales, t WHERE abs(revenue - revenue_m) / revenue_s < 3")

# Validation
_ENUM = lambda values: ", ".join(f"'{v}'" for v in values)
_RULES = {
    "order_id_not_null": "count(order_id)", "order_id_unique": "count(DISTINCT order_id)", "product_name_not_null": "count(product_name)", "product_name_length": "count(*) FILTER (length(product_name) BETWEEN 1 AND 200)",
    "category_enum": f"count(*) FILTER (category IN ({_ENUM(validation.CATEGORY_VALUES)}))", "quantity_positive": "count(*) FILTER (quantity BETWEEN 1 AND 10000)", "quantity_statistical": "count(*) FILTER (abs(quantity - m) / s <= 3)",
    "unit_price_positive": "count(*) FILTER (unit_price BETWEEN 0.01 AND 100000)", "discount_range": "count(*) FILTER (discount_percent BETWEEN 0 AND 1)", "region_enum": f"count(*) FILTER (region IN ({_ENUM(validation.REGION_VALUES)}))",
    "email_format": f"count(*) FILTER (regexp_matches(customer_email, '{validation.EMAIL}'))", "sale_date_range": "count(*) FILTER (sale_date::DATE BETWEEN DATE '2020-01-01' AND DATE '2030-12-31')", "revenue_calculation": "count(*) FILTER (revenue > 0)",
}
_RESULTS = f"""t AS (SELECT avg(quantity) AS m, stddev_samp(quantity) AS s FROM sales), v AS (SELECT count(*) AS n, {', '.join(f'{c} AS {n}' for n, c in _RULES.items())} FROM sales, t),
    u AS ({' UNION ALL '.join(f"SELECT '{r.name}' AS rule_name, '{r.field}' AS field, '{r.severity}' AS severity, {validation.THRESHOLDS[r.severity]} AS bound, n AS total_records, {r.name} AS valid_records FROM v" for r in validation.DEFAULT_RULES)}),
    results AS (SELECT * EXCLUDE (bound), round_even((total_records - valid_records)::DOUBLE / total_records::DOUBLE * 1e6, 0) / 1e4::DOUBLE AS error_rate, round_even((total_records - valid_records)::DOUBLE / total_records::DOUBLE * 1e6, 0) / 1e4 <= bound AS passed FROM u)"""
_more_sql("val17_rules", f", {_RESULTS} SELECT * FROM results")
_more_sql("val19_by_field", f", {_RESULTS} SELECT field, count(*) AS rules, max(error_rate) AS worst_error_rate, {_r('avg(error_rate)', 4)} AS avg_error_rate FROM results GROUP BY 1")
_query("val20_status", lambda s: validation.status(validation.validate(s)),
       f""", {_RESULTS} SELECT CASE WHEN bool_or(NOT passed AND severity = 'critical') THEN 'critical' WHEN bool_or(NOT passed AND severity = 'error') THEN 'error' WHEN bool_or(NOT passed) THEN 'warning' ELSE 'passed' END AS status,
       count(*) FILTER (NOT passed) AS failed_rules, round_even(sum(valid_records)::DOUBLE / sum(total_records)::DOUBLE * 1e4, 0) / 100 AS quality_score FROM results""")
_query("dsh9_severity_counts", lambda s: dashboards.severity_counts(validation.validate(s)), f", {_RESULTS} SELECT severity, count(*) AS rules, count(*) FILTER (NOT passed) AS failed FROM results GROUP BY 1")
_query("dsh10_problem_field", lambda s: dashboards.problem_fields(validation.validate(s)), f", {_RESULTS} SELECT field, {_r('avg(error_rate)', 4)} AS avg_error_rate FROM results GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")


def _field_sql(field: str, rule: field_rules.FieldRule) -> str:
    x = f"length({field})" if rule.kind == "text" else field
    tests = [f"{field} IS NOT NULL"] + ([f"{x} >= {rule.low}"] if rule.low is not None else []) + ([f"{x} <= {rule.high}"] if rule.high is not None else []) + ([f"regexp_matches({field}, '{rule.pattern}')"] if rule.pattern else [])
    return "(" + " AND ".join(tests) + ")"


_FIELDS = field_rules.FIELD_RULES.items()
_query("val4_field_quality", field_rules.field_quality, " UNION ALL ".join(
    (", x AS (SELECT * FROM sales) " if i == 0 else "") + f"SELECT '{f}' AS field, count(*) AS total_values, count(*) FILTER ({_field_sql(f, r)}{'' if r.required else f' OR {f} IS NULL'}) AS valid_values, count(*) FILTER ({f} IS NULL) AS null_values, count(*) FILTER ({f} IS NOT NULL AND NOT {_field_sql(f, r)}) AS invalid_values FROM x"
    for i, (f, r) in enumerate(_FIELDS)))
_query("val6_row_quality", field_rules.row_quality, f"""SELECT count(*) AS total_records, count(*) FILTER ({' AND '.join(_field_sql(f, r) for f, r in _FIELDS)}) AS valid_records,
    {_r('(' + ' + '.join(f'count(*) FILTER ({_field_sql(f, r)}' + ('' if r.required else f' OR {f} IS NULL') + ')' for f, r in _FIELDS) + f') / (count(*) * {len(_FIELDS)})', 6)} AS quality_score FROM sales""")

# Cleaning reports
QUERIES["cln10_report"] = lambda spark, d: cleaning.report(_t(spark, d, "part").selectExpr("p_partkey", f"{DIRTY_QUANTITY} AS quantity", f"{DIRTY_DISCOUNT} AS discount_percent"))
ORACLES["cln10_report"] = f"""WITH n AS (SELECT count(*) AS n FROM part), q AS (SELECT 'quantity' AS field, count(*) FILTER (p_partkey % 9 IN (1, 2, 7)) AS errors, count(*) FILTER (p_partkey % 9 = 6) AS corrections FROM part
    UNION ALL SELECT 'discount_percent', count(*) FILTER (p_partkey % 8 IN (1, 2, 5)), count(*) FILTER (p_partkey % 8 IN (0, 6)) FROM part)
    SELECT field, n AS total, errors, corrections, {_r('errors / n * 100', 4)} AS error_rate, {_r('corrections / n * 100', 4)} AS correction_rate FROM q, n"""
QUERIES["cln11_standardization"] = lambda spark, d: cleaning.standardization_stats(_t(spark, d, "customer").select(F.col("c_mktsegment").alias("category")), "category")
ORACLES["cln11_standardization"] = "SELECT count(DISTINCT lower(c_mktsegment)) AS unique_before, count(DISTINCT CASE WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'Home Goods' ELSE c_mktsegment END) AS unique_after, count(*) FILTER (c_mktsegment IS NULL) AS nulls FROM customer"
QUERIES["cln14_defaults"] = lambda spark, d: cleaning.with_defaults(_t(spark, d, "part").selectExpr("p_partkey", "IF(p_partkey % 3 = 0, NULL, p_size) AS quantity", "IF(p_partkey % 4 = 0, NULL, p_type) AS category"))
ORACLES["cln14_defaults"] = "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END AS quantity, CASE WHEN p_partkey % 4 = 0 THEN 'Unknown' ELSE p_type END AS category FROM part"


# Operational summaries: events as operations
def _ops(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").selectExpr("event_type AS operation", "IF(event_type = 'error', 'failed', 'completed') AS status", "user_id AS records", "value AS duration", "ts", "user_id % 7 = 0 AS resolved", "event_id")


QUERIES["ops2_processing_summary"] = lambda spark, d: operations.processing_summary(_ops(spark, d))
ORACLES["ops2_processing_summary"] = f"""WITH g AS (SELECT count(*) AS total_operations, count(*) FILTER (event_type <> 'error') AS completed_operations, count(*) FILTER (event_type = 'error') AS failed_operations, sum(CASE WHEN event_type <> 'error' THEN user_id END)::BIGINT AS total_records_processed,
    {_s("(CASE WHEN event_type <> 'error' THEN value END)")} AS total_processing_time FROM events) SELECT *, {_r('total_records_processed / total_processing_time', 4)} AS average_throughput, {_r('completed_operations * 100.0 / total_operations', 4)} AS success_rate FROM g"""
QUERIES["ops3_quality_summary"] = lambda spark, d: operations.quality_summary(_t(spark, d, "events").selectExpr("user_id + 10 AS total_records", "user_id AS valid_records"))
ORACLES["ops3_quality_summary"] = f"SELECT count(*) AS total_metrics, sum(user_id + 10)::BIGINT AS total_records_analyzed, sum(user_id)::BIGINT AS total_valid_records, {_r('(sum(user_id + 10) - sum(user_id))::DOUBLE / sum(user_id + 10)::DOUBLE * 100', 4)} AS overall_error_rate FROM events"
QUERIES["ops5_error_summary"] = lambda spark, d: operations.error_summary(_ops(spark, d), "operation", "status").withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss"))
ORACLES["ops5_error_summary"] = "SELECT event_type AS operation, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status, count(*) AS errors, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events GROUP BY 1, 2"
QUERIES["ops7_health_rollup"] = lambda spark, d: operations.health_rollup(_t(spark, d, "events").select("event_type", operations.health_level(F.col("user_id") % 100, 80.0, 90.0).alias("status")), "event_type")
ORACLES["ops7_health_rollup"] = "SELECT event_type, count(*) AS checks, count(*) FILTER (user_id % 100 >= 80) AS not_healthy, CASE WHEN max(user_id % 100) >= 90 THEN 'critical' WHEN max(user_id % 100) >= 80 THEN 'warning' ELSE 'healthy' END AS status FROM events GROUP BY 1"
QUERIES["ops8_alerts"] = lambda spark, d: operations.fired_alerts(_t(spark, d, "events").selectExpr("event_id", "user_id % 101 AS memory_percent", "user_id * 10 AS average_throughput", "IF(event_type = 'error', 'failed', 'healthy') AS overall_status"), "event_id")
ORACLES["ops8_alerts"] = """SELECT event_id, 'high_memory_usage' AS rule, 'warning' AS severity FROM events WHERE user_id % 101 > 85 UNION ALL SELECT event_id, 'critical_memory_usage', 'critical' FROM events WHERE user_id % 101 > 95
    UNION ALL SELECT event_id, 'low_throughput', 'warning' FROM events WHERE user_id * 10 < 1000 UNION ALL SELECT event_id, 'pipeline_failure', 'critical' FROM events WHERE event_type = 'error'"""
QUERIES["ops9_alert_summary"] = lambda spark, d: operations.alert_summary(_ops(spark, d), "operation")
ORACLES["ops9_alert_summary"] = f"SELECT event_type AS operation, count(*) AS alerts, count(*) FILTER (user_id % 7 = 0) AS resolved, {_r('count(*) FILTER (user_id % 7 = 0) * 100.0 / count(*)', 4)} AS resolution_rate FROM events GROUP BY 1"
QUERIES["ops13_recovery_summary"] = lambda spark, d: operations.recovery_summary(_ops(spark, d).select(F.col("operation").alias("action"), F.col("resolved").alias("success")))
ORACLES["ops13_recovery_summary"] = f"SELECT event_type AS action, count(*) AS attempts, count(*) FILTER (user_id % 7 = 0) AS successes, {_r('count(*) FILTER (user_id % 7 = 0) * 100.0 / count(*)', 4)} AS success_rate FROM events GROUP BY 1"
QUERIES["ops17_quality_buckets"] = lambda spark, d: _t(spark, d, "events").groupBy(operations.quality_bucket(F.col("user_id") % 20).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
ORACLES["ops17_quality_buckets"] = "SELECT CASE WHEN user_id % 20 <= 1 THEN 'excellent' WHEN user_id % 20 <= 5 THEN 'good' WHEN user_id % 20 <= 10 THEN 'fair' ELSE 'poor' END AS bucket, count(*) AS n FROM events GROUP BY 1"
QUERIES["flt8_recent_events"] = lambda spark, d: operations.recent(_t(spark, d, "events"), "ts", "2024-01-15 00:00:00", 24.0).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
ORACLES["flt8_recent_events"] = "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 24 HOUR GROUP BY 1"
_query("ops24_profile", lambda s: operations.profile(s).withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_sale", "last_sale")}),
       f"""SELECT count(*) AS total_records, strftime(min(sale_date), '%Y-%m-%d') AS first_sale, strftime(max(sale_date), '%Y-%m-%d') AS last_sale, {_r(_s('revenue'))} AS revenue_total, {_r('avg(revenue)', 4)} AS revenue_mean, {_r('stddev_samp(revenue)', 4)} AS revenue_std,
       (count(*) - count(DISTINCT order_id))::BIGINT AS duplicate_order_ids FROM sales""")
_query("ops24_value_counts", lambda s: operations.value_counts(s, "category", "region"), "SELECT 'category' AS field, category AS value, count(*) AS n FROM sales GROUP BY 2 UNION ALL SELECT 'region', region, count(*) FROM sales GROUP BY 2")
_query("ops24_null_counts", lambda s: operations.null_counts(s.select("order_id", "customer_email")), "SELECT 'order_id' AS field, count(*) FILTER (order_id IS NULL) AS nulls FROM sales UNION ALL SELECT 'customer_email', count(*) FILTER (customer_email IS NULL) FROM sales")


# Variants of the tables, reasons of anomalies, and the cleaning of the other fields
_query("alt2_all_products_ranked", tables.all_products_ranked, f""", p AS ({PRODUCTS}), r AS (SELECT *, row_number() OVER (ORDER BY total_revenue DESC, product_name)::INT AS revenue_rank, row_number() OVER (ORDER BY total_units DESC, product_name)::INT AS units_rank FROM p)
    SELECT * FROM r WHERE revenue_rank <= 50""")
_query("alt3_regions_with_discount", lambda s: _rounded(dashboards.dashboard_regions(s, with_discount=True), "total_revenue", "avg_order_value", "market_share_pct", "avg_discount"),
       f", {REGIONS} SELECT regions.*, avg_discount FROM regions JOIN (SELECT region, {_r(_a('discount_percent'), 4)} AS avg_discount FROM sales GROUP BY 1) USING (region)")


def _reason_sql(m: str, c: str) -> str:
    lo, hi = f"{m}_a - 1.5 * ({m}_b - {m}_a)", f"{m}_b + 1.5 * ({m}_b - {m}_a)"
    far, above, below = f"abs({c} - {m}_m) / {m}_s > 3", f"{c} > {hi}", f"{c} < {lo}"
    iqr = above if m == "quantity" else f"({above} OR {below})"
    one = f"WHEN {above} THEN 'Unusually High Discount' WHEN {below} THEN 'Unusually Low Discount'" if m == "discount" else f"WHEN {iqr} THEN 'IQR Outlier'"
    reason = f"CASE WHEN {far} AND {iqr} THEN 'Z-score + IQR Outlier' {one} WHEN {far} THEN 'High Z-score' ELSE 'Normal' END"
    return f"SELECT '{m}_anomaly_reason' AS field, {reason} AS value, count(*) AS n FROM sales, t GROUP BY 2"


_query("ano_reasons", lambda s: operations.value_counts(anomalies.detect(s), *(f"{m}_anomaly_reason" for m in anomalies.MEASURES)),
       f", t AS (SELECT {_STATS} FROM sales) {' UNION ALL '.join(_reason_sql(m, c) for m, c in anomalies.MEASURES.items())}")

# Raw spellings by part key with what cleaning makes of them.
RAW_PRODUCTS = [("apple iphone 13", "Apple Iphone 13"), ("  extra   spaces  ", "Extra Spaces"), ("product@#$%with&*special()chars", "Productwith&special()chars"), ("", "Unknown Product"), (None, "Unknown Product"), ("product with and in the name", "Product w/ & in the Name"), ("a", "A")]
RAW_CATEGORIES = [("electronics", "Electronics"), ("FASHION", "Fashion"), ("home goods", "Home Goods"), ("elec", "Electronics"), ("unknown_category", "Unknown Category"), ("", "Other"), (None, "Other")]
RAW_PRICES = [("10.99", 10.99), ("0", 0.01), ("-5.50", 0.01), ("abc", 0.01), ("", 0.01), (None, 0.01), ("$15.99", 15.99), ("2000000", 1e6)]
RAW_EMAILS = [("user@example.com", "user@example.com"), ("INVALID.EMAIL", None), ("test@domain.co.uk", "test@domain.co.uk"), ("", None), (None, None), ("user@", None), ("@domain.com", None)]


def _pick(values: list, step: int) -> str:
    """SQL: one of the values by part key, in turns of step rows."""
    said = lambda v: "NULL" if v is None else repr(v) if isinstance(v, float) else "'" + v + "'"
    return f"CASE (p_partkey // {step}) % {len(values)} " + " ".join(f"WHEN {i} THEN {said(v)}" for i, v in enumerate(values)) + " END"


_FIELDS = {"product_name": (RAW_PRODUCTS, 1), "category": (RAW_CATEGORIES, 2), "unit_price": (RAW_PRICES, 3), "customer_email": (RAW_EMAILS, 5)}


def _clean_fields(spark: SparkSession, d: str) -> DataFrame:
    raw = _t(spark, d, "part").selectExpr("p_partkey", *(f"{_pick([a for a, _ in v], n).replace('//', 'div')} AS {c}" for c, (v, n) in _FIELDS.items()), f"{DIRTY_QUANTITY} AS quantity", f"{DIRTY_DISCOUNT} AS discount_percent")
    return cleaning.with_revenue(cleaning.clean(raw)).withColumn("revenue", half_even(F.col("revenue"), 4)).drop("quantity", "discount_percent")


QUERIES["cln_fields"] = _clean_fields
ORACLES["cln_fields"] = f"""WITH c AS (SELECT p_partkey, {', '.join(f"{_pick([b for _, b in v], n)}{'::DOUBLE' * (c == 'unit_price')} AS {c}" for c, (v, n) in _FIELDS.items())},
    CASE p_partkey % 9 WHEN 0 THEN 20 WHEN 5 THEN 10 WHEN 6 THEN 10000 WHEN 8 THEN 7 ELSE 1 END AS q, CASE p_partkey % 8 WHEN 0 THEN 0.25 WHEN 5 THEN 1.0 WHEN 6 THEN 0.15 WHEN 7 THEN 0.5 ELSE 0.0 END::DOUBLE AS cut FROM part)
    SELECT * EXCLUDE (q, cut), {_r('q * unit_price * (1 - cut)', 4)} AS revenue FROM c"""
