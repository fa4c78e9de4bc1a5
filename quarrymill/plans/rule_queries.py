"""Queries over text dates, rules that fail at run time, the error report, the Isolation Forest, sketches and cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import cleaning
from ..functions.numeric import half_even
from ..operators import forest, reports, sketches, text_dates, validation
from .audit_queries import _ERRORS, _FAILED
from .queries import DIRTY_DATE, DIRTY_REGION, SALES, _dirty, _t, sales
from .report_queries import _RESULTS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# How an order's date is written, by the last digit of its key. Most of "above" is read by the general way,
# little of "below".
LAYOUTS = {
    "above": ["yyyy-MM-dd"] * 6 + ["dd.MM.yyyy", "'Unknown'", None, "MM/dd/yyyy"],
    "below": ["dd/MM/yyyy"] * 5 + ["dd.MM.yyyy", "yyyy-MM-dd", "'n/a'", None, "'2023-02-30'"],
}
LOW, HIGH, LATER = "2021-06-15", "2026-12-31", 312
_SQL_FORMATS = {"yyyy-MM-dd": "%Y-%m-%d", "dd.MM.yyyy": "%d.%m.%Y", "MM/dd/yyyy": "%m/%d/%Y", "dd/MM/yyyy": "%d/%m/%Y"}


def _texts(spark: SparkSession, d: str, layout: str) -> DataFrame:
    """Orders with their date, 26 years later, as text."""
    at = F.add_months(F.col("o_orderdate").cast("date"), LATER)
    write = lambda f: F.lit(None) if f is None else F.lit(f.strip("'")) if f.startswith("'") else F.date_format(at, f)
    text = F.when(F.lit(False), F.lit(""))
    for i, f in enumerate(LAYOUTS[layout]):
        text = text.when(F.col("o_orderkey") % 10 == i, write(f))
    return _t(spark, d, "orders").select(text.alias("sale_date"))


def _texts_sql(layout: str) -> str:
    write = lambda f: "NULL" if f is None else f if f.startswith("'") else f"strftime((o_orderdate::DATE + INTERVAL {LATER} MONTH)::DATE, '{_SQL_FORMATS[f]}')"
    return "SELECT CASE o_orderkey % 10 " + " ".join(f"WHEN {i} THEN {write(f)}" for i, f in enumerate(LAYOUTS[layout])) + " END AS x FROM orders"


# The SQL formats of the ways of reading, as far as the texts have them.
_WAYS_SQL = {"general": ["%Y-%m-%d", "%m/%d/%Y"], "%Y-%m-%d": ["%Y-%m-%d"], "%m/%d/%Y": ["%m/%d/%Y"], "%d/%m/%Y": ["%d/%m/%Y"], "day_first": ["%Y-%m-%d", "%d/%m/%Y", "%d.%m.%Y"]}


def _read_sql(layout: str) -> str:
    """r: the texts with what the way taken reads; k: what the ways read."""
    reads = ", ".join(f"try_strptime(x, {f}) AS w{i}" for i, f in enumerate(_WAYS_SQL.values()))
    counts = ", ".join(f"count(w{i}) AS n{i}" for i in range(len(_WAYS_SQL)))
    best = " ".join(f"WHEN n{i} = greatest({', '.join(f'n{j}' for j in range(len(_WAYS_SQL)))}) THEN {i}" for i in range(len(_WAYS_SQL)))
    return f"""x AS ({_texts_sql(layout)}), w AS (SELECT x, {reads} FROM x), k AS (SELECT count(x) AS non_null, count(*) FILTER (lower(trim(x)) IN ('unknown', 'n/a', 'null', 'none', '')) AS no_date_words, {counts} FROM w),
        c AS (SELECT *, CASE WHEN n0 * 2 >= non_null THEN 0 {best} END AS i FROM k), r AS (SELECT x, [{', '.join(f'w{i}' for i in range(len(_WAYS_SQL)))}][i + 1] AS dt FROM w, c),
        f AS (SELECT *, x IS NULL OR coalesce(dt::DATE BETWEEN DATE '{LOW}' AND DATE '{HIGH}', false) AS fine FROM r)"""


def _report(spark: SparkSession, d: str, layout: str) -> DataFrame:
    out = text_dates.date_report(_texts(spark, d, layout), "sale_date", LOW, HIGH)
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("earliest", "latest")})


def _rule(spark: SparkSession, d: str, layout: str) -> DataFrame:
    return validation.validate(_texts(spark, d, layout), (validation.Rule("dates", "sale_date", "error", validation.DateRange(LOW, HIGH)),))


for _layout in LAYOUTS:
    QUERIES[f"val13_text_dates_{_layout}"] = lambda spark, d, layout=_layout: _report(spark, d, layout)
    ORACLES[f"val13_text_dates_{_layout}"] = f"""WITH {_read_sql(_layout)} SELECT {list(_WAYS_SQL)}[i + 1] AS way, non_null, no_date_words, n0 AS general_reads, count(*) AS total, count(dt) AS reads, count(*) FILTER (x IS NOT NULL AND dt IS NULL) AS unreadable,
        count(*) FILTER (dt IS NOT NULL AND NOT fine) AS out_of_range, count(*) FILTER (fine) AS valid, strftime(min(dt), '%Y-%m-%d') AS earliest, strftime(max(dt), '%Y-%m-%d') AS latest FROM f, c GROUP BY ALL"""
    QUERIES[f"val13_rule_{_layout}"] = lambda spark, d, layout=_layout: _rule(spark, d, layout)
    ORACLES[f"val13_rule_{_layout}"] = f"""WITH {_read_sql(_layout)}, e AS (SELECT count(*) AS total_records, count(*) FILTER (fine) AS valid_records FROM f)
        SELECT 'dates' AS rule_name, 'sale_date' AS field, 'error' AS severity, *, round_even((total_records - valid_records)::DOUBLE / total_records * 1e6, 0) / 1e4 AS error_rate, (total_records - valid_records) * 10 <= total_records AS passed FROM e"""

#: A rule that fails on the first row it meets: product names aren't numbers.
_RAISES = validation.Rule("name_is_number", "product_name", "critical", lambda c: c.cast("int") > 0)
QUERIES["val18_isolated"] = lambda spark, d: validation.validate_isolated(sales(spark, d), (*validation.DEFAULT_RULES, _RAISES)).withColumn("failed_to_run", F.col("error").isNotNull()).drop("error")
ORACLES["val18_isolated"] = f"WITH {SALES}, {_RESULTS} SELECT *, false AS failed_to_run FROM results UNION ALL SELECT 'name_is_number', 'product_name', 'critical', count(*), 0, 100.0, false, true FROM sales"

QUERIES["val22_error_report"] = lambda spark, d: _errors(sales(spark, d))
ORACLES["val22_error_report"] = f"""WITH {SALES}, {_RESULTS}, {_ERRORS.split(', e AS')[0]}, f AS ({_FAILED}), c AS (SELECT rule_name, value, count(*) AS records FROM f GROUP BY 1, 2),
    p AS (SELECT *, row_number() OVER (PARTITION BY rule_name ORDER BY records DESC, value NULLS FIRST) AS place FROM c QUALIFY place <= 3), s AS (SELECT rule_name, string_agg(coalesce(value, 'null') || ' x ' || records, '; ' ORDER BY place) AS most_frequent FROM p GROUP BY 1)
    SELECT rule_name, field, severity, kind || '_' || severity AS error_type, total_records - valid_records AS failed_records, error_rate, coalesce(most_frequent, '') AS most_frequent FROM results JOIN k USING (rule_name) LEFT JOIN s USING (rule_name) WHERE NOT passed"""


def _errors(s: DataFrame) -> DataFrame:
    report = validation.error_report(validation.validate(s), validation.problematic_values(s, n=3))
    said = F.array_join(F.transform("values", lambda v: F.concat(F.coalesce(v["value"], F.lit("null")), F.lit(" x "), v["records"].cast("string"))), "; ")
    return report.withColumn("most_frequent", said).drop("values")


_FEATURES = ["quantity", "unit_price", "discount_percent", "revenue"]
QUERIES["sta3_isolation_forest"] = lambda spark, d: forest.isolation_forest(sales(spark, d), _FEATURES).select("order_id", "line", "part", "supplier", *_FEATURES, forest.FLAG, half_even(F.col(forest.SCORE), 9).alias(forest.SCORE))

# Approximate figures against the exact ones
QUERIES["approx_monthly_orders"] = lambda spark, d: _approximate_orders(sales(spark, d))
ORACLES["approx_monthly_orders"] = f"WITH {SALES} SELECT strftime(sale_date, '%Y-%m') AS month, count(*) AS transactions, count(DISTINCT order_id) AS unique_orders, true AS near FROM sales GROUP BY 1"
_PROBABILITIES = (0.25, 0.5, 0.75, 0.95)
QUERIES["approx_revenue_quantiles"] = lambda spark, d: _approximate_quantiles(sales(spark, d))
ORACLES["approx_revenue_quantiles"] = f"WITH {SALES} SELECT p.probability::DOUBLE AS probability, count(*) AS transactions, true AS near FROM sales, (VALUES {', '.join(f'({p})' for p in _PROBABILITIES)}) AS p(probability) GROUP BY 1"


def _approximate_orders(s: DataFrame) -> DataFrame:
    """Distinct orders by month, counted, and whether the sketch is within 5 %."""
    near = sketches.estimates(sketches.monthly_sketches(s)).select("month", F.col("unique_orders").alias("about"))
    exact = s.groupBy(F.date_format("sale_date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("transactions"), F.count_distinct("order_id").alias("unique_orders"))
    return exact.join(near, "month").withColumn("near", F.abs(F.col("about") - F.col("unique_orders")) <= 0.05 * F.col("unique_orders")).drop("about")


def _approximate_quantiles(s: DataFrame) -> DataFrame:
    """Whether quantiles of all months together, from the months' sketches, have a rank within 2 % of the wanted one."""
    got = sketches.estimates(sketches.merged(sketches.monthly_sketches(s)), _PROBABILITIES).select("quantiles")  # one row
    below = [F.avg((F.col("revenue") <= F.col("quantiles")[i]).cast("double")) for i in range(len(_PROBABILITIES))]
    one = s.select("revenue").crossJoin(F.broadcast(got)).agg(F.count(F.lit(1)).alias("transactions"), F.array(*below).alias("shares"))
    rows = F.array(*(F.struct(F.lit(p).alias("probability"), (F.abs(F.col("shares")[i] - p) <= 0.02).alias("near")) for i, p in enumerate(_PROBABILITIES)))
    return one.select("transactions", F.explode(rows).alias("r")).select("r.probability", "transactions", "r.near")


# Cleaning reports
QUERIES["cln10_advice"] = lambda spark, d: reports.cleaning_advice(cleaning.report(_dirty(spark, d)), cleaning.issues(_dirty(spark, d)))
_SHARE = "count(*) FILTER (p_partkey % {0} IN {1}) * 1.0 / count(*)"
ORACLES["cln10_advice"] = f"""WITH s AS (SELECT {_SHARE.format(9, '(1, 2, 7)')} AS qe, {_SHARE.format(9, '(6,)')} AS qc, {_SHARE.format(8, '(1, 2, 5)')} AS de, {_SHARE.format(8, '(0, 6)')} AS dc, count(*) FILTER (p_partkey % 9 = 2) AS qn, count(*) FILTER (p_partkey % 8 = 2) AS dn FROM part),
    a AS (SELECT 'quantity' AS subject, 'improve_collection' AS advice FROM s WHERE qe > 0.1 UNION ALL SELECT 'discount_percent', 'improve_collection' FROM s WHERE de > 0.1 UNION ALL SELECT 'quantity', 'review_entry_guidelines' FROM s WHERE qc > 0.2
    UNION ALL SELECT 'discount_percent', 'review_entry_guidelines' FROM s WHERE dc > 0.2 UNION ALL SELECT 'quantity', 'review_formats' FROM s WHERE qn > 100 UNION ALL SELECT 'discount_percent', 'review_formats' FROM s WHERE dn > 100)
    FROM a UNION ALL SELECT 'all', 'none' WHERE NOT EXISTS (FROM a)""".replace("(6,)", "(6)")
QUERIES["cln11_report"] = lambda spark, d: cleaning.standardization_report(_dirty(spark, d))
_AFTER = {
    "region": (f"lower({DIRTY_REGION})", "CASE p_partkey % 6 WHEN 0 THEN 'North' WHEN 1 THEN 'Southeast' WHEN 4 THEN 'Unknown_region' WHEN 5 THEN 'West' ELSE 'Unknown' END"),
    "sale_date": (DIRTY_DATE, "CASE p_partkey % 5 WHEN 0 THEN '2023-01-05' WHEN 1 THEN '2023-01-15' WHEN 4 THEN '2023-01-15 10:30' END"),
}
ORACLES["cln11_report"] = " UNION ALL ".join(
    f"""SELECT '{f}' AS field, count(DISTINCT a) AS unique_before, count(DISTINCT b) AS unique_after, round_even((count(DISTINCT a) - count(DISTINCT b))::DOUBLE / count(DISTINCT a) * 1e4, 0) / 1e4 AS reduction_ratio, count(*) FILTER (a IS NULL) AS nulls_before,
    count(*) FILTER (b IS NULL) AS nulls_after, round_even(count(b)::DOUBLE / count(*) * 1e4, 0) / 1e4 AS parse_rate FROM (SELECT {a} AS a, {b} AS b FROM part)"""
    for f, (a, b) in _AFTER.items()
)
