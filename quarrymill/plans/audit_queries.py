"""Queries over reports of the validation and of anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import dsum, half_even
from ..operators import anomalies, dashboards, reports, validation
from .queries import _ANY, _STATS, SALES, _a, _anomaly_sql, _r, _s, _t, sales
from .report_queries import _RESULTS, _RULES

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, make, sql: str) -> None:
    QUERIES[name] = lambda spark, d: make(sales(spark, d))
    ORACLES[name] = f"WITH {SALES} {sql}"


# Validation
_KINDS = f"k AS (SELECT * FROM (VALUES {', '.join(f"('{r.name}', '{r.kind}')" for r in validation.DEFAULT_RULES)}) AS k(rule_name, kind))"
_ERRORS = f"{_KINDS}, e AS (SELECT kind || '_' || severity AS error_type, count(*) AS rules FROM results JOIN k USING (rule_name) WHERE NOT passed GROUP BY 1)"
_query("val20_error_distribution", lambda s: validation.error_distribution(validation.validate(s)), f", {_RESULTS}, {_ERRORS} SELECT * FROM e")
_query("dsh12_error_advice", lambda s: reports.error_advice(validation.error_distribution(validation.validate(s))),
       f""", {_RESULTS}, {_ERRORS} SELECT error_type AS subject, CASE error_type WHEN 'enum_warning' THEN 'extend_allowed_values' WHEN 'range_error' THEN 'review_bounds' WHEN 'format_warning' THEN 'standardise_formats' ELSE 'fill_missing_values' END AS advice
       FROM e WHERE error_type IN ('enum_warning', 'range_error', 'format_warning', 'not_null_critical')""")

_PREDICATES = [(r.name, r.field, _RULES[r.name]) for r in validation.DEFAULT_RULES if not isinstance(r.valid, str)]
_FAILED = " UNION ALL ".join(
    f"SELECT '{n}' AS rule_name, {f}::VARCHAR AS value FROM sales WHERE NOT coalesce({c[c.index('FILTER (') + 8 : -1]}, {'false' if n in ('quantity_positive', 'unit_price_positive', 'discount_range') else 'true'})" if "FILTER" in c else f"SELECT '{n}' AS rule_name, {f}::VARCHAR AS value FROM sales WHERE {f} IS NULL" for n, f, c in _PREDICATES
)
_query("val21_problematic_values", lambda s: validation.problematic_values(s, n=3), f""", f AS ({_FAILED}), c AS (SELECT rule_name, value, count(*) AS records FROM f GROUP BY 1, 2)
    SELECT *, row_number() OVER (PARTITION BY rule_name ORDER BY records DESC, value NULLS FIRST)::INT AS place FROM c QUALIFY place <= 3""")

_GROUP = f"count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, {_r(_a('error_rate'), 4)} AS avg_error_rate, {_r('count(*) FILTER (r.passed) * 100.0::DOUBLE / count(*)', 4)} AS success_rate FROM results r"
_query("val23_history_summary", lambda s: validation.history_summary(validation.validate(s)),
       f""", {_RESULTS} SELECT 'all' AS by, 'all' AS key, {_GROUP} UNION ALL SELECT 'severity', severity, {_GROUP} GROUP BY severity UNION ALL SELECT 'field', field, {_GROUP} GROUP BY field""")


def _by_duplicate(s: DataFrame) -> DataFrame:
    rows, _, _ = reports.validated(s.drop("revenue"))
    return rows.groupBy("is_duplicate").agg(F.count(F.lit(1)).alias("n"), half_even(dsum("revenue")).alias("revenue"))


_query("val6_validated", _by_duplicate, f", d AS (SELECT greatest(quantity * unit_price * (1 - discount_percent), 0) AS x, count(*) OVER (PARTITION BY order_id) > 1 AS is_duplicate FROM sales) SELECT is_duplicate, count(*) AS n, {_r(_s('x'))} AS revenue FROM d GROUP BY 1")

# Anomalies
_REPORT = f"t AS (SELECT {_STATS} FROM sales), r AS (SELECT count(*) AS total_records, count(*) FILTER ({_ANY}) AS total_anomalies, {', '.join(_anomaly_sql(m, c) for m, c in anomalies.MEASURES.items())} FROM sales, t)"
_FLAGS = [(m, k) for m in anomalies.MEASURES for k in ("zscore", "iqr")]
_query("sta5_flag_shares", lambda s: reports.flag_shares(anomalies.detect(s)), f", {_REPORT} " + " UNION ALL ".join(f"SELECT '{m}_anomaly_{k}' AS flag, {m}_{k} AS records, {_r(f'{m}_{k} * 100.0::DOUBLE / total_records', 4)} AS percentage FROM r" for m, k in _FLAGS))
_TESTS = {"many_anomalies": "total_anomalies / total_records > 0.05", "few_anomalies": "total_anomalies / total_records < 0.001"} | {f"review_{m}": f"{m}_zscore + {m}_iqr > 0" for m in anomalies.MEASURES}
_query("ano6_detection_advice", lambda s: reports.detection_advice(anomalies.report(anomalies.detect(s))),
       f", {_REPORT}, a AS ({' UNION ALL '.join(f"SELECT '{c}' AS advice FROM r WHERE {t}" for c, t in _TESTS.items())}) SELECT 'detection' AS subject, advice FROM a UNION ALL SELECT 'detection', 'none' WHERE NOT EXISTS (FROM a)")
_ORDER = ("order_id", "line", "part", "supplier")
_query("sta5_top_scored", lambda s: reports.top_scored(anomalies.detect(s), 5, _ORDER, ()),
       f""", t AS (SELECT {_STATS} FROM sales) SELECT order_id, line, part, supplier, {_r(' + '.join(f'abs({c} - {m}_m) / {m}_s' for m, c in anomalies.MEASURES.items()), 6)} AS total_anomaly_score,
       concat_ws(', ', {', '.join(f"CASE WHEN abs({c} - {m}_m) / {m}_s > 3 THEN '{m}_anomaly_zscore' END, CASE WHEN {c} > {m}_b + 1.5 * ({m}_b - {m}_a)" + ('' if m == 'quantity' else f' OR {c} < {m}_a - 1.5 * ({m}_b - {m}_a)') + f" THEN '{m}_anomaly_iqr' END" for m, c in anomalies.MEASURES.items())}) AS anomaly_types
       FROM sales, t ORDER BY total_anomaly_score DESC, {', '.join(_ORDER)} LIMIT 5""")


def _bounds_sql(c: str) -> str:
    return f"""(WITH s AS (SELECT avg({c}) AS m, stddev_samp({c}) AS d, quantile_cont({c}::DOUBLE, [0.25, 0.5, 0.75, 0.025, 0.975]) AS q FROM sales), w AS (SELECT quantile_cont(abs({c} - q[2]), 0.5) * 3.5 * 1.4826 AS w FROM sales, s)
    SELECT '{c}' AS name, 'zscore' AS method, {_r('m - 3 * d', 4)} AS lower, {_r('m + 3 * d', 4)} AS upper FROM s UNION ALL SELECT '{c}', 'iqr', {_r('q[1] - 1.5 * (q[3] - q[1])', 4)}, {_r('q[3] + 1.5 * (q[3] - q[1])', 4)} FROM s
    UNION ALL SELECT '{c}', 'percentile', {_r('q[4]', 4)}, {_r('q[5]', 4)} FROM s UNION ALL SELECT '{c}', 'modified_zscore', {_r('q[2] - w', 4)}, {_r('q[2] + w', 4)} FROM s, w WHERE w > 0)"""


_MEASURED = ("revenue", "quantity", "discount_percent")
_query("sta5_thresholds", lambda s: anomalies.thresholds_of(s, _MEASURED).withColumns({c: half_even(F.col(c), 4) for c in ("lower", "upper")}), ", one AS (SELECT 1) " + " UNION ALL ".join(f"SELECT * FROM {_bounds_sql(c)}" for c in _MEASURED))
QUERIES["dsh11_slowest_rules"] = lambda spark, d: dashboards.slowest_rules(_t(spark, d, "events").select(F.col("event_id").cast("string").alias("rule_name"), F.col("value").alias("seconds")))
ORACLES["dsh11_slowest_rules"] = f"SELECT event_id::VARCHAR AS rule_name, {_r('value * 1000', 4)} AS milliseconds FROM events ORDER BY value DESC NULLS LAST, event_id::VARCHAR LIMIT 5"
