"""Summaries over operational event tables, health roll-ups, alert rules and a data profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import half_even

# Levels in rising order, alert rules (name, severity, metric, comparison, bound) and health limits.
LEVELS = ("healthy", "warning", "critical", "failed")
ALERT_RULES = (
    ("high_memory_usage", "warning", "memory_percent", ">", 85.0),
    ("critical_memory_usage", "critical", "memory_percent", ">", 95.0),
    ("high_cpu_usage", "warning", "cpu_percent", ">", 90.0),
    ("low_throughput", "warning", "average_throughput", "<", 1000.0),
    ("high_error_rate", "error", "success_rate", "<", 90.0),
    ("data_quality_degradation", "error", "overall_error_rate", ">", 10.0),
    ("pipeline_failure", "critical", "overall_status", "=", "failed"),
    ("low_disk_space", "warning", "disk_percent", ">", 90.0),
)
HEALTH_LIMITS = {"memory_percent": (80.0, 90.0), "cpu_percent": (80.0, 90.0), "disk_percent": (85.0, 95.0), "error_rate": (5.0, 10.0)}
QUALITY_BUCKETS = ((1.0, "excellent"), (5.0, "good"), (10.0, "fair"))


def recent(df: DataFrame, column: str, now: str, hours: float) -> DataFrame:
    """Rows of the last hours before now."""
    return df.filter(F.col(column).cast("timestamp_ntz") >= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(0), secs=F.lit(hours * 3600.0)))


def processing_summary(ops: DataFrame) -> DataFrame:
    """One row from (status, records, duration): counts, sums over completed operations, records a second, success in %."""
    done = F.col("status") == "completed"
    one = ops.agg(
        F.count(F.lit(1)).alias("total_operations"), F.count_if(done).alias("completed_operations"), F.count_if(F.col("status") == "failed").alias("failed_operations"),
        F.coalesce(F.sum(F.when(done, F.col("records"))), F.lit(0)).cast("long").alias("total_records_processed"), F.coalesce(F.sum(F.when(done, F.col("duration").cast("decimal(20,6)"))).cast("double"), F.lit(0.0)).alias("total_processing_time"),
    )
    return one.withColumns({
        "average_throughput": F.coalesce(half_even(F.try_divide(F.col("total_records_processed").cast("double"), F.col("total_processing_time")), 4), F.lit(0.0)),
        "success_rate": half_even(F.try_divide(F.col("completed_operations") * F.lit(100.0), F.col("total_operations").cast("double")), 4),
    })


def quality_summary(metrics: DataFrame) -> DataFrame:
    """One row from (total_records, valid_records)."""
    n, ok = F.sum("total_records").cast("double"), F.sum("valid_records").cast("double")
    return metrics.agg(
        F.count(F.lit(1)).alias("total_metrics"), F.sum("total_records").alias("total_records_analyzed"), F.sum("valid_records").alias("total_valid_records"),
        F.coalesce(half_even(F.try_divide(n - ok, n) * 100, 4), F.lit(0.0)).alias("overall_error_rate"),
    )


def error_summary(errors: DataFrame, *keys: str) -> DataFrame:
    """Errors by the keys, with the latest time of each."""
    return errors.groupBy(*keys).agg(F.count(F.lit(1)).alias("errors"), F.max("ts").alias("last_seen"))


def health_level(value: Column, warning: float, critical: float) -> Column:
    return F.when(value >= critical, "critical").when(value >= warning, "warning").otherwise("healthy")


def health_rollup(checks: DataFrame, *keys: str) -> DataFrame:
    """The worst of LEVELS among (status) rows, by the keys; statuses beyond LEVELS count as healthy."""
    names = F.array(*map(F.lit, LEVELS))
    at = F.greatest(F.array_position(names, F.col("status")), F.lit(1))
    g = checks.groupBy(*keys).agg(F.max(at).alias("_worst"), F.count(F.lit(1)).alias("checks"), F.count_if(at > 1).alias("not_healthy"))
    return g.withColumn("status", F.element_at(names, F.col("_worst").cast("int"))).drop("_worst")


def fired_alerts(metrics: DataFrame, *keys: str) -> DataFrame:
    """A row for each metrics row and rule that fires: the keys, rule, severity. Missing and null metrics fire nothing."""
    said = []
    for name, severity, metric, op, bound in ALERT_RULES:
        if metric in metrics.columns:
            c = F.col(metric)
            fires = {">": c > F.lit(bound), "<": c < F.lit(bound), "=": c == F.lit(bound)}[op]
            said.append(F.when(fires, F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"))))
    if not said:
        return metrics.select(*keys, F.lit("").alias("rule"), F.lit("").alias("severity")).limit(0)
    return metrics.select(*keys, F.explode(F.array_compact(F.array(*said))).alias("_alert")).select(*keys, "_alert.rule", "_alert.severity")


def alert_summary(alerts: DataFrame, *keys: str) -> DataFrame:
    """Alerts by the keys, the resolved ones of them, and their share in %."""
    return alerts.groupBy(*keys).agg(F.count(F.lit(1)).alias("alerts"), F.count_if("resolved").alias("resolved"), half_even(F.count_if("resolved") * 100.0 / F.count(F.lit(1)), 4).alias("resolution_rate"))


def recovery_summary(attempts: DataFrame) -> DataFrame:
    """By action: attempts, successes, success in %."""
    return attempts.groupBy("action").agg(F.count(F.lit(1)).alias("attempts"), F.count_if("success").alias("successes"), half_even(F.count_if("success") * 100.0 / F.count(F.lit(1)), 4).alias("success_rate"))


def failure_type(kind: Column, message: Column) -> Column:
    """The first class whose words occur in the message, or whose exceptions are named."""
    m = F.lower(message)
    has = lambda *words: F.coalesce(F.greatest(*(m.contains(w) for w in words), F.lit(False)), F.lit(False))
    named = lambda *names: F.coalesce(kind.isin(*names), F.lit(False))
    return (
        F.when(has("memory") | named("MemoryError", "OutOfMemoryError"), "memory_error").when(has("timeout") | named("TimeoutError"), "timeout_error").when(has("io", "file") | named("IOError", "FileNotFoundError"), "io_error")
        .when(has("validation", "quality"), "validation_error").when(has("corrupt", "invalid"), "data_corruption").otherwise("processing_error")
    )


def quality_bucket(error_rate: Column) -> Column:
    out = None
    for bound, name in QUALITY_BUCKETS:
        out = F.when(error_rate <= bound, name) if out is None else out.when(error_rate <= bound, name)
    return out.otherwise("poor")


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """(field, value, n) of few-valued columns, in one pass; nulls don't count."""
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.explode(pairs).alias("x")).filter("x.value IS NOT NULL").groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))


def null_counts(df: DataFrame) -> DataFrame:
    """(field, nulls) of all columns, in one pass."""
    one = df.agg(*(F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"n{i}").alias("nulls")) for i, c in enumerate(df.columns)))).alias("x")).select("x.*")


def profile(df: DataFrame) -> DataFrame:
    """One row over sales rows: records, first and last sale, revenue figures, ids that repeat an earlier one."""
    r = F.col("revenue").cast("double")
    ids = df.groupBy("order_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_order_ids"))
    one = df.agg(
        F.count(F.lit(1)).alias("total_records"), F.min("sale_date").alias("first_sale"), F.max("sale_date").alias("last_sale"), half_even(F.sum(r.cast("decimal(20,6)")).cast("double")).alias("revenue_total"),
        half_even(F.avg(r), 4).alias("revenue_mean"), half_even(F.stddev_samp(r), 4).alias("revenue_std"),
    )
    return one.crossJoin(ids)  # one row each
