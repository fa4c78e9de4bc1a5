"""Dashboard tables and figures, from sales rows or from the analytical tables. All but the tables are over few rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cleaning import with_revenue
from ..functions.numeric import davg, dsum, half_even, ratio
from .tables import dsum_over

# Fixed value: the reason of an anomaly that has none.
DEFAULT_REASON = "Statistical outlier detected by ETL pipeline"
ANOMALY_COLUMNS = ("order_id", "product_name", "revenue", "quantity", "unit_price", "anomaly_score", "anomaly_type")


def dashboard_regions(df: DataFrame, with_discount: bool = False) -> DataFrame:
    """The region table without rounding; the best category by revenue, ties by name; the mean discount, if asked for."""
    d = with_revenue(df).filter("region IS NOT NULL")
    g = d.groupBy("region").agg(dsum("revenue").alias("total_revenue"), F.count_distinct("order_id").alias("unique_orders"), F.sum("quantity").alias("total_quantity"), *[davg("discount_percent").alias("avg_discount")] * with_discount)
    by = d.filter("category IS NOT NULL").groupBy("region", "category").agg(dsum("revenue").alias("r"))
    top = by.groupBy("region").agg(F.min_by("category", F.struct(-F.col("r"), "category")).alias("top_category"))
    g = g.join(top, "region", "left").withColumn("avg_order_value", ratio(F.col("total_revenue"), F.col("unique_orders")))
    return with_market_share(g)


def first_rows(table: DataFrame, by: str, n: int = 10, low: int = 5, high: int = 20) -> DataFrame:
    """The n rows with the largest ``by``, nulls last, ties by the other columns; n is kept between low and high."""
    rest = [F.col(f"`{c}`") for c in table.columns if c != by]
    return table.orderBy(F.col(f"`{by}`").desc_nulls_last(), *rest).limit(max(low, min(n, high)))


def with_market_share(regions: DataFrame) -> DataFrame:
    """Adds market_share_pct of total_revenue, if it is missing."""
    return regions if "market_share_pct" in regions.columns else regions.withColumn("market_share_pct", ratio(F.col("total_revenue"), dsum_over("total_revenue")) * 100)


def _scored(df: DataFrame, z: float) -> DataFrame:
    stats = df.agg(*(f(F.col(c).cast("double")).alias(f"_{n}_{c}") for c in ("revenue", "quantity") for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    d = df.crossJoin(F.broadcast(stats))  # one row
    far = {c: F.coalesce(F.try_divide(F.abs(F.col(c).cast("double") - F.col(f"_m_{c}")), F.col(f"_s_{c}")), F.lit(0.0)) for c in ("revenue", "quantity")}
    score = F.greatest(*far.values())
    kind = F.when(far["revenue"] > far["quantity"], "High Revenue").otherwise("High Quantity")
    return d.filter(score > z).withColumns({"anomaly_score": half_even(score, 6), "anomaly_type": kind}).select(*df.columns, "anomaly_score", "anomaly_type")


def anomaly_records(df: DataFrame, n: int = 100, z: float = 3.0) -> DataFrame:
    """The first n anomalies: rows marked is_anomaly, else of an anomaly_score over z, else scored by revenue and quantity.

    By score (revenue, if there is none), ties by the shown columns.
    """
    d = with_revenue(df)
    if "is_anomaly" in d.columns:
        d = d.filter("is_anomaly")
    elif "anomaly_score" in d.columns:
        d = d.filter(F.col("anomaly_score") > z)
    else:
        d = _scored(d, z)
    shown = [c for c in ANOMALY_COLUMNS if c in d.columns]
    by = "anomaly_score" if "anomaly_score" in shown else "revenue"
    reason = F.col("reason") if "reason" in d.columns else F.lit(DEFAULT_REASON)
    return d.select(*shown, reason.alias("reason")).orderBy(F.col(by).desc_nulls_last(), *(c for c in shown if c != by)).limit(n)


def kpis(regions: DataFrame, products: DataFrame, anomalies: DataFrame) -> DataFrame:
    """One row: numbers of regions, products and anomalies, the best region and product, the mean score."""
    best = lambda c: F.coalesce(F.min_by(c, F.struct(-F.col("total_revenue"), c)), F.lit("N/A"))
    score = F.coalesce(half_even(F.avg("anomaly_score"), 4), F.lit(0.0)) if "anomaly_score" in anomalies.columns else F.lit(0.0)
    r = regions.agg(F.count(F.lit(1)).alias("total_regions"), best("region").alias("top_region"))
    p = products.agg(F.count(F.lit(1)).alias("total_products"), best("product_name").alias("top_product"))
    return r.crossJoin(p).crossJoin(anomalies.agg(F.count(F.lit(1)).alias("total_anomalies"), score.alias("avg_anomaly_score")))  # one row each


def anomaly_kpis(anomalies: DataFrame) -> DataFrame:
    """One row: count, mean score, revenue and the most frequent type (ties: the smallest)."""
    g = anomalies.groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("n"), dsum("anomaly_score").alias("s"), dsum("revenue").alias("r"))
    top = F.min_by("anomaly_type", F.when(F.col("anomaly_type").isNotNull(), F.struct(-F.col("n"), F.col("anomaly_type"))))
    return g.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("anomalies"), F.coalesce(half_even(F.try_divide(dsum("s"), F.sum("n")), 4), F.lit(0.0)).alias("avg_score"),
        F.coalesce(half_even(dsum("r")), F.lit(0.0)).alias("revenue_impact"), F.coalesce(top, F.lit("N/A")).alias("most_common_type"),
    )


def recent_months(monthly: DataFrame, n: int = 6) -> DataFrame:
    return monthly.orderBy(F.col("month").desc()).limit(n)


def severity_counts(results: DataFrame) -> DataFrame:
    """Of rule results: rules and failed rules by severity."""
    return results.groupBy("severity").agg(F.count(F.lit(1)).alias("rules"), F.count_if(~F.col("passed")).alias("failed"))


def problem_fields(results: DataFrame, n: int = 1) -> DataFrame:
    """The n fields of the highest mean error rate, ties by name."""
    g = results.groupBy("field").agg(half_even(F.avg("error_rate"), 4).alias("avg_error_rate"))
    return g.orderBy(F.col("avg_error_rate").desc(), "field").limit(n)


def quality_colour(score: Column) -> Column:
    return F.when(score >= 95, "green").when(score >= 85, "orange").otherwise("red")


def slowest_rules(timings: DataFrame, n: int = 5) -> DataFrame:
    """The n slowest of (rule_name, seconds), ties by name, in milliseconds."""
    return timings.orderBy(F.col("seconds").desc_nulls_last(), "rule_name").limit(n).select("rule_name", half_even(F.col("seconds") * 1000, 4).alias("milliseconds"))
