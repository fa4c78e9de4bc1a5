"""The whole batch: read, clean, validate, tables, anomalies, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.cleaning import clean, with_revenue
from ..operators import anomalies, tables, validation
from ..sources import files


TABLES = ("monthly_sales_summary", "top_products", "region_wise_performance", "category_discount_map", "anomaly_records")


def analytical_tables(sales: DataFrame, z: float = 3.0) -> dict[str, DataFrame]:
    d = with_revenue(sales)
    return {
        "monthly_sales_summary": tables.monthly_sales_summary(d), "top_products": tables.top_products(d), "region_wise_performance": tables.region_wise_performance(d),
        "category_discount_map": tables.category_discount_map(d), "anomaly_records": anomalies.top_records(anomalies.detect(d, z=z)),
    }


def run(spark: SparkSession, paths: str | list[str], folder: str, z: float = 3.0) -> dict:
    """Cleans once, persists the cleaned rows for the tables, and exports. Returns paths and the validation result."""
    cleaned = with_revenue(clean(files.read_sales_csv(spark, paths))).persist()
    try:
        result = validation.validate_isolated(cleaned).drop("error")
        return {"validation": [r.asDict() for r in result.collect()], "exports": files.export_tables(analytical_tables(cleaned, z), folder)}
    finally:
        cleaned.unpersist()
