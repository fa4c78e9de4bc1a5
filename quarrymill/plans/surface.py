"""The tables for users of SQL: temporary views, functions that return tables, and a function over lines of CSV."""

from __future__ import annotations

import csv
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.cleaning import with_revenue
from ..operators import anomalies, sketches
from ..sources import generate, outputs
from .pipeline import analytical_tables

# Functions by name: parameters, and the query they return; sales, monthly_sales_summary and sales_anomalies are views.
FUNCTIONS = {
    "sales_between": ("first DATE, last DATE", "SELECT * FROM sales WHERE sale_date >= first AND sale_date < last + INTERVAL 1 DAY"),
    "monthly_between": ("first STRING, last STRING", "SELECT * FROM monthly_sales_summary WHERE month BETWEEN first AND last"),
    "sales_of_region": ("name STRING", "SELECT * FROM sales WHERE region = name"),
    "products_of_category": ("name STRING", "SELECT product_name, count(*) AS transactions, sum(quantity) AS total_units, rint(sum(revenue) * 100) / 100 AS total_revenue FROM sales WHERE category = name GROUP BY product_name"),
    "anomalies_over": ("score DOUBLE", "SELECT * FROM sales_anomalies WHERE composite_anomaly_score > score"),
}


@F.udtf(returnType="place int, value string")
class CsvFields:
    """csv_fields(record, separator): a row for each field of a record, its quotes taken away; no record, no rows."""

    def eval(self, record: str, separator: str) -> Iterator[tuple[int, str]]:
        if record is not None:
            for row in csv.reader([record], delimiter=separator):
                yield from enumerate(row)


def register(spark: SparkSession, sales: DataFrame) -> list[str]:
    """Makes views of the sales rows, the analytical tables, the anomalies and the monthly sketches, and the FUNCTIONS over
    them; returns their names. Views are lazy; views and functions of the same names are replaced."""
    d = with_revenue(sales)
    detected = anomalies.detect(d)
    scores = [f"{m}_anomaly_score" for m in anomalies.MEASURES]
    flagged = " OR ".join(f"{m}_anomaly_{k}" for m in anomalies.MEASURES for k in ("zscore", "iqr"))
    views = {"sales": d} | analytical_tables(d) | {"sales_anomalies": detected.filter(flagged).withColumn("composite_anomaly_score", sum((F.col(c) for c in scores), F.lit(0.0))), "monthly_sketches": sketches.monthly_sketches(d)}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    for name, (parameters, query) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE RETURN {query}")
    spark.udtf.register("csv_fields", CsvFields)
    return [*views, *FUNCTIONS, "csv_fields"]


def register_exports(spark: SparkSession, folder: str, names: tuple[str, ...]) -> dict[str, str]:
    """Makes a view exported_<name> of the newest export of each name, and returns its source; what is missing has none."""
    found = outputs.resolve(spark, folder, names)
    for name, (_, df) in found.items():
        if df is not None:
            df.createOrReplaceTempView(f"exported_{name}")
    return {n: source for n, (source, df) in found.items() if df is not None}


def register_generated(spark: SparkSession, rows: int, seed: int = 42) -> list[str]:
    """Makes views generated_clean, generated_dirty, generated_anomalous and generated_mixed of so many rows."""
    for kind in ("clean", "dirty", "anomalous", "mixed"):
        getattr(generate, kind)(spark, rows, seed).createOrReplaceTempView(f"generated_{kind}")
    return [f"generated_{kind}" for kind in ("clean", "dirty", "anomalous", "mixed")]
