"""The analytical tables: grouped aggregations over sales rows. Groups are few; rows meet in partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.cleaning import require, with_revenue
from ..functions.numeric import davg, dsum, half_even, ratio
from ..functions.quantiles import moments, quantiles
from ..functions.written import written


def monthly_sales_summary(df: DataFrame) -> DataFrame:
    require(df, "sale_date", "quantity", "discount_percent", "order_id")
    d = with_revenue(df).filter("sale_date IS NOT NULL").withColumn("month", F.date_format("sale_date", "yyyy-MM"))
    g = d.groupBy("month").agg(
        half_even(dsum("revenue")).alias("total_revenue"), F.count("revenue").alias("transaction_count"), F.sum("quantity").alias("total_quantity"),
        half_even(davg("discount_percent")).alias("avg_discount"), F.count_distinct("order_id").alias("unique_orders"),
    )
    return g.withColumn("avg_order_value", half_even(ratio(F.col("total_revenue"), F.col("unique_orders")))).orderBy("month")


def _products(df: DataFrame) -> DataFrame:
    return with_revenue(df).filter("product_name IS NOT NULL").groupBy("product_name").agg(
        half_even(dsum("revenue")).alias("total_revenue"), F.sum("quantity").alias("total_units"), half_even(davg("unit_price")).alias("avg_unit_price"),
        half_even(davg("discount_percent")).alias("avg_discount"), F.count_distinct("order_id").alias("order_count"), F.min("category").alias("category"),
    )


def top_products(df: DataFrame, n: int = 10) -> DataFrame:
    """The first n by revenue and by units (dense ranks, ties by name). The category is the smallest one."""
    p = written(_products(df), "products")  # sales rows are gone over once
    rev, units = F.col("total_revenue").desc(), F.col("total_units").desc()
    # each top n is taken from partial top lists; ranks over all products are joined to these few rows
    best = p.orderBy(rev, "product_name").limit(n).union(p.orderBy(units, "product_name").limit(n)).distinct()
    values = lambda c: F.broadcast(best.select(c).distinct())  # noqa: E731  2 n values at most
    rank = lambda c, to: p.select(F.col(c).alias("_all")).distinct().join(values(c), F.col("_all") >= F.col(c)).groupBy(c).agg(F.count(F.lit(1)).cast("int").alias(to))
    ranked = best.join(F.broadcast(rank("total_revenue", "revenue_rank")), "total_revenue").join(F.broadcast(rank("total_units", "units_rank")), "total_units")
    reason = F.when(F.col("revenue_rank") <= n, "Revenue").when(F.col("units_rank") <= n, "Units").otherwise("Both")
    return ranked.select("product_name", "total_revenue", "total_units", "avg_unit_price", "avg_discount", "order_count", "category", "revenue_rank", "units_rank", reason.alias("top_reason")).orderBy("revenue_rank", "product_name")


def region_wise_performance(df: DataFrame) -> DataFrame:
    d = with_revenue(df).filter("region IS NOT NULL")
    g = d.groupBy("region").agg(
        half_even(dsum("revenue")).alias("total_revenue"), half_even(davg("revenue")).alias("avg_revenue_per_transaction"), F.sum("quantity").alias("total_quantity"),
        half_even(davg("unit_price")).alias("avg_unit_price"), half_even(davg("discount_percent")).alias("avg_discount"), F.count_distinct("order_id").alias("unique_orders"),
    )
    by = d.filter("category IS NOT NULL").groupBy("region", "category").agg(dsum("revenue").alias("r"))
    top = by.groupBy("region").agg(F.min_by("category", F.struct(-F.col("r"), "category")).alias("top_category"))
    # a region is a row here, so windows over all of them are small
    g = g.join(top, "region", "left").withColumns({
        "avg_order_value": half_even(ratio(F.col("total_revenue"), F.col("unique_orders"))),
        "avg_items_per_order": half_even(ratio(F.col("total_quantity"), F.col("unique_orders"))),
        "market_share_pct": half_even(ratio(F.col("total_revenue"), dsum_over("total_revenue")) * 100),
        "performance_rank": F.row_number().over(Window.orderBy(F.col("total_revenue").desc(), "region")),
    })
    return g.orderBy("performance_rank")


def dsum_over(c: str):
    return F.sum(F.col(c).cast("decimal(20,6)")).over(Window.partitionBy()).cast("double")


def category_discount_map(df: DataFrame) -> DataFrame:
    """discount_penetration_pct is distinct discounted orders over distinct orders.

    Orders are counted by grouping to (category, order) first, so that rows aren't multiplied for distinct counts;
    figures of discounts come from the counts of their values.
    """
    d = with_revenue(df).filter("category IS NOT NULL")
    cut = F.col("discount_percent") > 0
    orders = d.groupBy("category", "order_id").agg(F.sum(F.col("revenue").cast("decimal(20,6)")).alias("r"), F.sum("quantity").alias("q"), F.max(cut.cast("int")).alias("cut"))
    has = F.col("order_id").isNotNull()
    g = orders.groupBy("category").agg(
        half_even(F.sum("r").cast("double"), 4).alias("total_revenue"), F.sum("q").alias("total_quantity"), F.count_if(has).alias("order_count"), F.count_if(has & (F.col("cut") == 1)).alias("discounted"),
    )
    counts = written(d.filter("discount_percent IS NOT NULL").groupBy(F.col("category").alias("name"), F.col("discount_percent").cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n")), "discounts")
    means = counts.groupBy("name").agg(F.try_divide(F.sum(F.col("x").cast("decimal(20,6)") * F.col("n")).cast("double"), F.sum("n")).alias("m"))
    figures = moments(counts).drop("total", "mean").join(means, "name").join(quantiles(counts, (0.5,)).drop("total"), "name").select(
        F.col("name").alias("category"), half_even(F.col("m"), 4).alias("avg_discount"), half_even(F.col("q")[0], 4).alias("median_discount"), half_even(F.col("std"), 4).alias("discount_std"),
        half_even(F.col("low"), 4).alias("min_discount"), half_even(F.col("high"), 4).alias("max_discount"),
    )
    g = g.join(figures, "category", "left")
    a = F.col("avg_discount")
    g = g.withColumns({
        "discount_effectiveness_score": half_even(F.col("total_revenue") * a),
        "discount_penetration_pct": half_even(ratio(F.col("discounted"), F.col("order_count")) * 100),
        "avg_discount_amount": half_even(ratio(F.col("total_revenue") * a, F.col("order_count"))),
        "discount_strategy": F.when(a < 0.05, "Low Discount").when(a < 0.15, "Moderate Discount").when(a < 0.30, "High Discount").otherwise("Very High Discount"),
    })
    names = ("category", "avg_discount", "median_discount", "discount_std", "min_discount", "max_discount", "total_revenue", "total_quantity", "order_count", "discount_effectiveness_score", "discount_penetration_pct", "avg_discount_amount", "discount_strategy")
    return g.select(*names).orderBy(a.desc(), "category")


def dashboard_monthly(df: DataFrame) -> DataFrame:
    d = with_revenue(df).filter("sale_date IS NOT NULL").groupBy(F.date_format("sale_date", "yyyy-MM").alias("month"))
    g = d.agg(dsum("revenue").alias("total_revenue"), F.sum("quantity").alias("total_quantity"), davg("discount_percent").alias("avg_discount"), F.count_distinct("order_id").alias("unique_orders"))
    return g.withColumn("avg_order_value", ratio(F.col("total_revenue"), F.col("unique_orders"))).orderBy("month")


def dashboard_products(df: DataFrame, n: int = 20) -> DataFrame:
    """The first n by revenue; units_rank is within them."""
    best = _products(df).orderBy(F.col("total_revenue").desc(), "product_name").limit(n)
    by = lambda c: F.row_number().over(Window.orderBy(F.col(c).desc(), "product_name"))  # noqa: E731  over n rows
    return best.withColumns({"revenue_rank": by("total_revenue"), "units_rank": by("total_units")})


def all_products_ranked(df: DataFrame, n: int = 50) -> DataFrame:
    """The first n by revenue; units_rank is among all products, ties by name."""
    p = written(_products(df), "products")
    best = p.orderBy(F.col("total_revenue").desc(), "product_name").limit(n)
    own = F.broadcast(best.select(F.col("product_name").alias("_name"), F.col("total_units").alias("_units")))  # n rows
    ahead = (F.col("total_units") > F.col("_units")) | ((F.col("total_units") == F.col("_units")) & (F.col("product_name") < F.col("_name")))
    before = p.select("product_name", "total_units").join(own, ahead).groupBy(F.col("_name").alias("product_name")).agg(F.count(F.lit(1)).alias("_before"))
    rank = F.row_number().over(Window.orderBy(F.col("total_revenue").desc(), "product_name"))  # over n rows
    return best.join(F.broadcast(before), "product_name", "left").withColumns({"revenue_rank": rank, "units_rank": (F.coalesce("_before", F.lit(0)) + 1).cast("int")}).drop("_before")


def dashboard_discounts(df: DataFrame) -> DataFrame:
    g = with_revenue(df).filter("category IS NOT NULL").groupBy("category").agg(
        davg("discount_percent").alias("avg_discount"), F.count_if(F.col("discount_percent") > 0).alias("discount_count"), dsum("revenue").alias("total_revenue"),
        (F.count_if(F.col("discount_percent") > 0) / F.count(F.lit(1)) * 100).alias("discount_penetration"),
    )
    return g.withColumn("discount_effectiveness", F.col("total_revenue") / (F.col("avg_discount") * 100 + 1))


def dashboard_metrics(monthly: DataFrame) -> DataFrame:
    """One row from the monthly table: totals, unweighted means, growth of the last month as text."""
    w = Window.orderBy("month")  # over months
    m = monthly.withColumns({c: F.lag(c[4:]).over(w) for c in ("was_total_revenue", "was_unique_orders", "was_avg_order_value")})
    text = lambda c: F.coalesce(F.format_string("%+.1f%%", F.max_by(ratio(F.col(c) - F.col(f"was_{c}"), F.col(f"was_{c}")) * 100, "month")), F.lit("N/A"))
    last = lambda c: F.when(F.max_by(F.col(f"was_{c}"), "month") > 0, text(c)).otherwise("N/A")
    return m.agg(
        half_even(dsum("total_revenue")).alias("total_revenue"), F.sum("unique_orders").alias("total_orders"), half_even(davg("avg_order_value")).alias("avg_order_value"),
        half_even(davg("avg_discount"), 4).alias("avg_discount"), last("total_revenue").alias("revenue_growth"), last("unique_orders").alias("orders_growth"), last("avg_order_value").alias("aov_growth"),
    )


def filtered(df: DataFrame, **chosen: list) -> DataFrame:
    """isin by column, where the column exists and the list isn't empty."""
    for c, values in chosen.items():
        if values and c in df.columns:
            df = df.filter(F.col(c).isin(list(values)))
    return df


def normalised(df: DataFrame, *columns: str) -> DataFrame:
    """Min-max to 0..1 for a heat map of few rows; constant columns become 0.5."""
    w = Window.partitionBy()
    span = lambda c: F.max(c).over(w) - F.min(c).over(w)
    return df.withColumns({f"{c}_norm": F.when(span(c) > 0, (F.col(c) - F.min(c).over(w)) / span(c)).otherwise(0.5) for c in columns})
