"""Metric bundles as one-row or per-key DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.cleaning import with_revenue
from ..functions.numeric import davg, dsum, half_even, ratio
from ..functions.quantiles import moments, quantiles_and_tops
from ..functions.written import written

TIERS = (("low", 0.0, 0.1), ("medium", 0.1, 0.3), ("high", 0.3, float("inf")))


def revenue_metrics(df: DataFrame) -> DataFrame:
    """One row. Growth figures over months that occur; top shares are of int(n * 0.05) rows and int(n * 0.1) customers.

    With a column sale_date, transactions, their means, the concentration and the customers are of rows with a date,
    while revenue figures are of all rows; shares are of the revenue of all rows.

    Rows are gone over twice: grouped by revenue, from which all figures of rows come, and by customer and month. All ranks
    are looked for at once.
    """
    d = with_revenue(df).dropna(subset=["revenue", "quantity", "unit_price"])
    dated = F.col("sale_date").isNotNull() if "sale_date" in df.columns else F.lit(True)
    exact = lambda c: F.sum(F.col(c).cast("decimal(20,6)")).alias(f"s_{c}")
    by = written(d.groupBy(F.col("revenue").cast("double").alias("x"), dated.alias("dated")).agg(F.count(F.lit(1)).alias("n"), *(exact(c) for c in ("revenue", "quantity", "unit_price"))), "revenues")
    on = F.col("dated")
    total = lambda c: F.sum(f"s_{c}").cast("double")
    mean = lambda c: half_even(F.try_divide(F.sum(F.when(on, F.col(f"s_{c}"))).cast("double"), F.sum(F.when(on, F.col("n")))))
    one = by.agg(
        half_even(total("revenue")).alias("total_revenue"), total("revenue").alias("_all"), half_even(F.try_divide(total("revenue"), F.sum("n"))).alias("avg_revenue_per_transaction"),
        F.coalesce(F.sum(F.when(on, F.col("n"))), F.lit(0)).alias("total_transactions"), mean("quantity").alias("avg_transaction_size"), mean("unit_price").alias("avg_unit_price"),
    )
    marks = {0.25: "revenue_25th_percentile", 0.5: "median_revenue_per_transaction", 0.75: "revenue_75th_percentile", 0.9: "revenue_90th_percentile", 0.95: "revenue_95th_percentile", 0.99: "revenue_99th_percentile"}
    dims = [c for c in ("customer_email", "sale_date") if c in df.columns]
    if dims:
        keys = [F.date_format(c, "yyyy-MM").alias("month") if c == "sale_date" else F.col(c) for c in dims]
        cells = written(d.filter(dated).groupBy(*keys).agg(F.sum(F.col("revenue").cast("decimal(20,6)")).alias("r")), "customers")
    # values of rows, of rows with a date and of customers, counted together
    counts = by.select(F.explode(F.when(on, F.array(F.lit("all"), F.lit("dated"))).otherwise(F.array(F.lit("all")))).alias("name"), "x", "n").groupBy("name", "x").agg(F.sum("n").alias("n"))
    if "customer_email" in dims:
        c = cells.filter("customer_email IS NOT NULL").groupBy("customer_email").agg(F.sum("r").cast("double").alias("x"))
        counts = counts.unionByName(c.groupBy(F.lit("customers").alias("name"), "x").agg(F.count(F.lit(1)).alias("n")))
    counts = written(counts, "counts")
    found = quantiles_and_tops(counts, tuple(marks), (0.05, 0.1))
    own = lambda name, c: F.max(F.when(F.col("name") == name, c))
    q = [half_even(own("all", F.col("q")[i])).alias(n) for i, n in enumerate(marks.values())]
    found = found.agg(*q, own("dated", F.col("tops")[0]).alias("_top"), own("customers", F.col("tops")[1]).alias("_share"), own("customers", F.col("q")[list(marks).index(0.5)]).alias("_median"))
    std = moments(counts.filter("name = 'all'")).agg(half_even(F.max("std")).alias("revenue_standard_deviation"))
    one = one.crossJoin(found).crossJoin(std)  # one row each, as all that follow
    one = one.withColumn("revenue_concentration_ratio", half_even(ratio(F.col("_top"), F.col("_all")), 4))
    if "sale_date" in dims:
        m = cells.groupBy("month").agg(F.sum("r").cast("double").alias("r"))
        m = m.withColumn("g", ratio(F.col("r") - F.lag("r").over(Window.orderBy("month")), F.lag("r").over(Window.orderBy("month"))))  # a row per month
        first, last = F.min_by("r", "month"), F.max_by("r", "month")
        one = one.crossJoin(m.agg(F.avg("g").alias("avg_monthly_growth_rate"), F.stddev_samp("g").alias("monthly_growth_volatility"), F.when(F.count(F.lit(1)) > 1, ratio(last - first, first)).alias("total_growth_rate")))
    if "customer_email" in dims:
        value = counts.filter("name = 'customers'").agg(F.try_divide(F.sum(F.col("x").cast("decimal(20,6)") * F.col("n")).cast("double"), F.sum("n")).alias("avg_customer_lifetime_value"))
        one = one.crossJoin(value).withColumns({"median_customer_lifetime_value": F.col("_median"), "top_10_percent_customer_contribution": ratio(F.col("_share"), F.col("_all"))})
    return one.drop("_all", "_top", "_share", "_median")


def discount_effectiveness(df: DataFrame) -> DataFrame:
    """One row, in one pass."""
    d = with_revenue(df).dropna(subset=["discount_percent", "revenue", "quantity"])
    on = F.col("discount_percent") > 0
    off = F.col("discount_percent") == 0
    some = [
        half_even(dsum(F.col("quantity") * F.col("unit_price") * F.col("discount_percent"))).alias("total_discount_amount"), half_even(davg("discount_percent"), 4).alias("avg_discount_rate"),
        half_even(F.count_if(on) / F.count(F.lit(1)), 4).alias("discount_penetration_rate"), F.count_if(on).alias("discounted_transactions"), F.count_if(off).alias("non_discounted_transactions"),
    ]
    for name, rows in (("discounted", on), ("non_discounted", off)):
        some += [half_even(F.coalesce(davg(F.when(rows, F.col(c))), F.lit(0.0))).alias(f"avg_{name}_{to}") for c, to in (("revenue", "transaction_value"), ("quantity", "quantity"))]
    for name, low, high in TIERS:
        tier = (F.col("discount_percent") > low) & (F.col("discount_percent") <= high)
        some += [half_even(F.coalesce(davg(F.when(tier, F.col(c))), F.lit(0.0))).alias(f"{name}_discount_avg_{c}") for c in ("revenue", "quantity")] + [F.count_if(tier).alias(f"{name}_discount_transaction_count")]
    d = d.agg(*some)
    for a, to in (("transaction_value", "revenue_impact_ratio"), ("quantity", "quantity_impact_ratio")):
        d = d.withColumn(to, F.coalesce(half_even(ratio(F.col(f"avg_discounted_{a}"), F.col(f"avg_non_discounted_{a}")), 4), F.lit(0.0)))
    return d.withColumn("discount_roi", F.when(F.col("revenue_impact_ratio") > 0, half_even((F.col("revenue_impact_ratio") - 1) * 100)).otherwise(0.0))


def category_effectiveness(df: DataFrame) -> DataFrame:
    d = with_revenue(df).dropna(subset=["discount_percent", "revenue", "quantity"]).filter("category IS NOT NULL")
    g = d.groupBy("category").agg(davg(F.when(F.col("discount_percent") > 0, F.col("revenue"))).alias("a"), davg(F.when(F.col("discount_percent") == 0, F.col("revenue"))).alias("b"))
    return g.select("category", F.coalesce(half_even(ratio(F.col("a"), F.col("b")), 4), F.lit(0.0)).alias("effectiveness_ratio"))


def regional_performance(df: DataFrame) -> DataFrame:
    """A row per region; orders are rows here."""
    d = with_revenue(df).dropna(subset=["region", "revenue"])
    g = d.groupBy("region").agg(
        half_even(dsum("revenue")).alias("total_revenue"), F.sum("quantity").alias("total_quantity"), F.count(F.lit(1)).alias("total_orders"), F.count_distinct("customer_email").alias("unique_customers"),
        half_even(davg("revenue")).alias("avg_order_value"), half_even(davg("quantity")).alias("avg_items_per_order"), half_even(davg("unit_price")).alias("avg_unit_price"), half_even(davg("discount_percent"), 4).alias("avg_discount_rate"),
    )
    cats = d.filter("category IS NOT NULL").groupBy("region", "category").agg(dsum("revenue").alias("r")).groupBy("region").agg(
        F.min_by("category", F.struct(-F.col("r"), "category")).alias("top_category"), half_even(F.max("r")).alias("top_category_revenue"), F.count(F.lit(1)).alias("category_diversity_count"),
    )
    months = d.filter("sale_date IS NOT NULL").groupBy("region", F.date_format("sale_date", "yyyy-MM").alias("month")).agg(dsum("revenue").alias("r"))
    was = F.lag("r").over(Window.partitionBy("region").orderBy("month"))
    months = months.withColumn("g", ratio(F.col("r") - was, was)).groupBy("region").agg(
        half_even(davg("r")).alias("avg_monthly_revenue"), half_even(F.stddev_samp("r")).alias("monthly_revenue_volatility"), half_even(F.avg("g"), 4).alias("avg_monthly_growth_rate"),
    )
    everything = Window.partitionBy()  # of regions
    return g.join(cats, "region", "left").join(months, "region", "left").withColumns({
        "efficiency_score": half_even(F.col("avg_order_value") * (1 - F.col("avg_discount_rate"))),
        "avg_customer_lifetime_value": half_even(ratio(F.col("total_revenue"), F.col("unique_customers"))),
        "avg_orders_per_customer": half_even(ratio(F.col("total_orders"), F.col("unique_customers"))),
        "top_category_share": half_even(ratio(F.col("top_category_revenue"), F.col("total_revenue")), 4),
        "market_share": half_even(ratio(F.col("total_revenue"), F.sum(F.col("total_revenue").cast("decimal(20,6)")).over(everything)), 4),
        "performance_index": half_even(ratio(F.col("avg_order_value"), F.sum(F.col("avg_order_value").cast("decimal(20,6)")).over(everything)) * F.count(F.lit(1)).over(everything), 4),
    })
