"""Sales rows for tests: clean, dirty, anomalous and mixed. A row depends on its number and the seed only, so results are
the same at any partitioning and no row needs another one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Category weights; products with lowest price, highest price and weight; regions with weight and mean
# discount; discount factors by month; weights of quantities 1 to 10; dirty values.
CATEGORY_WEIGHTS = {"Electronics": 0.40, "Fashion": 0.35, "Home Goods": 0.25}
PRODUCTS = {
    "Electronics": [
        ("Laptop", 300, 2000, 0.15), ("Desktop Computer", 400, 3000, 0.08), ("Smartphone", 100, 1200, 0.20), ("Tablet", 150, 800, 0.12), ("Headphones", 20, 400, 0.15),
        ("Smart Watch", 100, 600, 0.10), ("Camera", 200, 2500, 0.08), ("Gaming Console", 300, 600, 0.05), ("Monitor", 150, 1000, 0.07),
    ],
    "Fashion": [
        ("T-Shirt", 10, 80, 0.20), ("Jeans", 30, 150, 0.15), ("Dress", 25, 200, 0.12), ("Shoes", 40, 300, 0.18), ("Jacket", 50, 250, 0.10),
        ("Handbag", 30, 400, 0.08), ("Watch", 25, 500, 0.07), ("Sunglasses", 15, 200, 0.05), ("Belt", 15, 100, 0.05),
    ],
    "Home Goods": [
        ("Coffee Maker", 30, 300, 0.12), ("Vacuum Cleaner", 80, 500, 0.10), ("Bed Sheets", 20, 150, 0.15), ("Kitchen Knife Set", 25, 200, 0.08), ("Lamp", 20, 150, 0.12),
        ("Pillow", 15, 80, 0.15), ("Cookware Set", 50, 300, 0.08), ("Towel Set", 20, 100, 0.10), ("Storage Box", 10, 60, 0.10),
    ],
}
REGIONS = {"North": (0.25, 0.12), "South": (0.30, 0.15), "East": (0.20, 0.10), "West": (0.25, 0.13)}
SEASON = [0.8, 0.9, 1.0, 1.1, 1.0, 1.2, 1.3, 1.1, 1.0, 1.1, 1.4, 1.5]
QUANTITY_WEIGHTS = [0.4, 0.25, 0.15, 0.08, 0.05, 0.03, 0.02, 0.01, 0.005, 0.005]
BAD_QUANTITIES = ["0", "-1", "-5", "invalid", "", None]
BAD_DISCOUNTS = ["1.5", "2.0", "-0.1", "invalid", "", None]
BAD_EMAILS = ["invalid-email", "user@", "@domain.com", "user.domain.com", "", None, "user@domain", "user name@domain.com"]
BAD_PRICES = ["0", "-10", "-100", "invalid", "", None]
BAD_DATES = ["2023/13/01", "2023-02-30", "invalid-date", "01-01-2023", "2023.01.01", "", None]
COLUMNS = ("order_id", "product_name", "category", "quantity", "unit_price", "discount_percent", "region", "sale_date", "customer_email", "revenue")


def _u(seed: int, purpose: str) -> Column:
    """Uniform in [0, 1), by row number, seed and purpose."""
    return F.shiftrightunsigned(F.xxhash64(F.col("id"), F.lit(seed), F.lit(purpose)), 11).cast("double") / 2.0**53


def _pick(u: Column, weighted: list[tuple]) -> Column:
    """The value whose share of the weights u falls in."""
    total, below, out = sum(w for _, w in weighted), 0.0, None
    for value, w in weighted[:-1]:
        below += w / total
        out = F.when(u < below, F.lit(value)) if out is None else out.when(u < below, F.lit(value))
    return out.otherwise(F.lit(weighted[-1][0]))


def _any(u: Column, values: list) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (F.floor(u * len(values)) + 1).cast("int"))


def _revenue() -> Column:
    return F.round(F.col("quantity") * F.col("unit_price") * (1 - F.col("discount_percent")), 2)


def _clean(spark: SparkSession, n: int, seed: int, start: str, days: int) -> DataFrame:
    u = lambda purpose: _u(seed, purpose)
    d = spark.range(n).withColumn("category", _pick(u("category"), list(CATEGORY_WEIGHTS.items())))
    product = lambda i, kind: F.coalesce(*(F.when(F.col("category") == c, _pick(u("product"), [(p[i], p[3]) for p in items]).cast(kind)) for c, items in PRODUCTS.items()))
    day = (-F.log1p(-u("day")) * (days / 4)).cast("int") % days
    d = d.withColumns({
        "product_name": product(0, "string"), "_low": product(1, "double"), "_high": product(2, "double"), "region": _pick(u("region"), [(r, w) for r, (w, _) in REGIONS.items()]),
        "sale_date": F.date_add(F.lit(start).cast("date"), day).cast("timestamp_ntz"), "quantity": _pick(u("quantity"), [(i + 1, w) for i, w in enumerate(QUANTITY_WEIGHTS)]),
    })
    mean = F.element_at(F.create_map(*(F.lit(x) for r, (_, m) in REGIONS.items() for x in (r, m))), F.col("region")) * F.element_at(F.array(*map(F.lit, SEASON)), F.month("sale_date"))
    normal = F.sqrt(-2 * F.log1p(-u("normal a"))) * F.cos(2 * F.pi() * u("normal b"))
    return d.withColumns({
        "order_id": F.format_string("ORD_%06d", "id"), "customer_email": F.format_string("customer_%06d@example.com", "id"),
        "unit_price": F.round(F.col("_low") + u("price") * (F.col("_high") - F.col("_low")), 2), "discount_percent": F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.5), mean + normal * 0.05)), 4),
    }).withColumn("revenue", _revenue())


def _own(ids: bool) -> tuple[str, ...]:
    return (*COLUMNS, "id") if ids else COLUMNS


def clean(spark: SparkSession, n: int, seed: int = 42, start: str = "2023-01-01", days: int = 364, ids: bool = False) -> DataFrame:
    """n valid rows, one order each; early days and small quantities are the most frequent. ids: with the rows' numbers, as
    of all generators."""
    return _clean(spark, n, seed, start, days).select(*_own(ids))


# Months with a season of their own; category weights and discounts in them.
HOLIDAYS, SUMMER = (11, 12), (6, 7, 8)
HOLIDAY_WEIGHTS, SUMMER_WEIGHTS, EVEN_WEIGHTS = {"Electronics": 0.5, "Fashion": 0.3, "Home Goods": 0.2}, {"Electronics": 0.3, "Fashion": 0.5, "Home Goods": 0.2}, {"Electronics": 1.0, "Fashion": 1.0, "Home Goods": 1.0}


def time_series(spark: SparkSession, n: int, seed: int = 42, start: str = "2023-01-01", days: int = 365, ids: bool = False) -> DataFrame:
    """n valid rows on evenly spread days, with seasons: in the holidays two to three times the quantity, more electronics and
    discounts of 0.1 to 0.4 (else up to 0.2); in summer more fashion."""
    u = lambda purpose: _u(seed, purpose)
    d = _clean(spark, n, seed, start, days).withColumn("sale_date", F.date_add(F.lit(start).cast("date"), F.floor(u("any day") * days).cast("int")).cast("timestamp_ntz"))
    month = F.month("sale_date")
    holidays, summer = month.isin(*HOLIDAYS), month.isin(*SUMMER)
    pick = lambda weights: _pick(u("season"), list(weights.items()))
    d = d.withColumn("category", F.when(holidays, pick(HOLIDAY_WEIGHTS)).when(summer, pick(SUMMER_WEIGHTS)).otherwise(pick(EVEN_WEIGHTS)))
    product = lambda i, kind: F.coalesce(*(F.when(F.col("category") == c, F.element_at(F.array(*(F.lit(p[i]) for p in items)), (F.floor(u("any product") * len(items)) + 1).cast("int")).cast(kind)) for c, items in PRODUCTS.items()))
    low, high = product(1, "double"), product(2, "double")
    few = (1 + F.floor(u("few") * 4)).cast("int")
    return d.withColumns({
        "product_name": product(0, "string"), "unit_price": F.round(low + u("price") * (high - low), 2), "quantity": F.when(holidays, few * (2 + F.floor(u("times") * 2)).cast("int")).otherwise(few),
        "discount_percent": F.round(F.when(holidays, 0.1 + 0.3 * u("off")).otherwise(0.2 * u("off")), 3),
    }).withColumn("revenue", _revenue()).select(*_own(ids))


def _as_text(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if c == "sale_date" and dict(df.dtypes)[c] != "string" else F.col(c).cast("string").alias(c) for c in COLUMNS), *more)


def scenarios(spark: SparkSession, counts: dict[str, int], seed: int = 42) -> DataFrame:
    """Rows of each scenario (clean, dirty, anomaly, time_series) as strings, with data_scenario, mixed by a hash of their
    numbers. Order ids are new, and unique. Unknown scenarios raise."""
    makers = {"clean": clean, "dirty": dirty, "anomaly": anomalous, "time_series": time_series}
    if unknown := counts.keys() - makers.keys():
        raise ValueError(f"unknown scenarios: {sorted(unknown)}")
    out, before = None, 0
    for name, n in counts.items():
        part = _as_text(makers[name](spark, n, seed, ids=True), (F.col("id") + before).alias("_number")).withColumn("data_scenario", F.lit(name))
        out, before = part if out is None else out.unionByName(part), before + n
    if out is None:
        return _as_text(clean(spark, 0)).withColumn("data_scenario", F.lit(None).cast("string"))
    return out.orderBy(F.xxhash64("_number", F.lit(seed))).withColumn("order_id", F.format_string("ORD_%08d", "_number")).drop("_number")


def dirty(spark: SparkSession, n: int, seed: int = 42, share: float = 0.3, empty: float = 0.02, ids: bool = False, **dates) -> DataFrame:
    """All columns as strings. A share of the rows has one spoiled field or its predecessor's order id; in some more, a field is null."""
    d = _clean(spark, n, seed, dates.get("start", "2023-01-01"), dates.get("days", 364))
    d = d.select("id", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if c == "sale_date" else F.col(c).cast("string").alias(c) for c in COLUMNS))
    u = lambda purpose: _u(seed, purpose)
    spoil = F.when(u("spoilt") < share, F.floor(u("how") * 9))
    which = u("value")
    spelling = lambda c: F.element_at(F.array(F.upper(c), F.lower(c), F.concat(F.lit("  "), F.col(c), F.lit(" ")), F.concat(F.col(c), F.lit("!"))), (F.floor(which * 4) + 1).cast("int"))
    changed = {
        "product_name": spelling("product_name"), "category": spelling("category"), "region": spelling("region"), "quantity": _any(which, BAD_QUANTITIES), "discount_percent": _any(which, BAD_DISCOUNTS),
        "customer_email": _any(which, BAD_EMAILS), "unit_price": _any(which, BAD_PRICES), "sale_date": _any(which, BAD_DATES), "order_id": F.format_string("ORD_%06d", F.greatest(F.col("id") - 1, F.lit(0))),
    }
    d = d.withColumns({c: F.when(spoil == i, x).otherwise(F.col(c)) for i, (c, x) in enumerate(changed.items())})
    gone = F.when(u("empty") < empty, F.floor(u("gone") * len(COLUMNS)))
    return d.select(*(F.when(F.coalesce(gone != i, F.lit(True)), F.col(c)).alias(c) for i, c in enumerate(COLUMNS)), *_own(ids)[len(COLUMNS):])


def anomalous(spark: SparkSession, n: int, seed: int = 42, share: float = 0.05, ids: bool = False, **dates) -> DataFrame:
    """Clean rows, a share of which have an extreme price, quantity or discount, a suspicious combination, or a price too low or too round."""
    d = _clean(spark, n, seed, dates.get("start", "2023-01-01"), dates.get("days", 364))
    u = lambda purpose: _u(seed, purpose)
    kind, v = F.when(u("odd") < share, F.floor(u("kind") * 5)), u("odd value")
    low = u("low or round") < 0.5
    return d.withColumns({
        "unit_price": F.round(F.when(kind == 0, F.col("unit_price") * (10 + 40 * v)).when(kind == 3, 1000 + 4000 * v).when((kind == 4) & low & (F.col("category") == "Electronics"), 0.01 + 0.99 * v)
                              .when((kind == 4) & ~low, F.element_at(F.array(*map(F.lit, (1000.0, 2000.0, 5000.0, 10000.0))), (F.floor(v * 4) + 1).cast("int"))).otherwise(F.col("unit_price")), 2),
        "quantity": F.when(kind == 1, F.element_at(F.array(*map(F.lit, (100, 500, 1000, 2000))), (F.floor(v * 4) + 1).cast("int"))).when(kind == 3, (50 + 150 * v).cast("int")).otherwise(F.col("quantity")),
        "discount_percent": F.when(kind == 2, F.element_at(F.array(*map(F.lit, (0.95, 0.99, 0.8, 0.9))), (F.floor(v * 4) + 1).cast("int"))).when(kind == 3, F.round(0.7 + 0.25 * v, 4)).otherwise(F.col("discount_percent")),
    }).withColumn("revenue", _revenue()).select(*_own(ids))


def mixed(spark: SparkSession, n: int, seed: int = 42, shares: tuple[float, float] = (0.70, 0.25), shuffled: bool = False) -> DataFrame:
    """Clean, dirty and anomalous rows (the rest), as strings, with data_scenario; shuffled: in an order by a hash."""
    a, b = int(n * shares[0]), int(n * shares[1])
    parts = {"clean": _as_text(clean(spark, a, seed)), "dirty": dirty(spark, b, seed + 1), "anomaly": _as_text(anomalous(spark, n - a - b, seed + 2))}
    out = None
    for name, part in parts.items():
        part = part.withColumn("data_scenario", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.orderBy(F.xxhash64(F.lit(seed), *out.columns)) if shuffled else out
