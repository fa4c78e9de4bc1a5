"""Field cleaning as column expressions: text standards, numbers, dates, e-mails. Nothing drops a row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# Canonical names with the spellings they stand for.
CATEGORIES = {
    "Electronics": ["electronics", "electronic", "elec", "tech", "technology"],
    "Fashion": ["fashion", "clothing", "apparel", "clothes", "wear"],
    "Home Goods": ["home", "home goods", "homegoods", "home_goods", "household", "furniture", "decor", "home decor"],
    "Beauty": ["beauty", "cosmetics", "skincare", "makeup"],
    "Sports": ["sports", "sport", "fitness", "outdoor"],
    "Books": ["books", "book", "literature", "reading"],
}
REGIONS = {
    "North": ["north", "nort", "northern", "n"],
    "South": ["south", "sout", "southern", "s"],
    "East": ["east", "eastern", "e"],
    "West": ["west", "western", "w"],
    "Central": ["central", "centre", "center", "c"],
    "Southeast": ["southeast", "south east", "south-east", "se"],
    "Northeast": ["northeast", "north east", "north-east", "ne"],
    "Northwest": ["northwest", "north west", "north-west", "nw"],
    "Southwest": ["southwest", "south west", "south-west", "sw"],
}
# Words that names write small, and date formats, the first that fits being taken.
STOP_WORDS = [("And", "&"), ("With", "w/"), ("For", "for"), ("The", "the"), ("Of", "of"), ("In", "in"), ("On", "on"), ("At", "at"), ("By", "by"), ("To", "to")]
DATE_FORMATS = ["yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "M-d-yyyy", "yyyy/M/d", "d.M.yyyy", "yyyy-M-d H:m:s", "d/M/yyyy H:m:s", "M/d/yyyy H:m:s", "yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m:s'Z'", "MMM d, yyyy"]
#: What a part of a format can read at most: a parse that fails costs many times a look at the text. Spark's parser raises
#: on years that its timestamps don't have, from 294248 on, so years from 294247 on aren't tried.
_PARTS = {
    "yyyy": "[+-]?(?=[0-9]{4})0*([0-9]{1,5}|1[0-9]{5}|2[0-8][0-9]{4}|29[0-3][0-9]{3}|294[01][0-9]{2}|2942[0-3][0-9]|29424[0-6])", "MMM": "[^0-9]+", "MM": "(0[1-9]|1[0-2])", "M": "0*([1-9]|1[0-2])", "dd": "(0[1-9]|[12][0-9]|3[01])", "d": "0*([1-9]|[12][0-9]|3[01])",
    "H": "[0-9]+", "m": "[0-9]+", "s": "[0-9]+", "'T'": "[Tt]", "'Z'": "[Zz]",
}
EMAIL = r"^[a-z0-9_%+-]+(\.[a-z0-9_%+-]+)*@[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,}$"


def _lookup(table: dict[str, list[str]], key: Column) -> Column:
    pairs = [F.lit(x) for name, keys in table.items() for k in keys for x in (k, name)]
    return F.try_element_at(F.create_map(*pairs), key)


def _missing(c: Column) -> Column:
    return c.isNull() | (c == "")


def _spaced(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def product_name(c: Column) -> Column:
    t = F.regexp_replace(_spaced(c), r"(?U)[^\w\s\-().,&]", "")
    t = F.regexp_replace(t, r"(?U)\s+", " ")
    words = F.transform(F.split(t, " "), lambda w: F.array_join(F.transform(F.split(w, "(?<=[-_])|(?=[-_])"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30)))), ""))
    t = F.array_join(words, " ")
    for a, b in STOP_WORDS:
        t = F.replace(t, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.when(_missing(c), F.lit("Unknown Product")).otherwise(F.trim(t))


def category(c: Column) -> Column:
    t = F.regexp_replace(_spaced(F.lower(c)), r"(?U)[^\w\s]", "")
    title = F.initcap(F.regexp_replace(F.trim(F.translate(t, "_", " ")), " +", " "))
    return F.when(_missing(c), F.lit("Other")).otherwise(F.coalesce(_lookup(CATEGORIES, t), title))


def region(c: Column) -> Column:
    t = F.regexp_replace(_spaced(F.lower(c)), r"(?U)[^\w\s\-]", "")
    return F.when(_missing(c), F.lit("Unknown")).otherwise(F.coalesce(_lookup(REGIONS, t), F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30))))


def shape(form: str) -> str:
    """A pattern that every text has which the format reads, and few others."""
    return "^" + "".join(_PARTS.get(x) or re.escape(x) for x in re.findall(r"yyyy|M+|d+|'.'|.", form)) + "$"


def read_date(text: Column, form: str) -> Column:
    """Null if the format doesn't fit; it is tried only on texts of its shape."""
    return F.when(text.rlike(shape(form)), F.try_to_timestamp(text, F.lit(form)))


def sale_date(c: Column) -> Column:
    """The first format that fits; day-first before month-first."""
    return F.coalesce(*(read_date(F.trim(c), f) for f in DATE_FORMATS))


def _number(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), "[^0-9.+-]", "").try_cast("double")


def quantity(c: Column) -> Column:
    x = _number(c)
    return F.when(x > 10000, 10000).when(x >= 1, F.floor(F.least(x, F.lit(10000.0)))).otherwise(1).cast("int")


def discount(c: Column) -> Column:
    x = _number(c)
    return F.when(x.isNull() | (x < 0), 0.0).when(x > 100, 1.0).when(x > 1, x / 100).otherwise(x)


def unit_price(c: Column) -> Column:
    x = _number(c)
    return F.when(x > 1e6, 1e6).when(x > 0, x).otherwise(0.01)


def email(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.rlike(EMAIL), t)


def quantity_issue(c: Column) -> Column:
    x = _number(c)
    return F.when(_missing(c.cast("string")), None).when(x.isNull(), "conversion_error").when(F.floor(x) <= 0, "non_positive").when(x > 10000, "capped_high")


def discount_issue(c: Column) -> Column:
    x = _number(c)
    return F.when(_missing(c.cast("string")), None).when(x.isNull(), "conversion_error").when(x < 0, "negative_value").when(x > 100, "over_100_percent").when(x > 1, "converted_from_percentage")


def price_issue(c: Column) -> Column:
    x = _number(c)
    return F.when(c.isNull(), "null_value").when(c.cast("string") == "", "empty_value").when(x.isNull(), "conversion_error").when(x <= 0, "non_positive").when(x > 1e6, "capped_high")


def email_issue(c: Column) -> Column:
    return F.when(_missing(c), None).when(~(c.contains("@") & c.contains(".")), "invalid_format").when(email(c).isNull(), "validation_failed")


CLEANERS = {"product_name": product_name, "category": category, "region": region, "sale_date": sale_date, "quantity": quantity, "discount_percent": discount, "customer_email": email, "unit_price": unit_price}
ISSUES = {"quantity": quantity_issue, "discount_percent": discount_issue, "customer_email": email_issue, "unit_price": price_issue}


def clean(df: DataFrame) -> DataFrame:
    """Cleans the columns that exist, in one projection."""
    return df.withColumns({c: f(F.col(c)) for c, f in CLEANERS.items() if c in df.columns})


def typed(df: DataFrame) -> DataFrame:
    """Text columns of numbers and dates as such, what can't be read being null; no cleaning. For rows that skip clean()."""
    kinds = {"quantity": lambda c: F.floor(c.try_cast("double")).try_cast("int"), "unit_price": lambda c: c.try_cast("double"), "discount_percent": lambda c: c.try_cast("double"), "sale_date": sale_date}
    return df.withColumns({c: f(F.col(c)) for c, f in kinds.items() if dict(df.dtypes).get(c) == "string"})


def issues(df: DataFrame) -> DataFrame:
    """(field, issue, n): what cleaning would correct, in one pass."""
    some = {c: f for c, f in ISSUES.items() if c in df.columns}
    tagged = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), f(F.col(c)).alias("issue")) for c, f in some.items()))).alias("x"))
    return tagged.filter("x.issue IS NOT NULL").groupBy("x.field", "x.issue").agg(F.count(F.lit(1)).alias("n"))


# Issues that only correct a value, and what stands in for nulls where cleaning failed.
CORRECTIONS = ("capped_high", "converted_from_percentage")
DEFAULTS = {"quantity": 0, "unit_price": 0.0, "discount_percent": 0.0, "category": "Unknown", "region": "Unknown", "product_name": "Unknown Product"}


def report(df: DataFrame) -> DataFrame:
    """A row per field with issues to count: total, errors, corrections, and both in %."""
    some = {c: f(F.col(c)) for c, f in ISSUES.items() if c in df.columns}
    counts = [F.count(F.lit(1)).alias("n")]
    for c, issue in some.items():
        counts += [F.count_if(issue.isNotNull() & ~issue.isin(*CORRECTIONS)).alias(f"e_{c}"), F.count_if(issue.isin(*CORRECTIONS)).alias(f"c_{c}")]
    rows = F.array(*(F.struct(F.lit(c).alias("field"), F.col("n").alias("total"), F.col(f"e_{c}").alias("errors"), F.col(f"c_{c}").alias("corrections")) for c in some))
    rate = lambda c: F.coalesce(F.rint(F.try_divide(F.col(c).cast("double"), F.col("total").cast("double")) * 100 * 1e4) / 1e4, F.lit(0.0))
    return df.agg(*counts).select(F.explode(rows).alias("x")).select("x.*").withColumns({"error_rate": rate("errors"), "correction_rate": rate("corrections")})


def with_defaults(df: DataFrame) -> DataFrame:
    """Nulls of known fields become their defaults."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.items() if c in df.columns})


def standardization_stats(df: DataFrame, column: str) -> DataFrame:
    """(unique_before, unique_after, nulls): of one text column."""
    after = CLEANERS[column](F.col(column))
    return df.agg(F.count_distinct(F.lower(column)).alias("unique_before"), F.count_distinct(after).alias("unique_after"), F.count_if(F.col(column).isNull()).alias("nulls"))


def standardization_report(df: DataFrame) -> DataFrame:
    """(field, unique_before, unique_after, reduction_ratio, nulls_before, nulls_after, parse_rate): of product names,
    categories, regions and dates, as far as they are there. Spellings that differ in case only count once before, but for
    names. parse_rate: the share of all rows with a value after cleaning. Rows are counted by value first, in one pass."""
    before = {c: F.lower(c) if c in ("category", "region") else F.col(c) for c in ("product_name", "category", "region", "sale_date") if c in df.columns}
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), x.cast("string").alias("a"), CLEANERS[c](F.col(c)).cast("string").alias("b")) for c, x in before.items()))
    values = df.select(F.explode(pairs).alias("p")).groupBy("p.field", "p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))
    own = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    g = values.groupBy("field").agg(F.count_distinct("a").alias("unique_before"), F.count_distinct("b").alias("unique_after"), own(F.col("a").isNull()).alias("nulls_before"), own(F.col("b").isNull()).alias("nulls_after"), F.sum("n").alias("n"))
    part = lambda a, b: F.coalesce(F.rint(F.try_divide(a.cast("double"), b.cast("double")) * 1e4) / 1e4, F.lit(0.0))
    b, a = F.col("unique_before"), F.col("unique_after")
    return g.select("field", b, a, part(b - a, b).alias("reduction_ratio"), "nulls_before", "nulls_after", part(F.col("n") - F.col("nulls_after"), F.col("n")).alias("parse_rate"))


def with_revenue(df: DataFrame, strict: bool = False) -> DataFrame:
    """quantity * unit_price * (1 - discount_percent), if revenue is missing; strict: always, and never below 0.

    A revenue that is there is kept; as text it is read as a number, null where it is none, and so are the other columns.
    """
    if "revenue" in df.columns and not strict:
        return df.withColumn("revenue", _number(F.col("revenue"))) if dict(df.dtypes)["revenue"] == "string" else df
    number = lambda c: F.col(c).try_cast("double") if dict(df.dtypes).get(c) == "string" else F.col(c)
    r = number("quantity") * number("unit_price") * (1 - number("discount_percent"))
    return df.withColumn("revenue", F.when(r.isNull() | F.isnan(r.cast("double")) | (r < 0), 0.0).otherwise(r) if strict else r)


def require(df: DataFrame, *columns: str) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
