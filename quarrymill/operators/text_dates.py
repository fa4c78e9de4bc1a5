"""Dates in text columns: ways of reading compete over the whole column, and the one that reads most judges it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cleaning import read_date as _read, shape  # noqa: F401  shape() is found here too
from ..functions.written import written

# Words for a missing date, and what each way reads, earlier formats first.
NO_DATE = ("unknown", "n/a", "null", "none", "")
GENERAL = "general"
WAYS = {
    GENERAL: ("yyyy-M-d", "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m:s'Z'", "yyyy/M/d", "yyyyMMdd", "M/d/yyyy", "M/d/yyyy H:m:s", "M-d-yyyy", "MMM d, yyyy"),
    "%Y-%m-%d": ("yyyy-M-d",),
    "%m/%d/%Y": ("M/d/yyyy",),
    "%d/%m/%Y": ("d/M/yyyy",),
    "%Y%m%d": ("yyyyMMdd",),
    "%Y-%m-%d %H:%M:%S": ("yyyy-M-d H:m:s",),
    "day_first": ("yyyy-M-d", "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m:s'Z'", "yyyy/M/d", "yyyyMMdd", "d/M/yyyy", "d/M/yyyy H:m:s", "d-M-yyyy", "d.M.yyyy", "d MMM yyyy"),
}
#: Of what isn't null, the share that the general way must read to be taken without a contest.
ENOUGH = 0.5


def parsed(c: Column, way: str) -> Column:
    return F.coalesce(*(_read(F.trim(c), f) for f in WAYS[way]))


def _reads(i: int) -> str:
    return f"reads_{i}"


def counts(c: Column, prefix: str = "") -> list[Column]:
    """Aggregates: values that aren't null, words for a missing date, and what each way reads."""
    out = [F.count(c).alias(f"{prefix}non_null"), F.count_if(F.lower(F.trim(c)).isin(*NO_DATE)).alias(f"{prefix}no_date_words")]
    return out + [F.count(parsed(c, way)).alias(prefix + _reads(i)) for i, way in enumerate(WAYS)]


def best(prefix: str = "") -> Column:
    """The way to take, from counts(): the general one if it reads enough, else the one that reads most, the first of
    equal ones. Nothing to read goes to the general one."""
    n = [F.col(prefix + _reads(i)) for i in range(len(WAYS))]
    most = F.array_max(F.array(*(F.struct(x.alias("n"), F.lit(-i).alias("i")) for i, x in enumerate(n))))
    ways = F.array(*map(F.lit, WAYS))
    return F.when(n[0] >= F.col(f"{prefix}non_null") * ENOUGH, F.lit(GENERAL)).otherwise(F.element_at(ways, 1 - most["i"]))


def read_by(c: Column, way: Column) -> Column:
    """The value as the way reads it; only that way is tried."""
    out = F.when(way == GENERAL, parsed(c, GENERAL))
    for name in WAYS:
        out = out if name == GENERAL else out.when(way == name, parsed(c, name))
    return out


def in_range(c: Column, at: Column, low: str | None, high: str | None) -> Column:
    """Nulls are fine, what can't be read isn't; bounds are dates, the last one counting as a whole day."""
    fine = at.isNotNull()
    for bound, inside in ((low, lambda: at.cast("date") >= F.lit(low).cast("date")), (high, lambda: at.cast("date") <= F.lit(high).cast("date"))):
        fine = fine & inside() if bound else fine
    return c.isNull() | F.coalesce(fine, F.lit(False))


def date_report(df: DataFrame, column: str, low: str | None = None, high: str | None = None) -> DataFrame:
    """One row on a text column: way, total, non_null, no_date_words, general_reads, reads (of the way taken), unreadable,
    out_of_range (read, but not within low and high), valid (nulls too), earliest, latest. Two passes, whatever the size; the first, which finds the way, is run at once."""
    c = F.col(f"`{column}`")
    choice = written(df.agg(*counts(c)).select(best().alias("way"), F.col("non_null"), F.col("no_date_words"), F.col(_reads(0)).alias("general_reads")), "way")
    rows = df.select(c.alias("c")).crossJoin(F.broadcast(choice))  # one row
    rows = rows.withColumn("at", read_by(F.col("c"), F.col("way")))
    fine = in_range(F.col("c"), F.col("at"), low, high)
    out = rows.agg(
        F.count(F.lit(1)).alias("total"), F.count("at").alias("reads"), F.count_if(F.col("c").isNotNull() & F.col("at").isNull()).alias("unreadable"), F.count_if(F.col("at").isNotNull() & ~fine).alias("out_of_range"),
        F.count_if(fine).alias("valid"), F.min("at").alias("earliest"), F.max("at").alias("latest"),
    )
    return choice.crossJoin(out)
