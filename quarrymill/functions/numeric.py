"""Numbers that come out alike wherever they are summed: decimal sums, half-even rounding, guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def half_even(c: Column, digits: int = 2) -> Column:
    return F.rint(c * 10.0**digits) / 10.0**digits


def dsum(c) -> Column:
    """Sum as a double, free of the order of rows: by decimals of six places."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(20,6)")).cast("double")


def davg(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.try_divide(dsum(c), F.count(c))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))
