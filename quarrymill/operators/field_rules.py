"""Field-wise quality: type, length, pattern and range of each sales field, in one aggregate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

TYPES: dict[str, tuple[type[DataType], ...]] = {"text": (StringType,), "number": (NumericType,), "time": (TimestampType, TimestampNTZType, DateType)}


@dataclass(frozen=True)
class FieldRule:
    """low and high bound the length of texts and the value of numbers."""

    kind: str
    low: float | None = None
    high: float | None = None
    pattern: str | None = None
    required: bool = True


# Fixed values of the rules.
FIELD_RULES = {
    "order_id": FieldRule("text", 1, 100, r"^[A-Za-z0-9\-_]+$"),
    "product_name": FieldRule("text", 1, 500),
    "category": FieldRule("text", 1, 100),
    "quantity": FieldRule("number", 1, 10000),
    "unit_price": FieldRule("number", 0.01, 1e6),
    "discount_percent": FieldRule("number", 0.0, 1.0),
    "region": FieldRule("text", 1, 100),
    "sale_date": FieldRule("time"),
    "customer_email": FieldRule("text", pattern=r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$", required=False),
}


def valid(df: DataFrame, field: str, rule: FieldRule) -> Column:
    """True where a value is there and keeps the rule, else false. A column of another type keeps none."""
    c = F.col(field)
    if not isinstance(df.schema[field].dataType, TYPES[rule.kind]):
        return F.lit(False)
    x = F.length(c) if rule.kind == "text" else c
    ok = c.isNotNull()
    ok = ok & (x >= rule.low) if rule.low is not None else ok
    ok = ok & (x <= rule.high) if rule.high is not None else ok
    ok = ok & c.rlike(rule.pattern) if rule.pattern else ok
    return F.coalesce(ok, F.lit(False))


def _used(df: DataFrame, rules: dict[str, FieldRule]) -> dict[str, FieldRule]:
    return {f: r for f, r in rules.items() if f in df.columns}


def missing_fields(df: DataFrame, rules: dict[str, FieldRule] | None = None) -> list[str]:
    """Required fields that df doesn't have."""
    return [f for f, r in (rules or FIELD_RULES).items() if r.required and f not in df.columns]


def field_quality(df: DataFrame, rules: dict[str, FieldRule] | None = None) -> DataFrame:
    """A row per field: total, valid, null and invalid values. Nulls of optional fields are valid."""
    used = _used(df, rules or FIELD_RULES)
    some = [F.count(F.lit(1)).alias("n")]
    for f, r in used.items():
        some += [F.count_if(valid(df, f, r)).alias(f"ok_{f}"), F.count_if(F.col(f).isNull()).alias(f"null_{f}")]
    rows = [
        F.struct(F.lit(f).alias("field"), F.col("n").alias("total_values"), (F.col(f"ok_{f}") + (F.lit(0) if r.required else F.col(f"null_{f}"))).cast("long").alias("valid_values"),
                 F.col(f"null_{f}").alias("null_values"), (F.col("n") - F.col(f"null_{f}") - F.col(f"ok_{f}")).alias("invalid_values")) for f, r in used.items()
    ]
    return df.agg(*some).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def row_quality(df: DataFrame, rules: dict[str, FieldRule] | None = None) -> DataFrame:
    """One row: records, records whose fields are all valid, and the share of valid values.

    A null fails its row even in an optional field, where it counts as a valid value.
    """
    used = _used(df, rules or FIELD_RULES)
    every, values = F.lit(True), F.lit(0)
    for f, r in used.items():
        ok = valid(df, f, r)
        every = every & ok
        values = values + (ok if r.required else ok | F.col(f).isNull()).cast("int")
    share = F.try_divide(F.sum(values).cast("double"), (F.count(F.lit(1)) * len(used)).cast("double"))
    return df.agg(F.count(F.lit(1)).alias("total_records"), F.count_if(every).alias("valid_records"), (F.rint(F.coalesce(share, F.lit(0.0)) * 1e6) / 1e6).alias("quality_score"))


def findings(fields: DataFrame) -> DataFrame:
    """(field, finding) of field_quality(): validity under 95 %, nulls over 10 %."""
    share = lambda c: F.try_divide(F.col(c).cast("double"), F.col("total_values").cast("double"))
    low, empty = F.when(share("valid_values") < 0.95, "low validity"), F.when(share("null_values") > 0.1, "many nulls")
    return fields.select("field", F.explode(F.array_compact(F.array(low, empty))).alias("finding"))
