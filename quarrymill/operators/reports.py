"""Reports over rows that detect(), fraud() or the validation have marked: shares, best-scored rows and advice.

Advice is (subject, advice): a code for each bound that a figure passes, so that readers may word it as they like.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, NumericType

from ..functions.cleaning import with_revenue
from ..functions.numeric import half_even
from .anomalies import PRESETS, Sensitivity, reason_counts, thresholds_of
from .field_rules import field_quality, row_quality
from .validation import duplicate_order_ids


def _flags(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, BooleanType) and ("anomaly" in f.name or f.name == "fraud_flag")]


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(half_even(F.try_divide(part * F.lit(100.0), whole.cast("double")), 4), F.lit(0.0))


def flag_shares(df: DataFrame) -> DataFrame:
    """(flag, records, percentage): how many rows each anomaly or fraud flag marks; null marks nothing."""
    flags = _flags(df)
    if not flags:
        return df.sparkSession.createDataFrame([], "flag string, records bigint, percentage double")
    one = df.agg(F.count(F.lit(1)).alias("_n"), *(F.count_if(F.col(f"`{f}`")).alias(f) for f in flags))
    return one.select("_n", F.explode(F.array(*(F.struct(F.lit(f).alias("flag"), F.col(f"`{f}`").alias("records")) for f in flags))).alias("f")).select("f.flag", "f.records", _share(F.col("f.records"), F.col("_n")).alias("percentage"))


def top_scored(df: DataFrame, n: int = 5, order=("order_id",), keep=("order_id", "revenue", "quantity", "unit_price", "discount_percent")) -> DataFrame:
    """The n rows of the highest sum over *_score columns named for anomalies, with the names of their flags. Null scores
    are 0. order breaks ties."""
    scores = [c for c in df.columns if c.endswith("_score") and "anomaly" in c]
    total = half_even(sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in scores), F.lit(0.0)), 6)
    names = F.concat_ws(", ", *(F.when(F.col(f), f) for f in _flags(df)))
    kept = [c for c in dict.fromkeys((*order, *keep)) if c in df.columns]
    return df.select(*kept, total.alias("total_anomaly_score"), names.alias("anomaly_types")).orderBy(F.col("total_anomaly_score").desc(), *order).limit(n)


def numeric_thresholds(df: DataFrame, sensitivity: Sensitivity = PRESETS["medium"]) -> DataFrame:
    """thresholds_of() all numeric columns but flags and scores."""
    return thresholds_of(df, [f.name for f in df.schema if isinstance(f.dataType, NumericType) and not f.name.endswith(("_anomaly", "_score"))], sensitivity)


def detailed_report(df: DataFrame, reasons: str = "fraud_reasons", n: int = 5, order=("order_id",), sensitivity: Sensitivity = PRESETS["medium"]) -> dict[str, DataFrame]:
    """The parts of the report as tables, each computed when it is read."""
    out = {"shares": flag_shares(df), "thresholds": numeric_thresholds(df, sensitivity), "top": top_scored(df, n, order)}
    return out | ({"reasons": reason_counts(df, reasons)} if reasons in df.columns else {})


def _advice(df: DataFrame, subject: Column, *tests: tuple[Column, str]) -> DataFrame:
    codes = F.array_compact(F.array(*(F.when(t, c) for t, c in tests)))
    return df.select(subject.alias("subject"), F.explode(codes).alias("advice"))


def detection_advice(report: DataFrame) -> DataFrame:
    """Of anomalies.report(): over 5 % or under 0.1 % of rows marked, and each measure that marks any; else "none"."""
    rate = F.coalesce(F.try_divide(F.col("total_anomalies").cast("double"), F.col("total_records").cast("double")), F.lit(0.0))
    some = lambda m: (F.col(f"{m}_zscore") + F.col(f"{m}_iqr")) > 0
    tests = [(rate > 0.05, "many_anomalies"), (rate < 0.001, "few_anomalies"), *((some(m), f"review_{m}") for m in ("revenue", "quantity", "discount"))]
    none = ~(rate > 0.05) & ~(rate < 0.001) & ~some("revenue") & ~some("quantity") & ~some("discount")
    return _advice(report, F.lit("detection"), *tests, (none, "none"))


def share_advice(shares: DataFrame, reasons: DataFrame | None = None) -> DataFrame:
    """Of flag_shares(): flags together over 20 % or under 1 % of rows; of reason_counts(): the patterns that call for a review."""
    total = shares.agg(F.coalesce(F.sum("percentage"), F.lit(0.0)).alias("p"))
    out = _advice(total, F.lit("analysis"), (F.col("p") > 20, "lower_sensitivity"), (F.col("p") < 1, "raise_sensitivity"))
    # The reasons that have advice of their own.
    known = {"High quantity + High discount": "review_bulk_prices", "High price + Extreme discount": "approve_large_discounts", "Suspicious email pattern": "verify_emails"}
    if reasons is not None:
        out = out.unionByName(_advice(reasons, F.col("reason"), *((F.col("reason") == r, c) for r, c in known.items())))
    return out


def field_advice(fields: DataFrame, rows: DataFrame, duplicates: Column | int = 0) -> DataFrame:
    """Of field_quality() and row_quality(): a score under 90 %, fields under 80 % valid or over 20 % null, duplicates."""
    share = lambda c: F.try_divide(F.col(c).cast("double"), F.col("total_values").cast("double"))
    whole = _advice(rows, F.lit("all"), (F.col("quality_score") < 0.9, "validate_on_entry"), (F.lit(duplicates) > 0, "make_ids_unique"))
    return whole.unionByName(_advice(fields, F.col("field"), (share("valid_values") < 0.8, "review_collection"), (share("null_values") > 0.2, "require_or_default")))


def cleaning_advice(report: DataFrame, issues: DataFrame) -> DataFrame:
    """Of cleaning.report() and cleaning.issues(): fields with over 10 % errors, over 100 values that can't be read or over
    20 % corrections; "all", "none" where there is nothing to say."""
    rates = _advice(report, F.col("field"), (F.col("error_rate") > 10, "improve_collection"), (F.col("correction_rate") > 20, "review_entry_guidelines"))
    unread = _advice(issues.filter("issue = 'conversion_error'"), F.col("field"), (F.col("n") > 100, "review_formats"))
    found = rates.unionByName(unread)
    nothing = found.agg(F.count(F.lit(1)).alias("n"))  # one row
    return found.unionByName(_advice(nothing, F.lit("all"), (F.col("n") == 0, "none")))


def error_advice(distribution: DataFrame) -> DataFrame:
    """Of validation.error_distribution(): what to look at, by error type."""
    # Error types that have advice.
    known = {"enum_warning": "extend_allowed_values", "range_error": "review_bounds", "format_warning": "standardise_formats", "not_null_critical": "fill_missing_values"}
    return _advice(distribution, F.col("error_type"), *((F.col("error_type") == t, c) for t, c in known.items()))


def validated(df: DataFrame, rules=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with is_duplicate and a revenue computed anew, their field_quality() and their row_quality()."""
    rows = with_revenue(duplicate_order_ids(df), strict=True)
    return rows, field_quality(rows, rules), row_quality(rows, rules)
