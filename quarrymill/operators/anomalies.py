"""Anomalies by z-score, interquartile range and fraud patterns. All statistics come from counts of values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.cleaning import with_revenue
from ..functions.numeric import half_even
from ..functions.quantiles import moments, quantiles, value_counts
from ..functions.written import written

MEASURES = {"revenue": "revenue", "quantity": "quantity", "discount": "discount_percent"}


@dataclass(frozen=True)
class Sensitivity:
    z: float = 3.0
    iqr: float = 1.5
    percentile: float = 0.95
    fraud_score: float = 2.0
    contamination: float = 0.1


# The three sensitivities.
PRESETS = {"low": Sensitivity(3.5, 2.0, 0.99, 3.0, 0.05), "medium": Sensitivity(), "high": Sensitivity(2.5, 1.2, 0.90, 1.0, 0.15)}


def _valid(measure: str) -> Column:
    """The measure as a double; null where it doesn't count. NaN is larger than any number."""
    x = F.col(MEASURES[measure]).cast("double")
    return F.when({"revenue": F.abs(x) < float("inf"), "quantity": (x > 0) & (x < float("inf")), "discount": x.between(0, 1)}[measure], x)


def _stats(df: DataFrame, measures) -> dict:
    """(mean, std, (lower quartile, upper quartile)) by measure; measures without values have none."""
    counts = written(value_counts(df, **{m: _valid(m) for m in measures}), "counts")
    rows = moments(counts).join(quantiles(counts, (0.25, 0.75)).drop("total"), "name")  # a row per measure
    return {r["name"]: (r["mean"], r["std"], r["q"]) for r in rows.select("name", "mean", "std", "q").collect()}


def detect(df: DataFrame, measures=tuple(MEASURES), z: float = 3.0, k: float = 1.5) -> DataFrame:
    """Adds <measure>_anomaly_zscore, _iqr, _score and _reason. The statistics are computed at once, so that bounds are
    constants in what is done to each row."""
    d = with_revenue(df)
    stats, out = _stats(d, measures), {}
    for m in measures:
        if m not in stats:
            out |= {f"{m}_anomaly_zscore": F.lit(False), f"{m}_anomaly_iqr": F.lit(False), f"{m}_anomaly_score": F.lit(0.0), f"{m}_anomaly_reason": F.lit("No valid data")}
            continue
        x, (mean, std, q) = _valid(m), stats[m]
        lo, hi = q[0] - k * (q[1] - q[0]), q[1] + k * (q[1] - q[0])
        score = F.coalesce(F.abs(x - mean) / std, F.lit(0.0)) if std else F.lit(0.0)
        far = score > z
        above, below = F.coalesce(x > hi, F.lit(False)), F.coalesce(x < lo, F.lit(False))
        iqr = above if m == "quantity" else above | below
        single = F.when(above, "Unusually High Discount").when(below, "Unusually Low Discount") if m == "discount" else F.when(iqr, "IQR Outlier")
        reason = F.when(far & iqr, "Z-score + IQR Outlier").otherwise(F.coalesce(single, F.when(far, "High Z-score"), F.lit("Normal")))
        out |= {f"{m}_anomaly_zscore": far, f"{m}_anomaly_iqr": iqr, f"{m}_anomaly_score": score, f"{m}_anomaly_reason": reason}
    return d.select("*", *(c.alias(n) for n, c in out.items()))


def top_records(df: DataFrame, n: int = 5, order=("order_id",)) -> DataFrame:
    """Rows with any flag of detect(), by the sum of their scores. order breaks ties."""
    any_flag = [F.col(f"{m}_anomaly_zscore") | F.col(f"{m}_anomaly_iqr") for m in MEASURES]
    total = sum((F.col(f"{m}_anomaly_score") for m in MEASURES), F.lit(0.0))
    label = lambda m: m.capitalize()
    best = df.filter(any_flag[0] | any_flag[1] | any_flag[2]).withColumns({
        "composite_anomaly_score": half_even(total, 6),
        "anomaly_types": F.concat_ws(", ", *(F.when(f, label(m)) for f, m in zip(any_flag, MEASURES, strict=True))),
        "detailed_anomaly_reason": F.concat_ws("; ", *(F.when(F.col(f"{m}_anomaly_reason") != "Normal", F.concat(F.lit(f"{label(m)}: "), F.col(f"{m}_anomaly_reason"))) for m in MEASURES)),
    }).orderBy(F.col("composite_anomaly_score").desc(), *order).limit(n)
    return best.withColumn("anomaly_rank", F.row_number().over(Window.orderBy(F.col("composite_anomaly_score").desc(), *order)))  # over n rows


def report(df: DataFrame) -> DataFrame:
    """One row of counts over detect()'s flags."""
    flags = {f"{m}_{k}": F.col(f"{m}_anomaly_{k}") for m in MEASURES for k in ("zscore", "iqr")}
    any_flag = None
    for f in flags.values():
        any_flag = f if any_flag is None else any_flag | f
    return df.agg(F.count(F.lit(1)).alias("total_records"), F.count_if(any_flag).alias("total_anomalies"), *(F.count_if(f).alias(n) for n, f in flags.items()))


def thresholds_of(df: DataFrame, columns, sensitivity: Sensitivity = PRESETS["medium"]) -> DataFrame:
    """(name, method, lower, upper) of numeric columns, counted in one pass; null and infinite values don't count. A
    column without values has no rows."""
    finite = {c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")) for c in columns}
    counts = written(value_counts(df, **finite), "counts")
    p = sensitivity.percentile
    q = quantiles(counts, (0.25, 0.5, 0.75, (1 - p) / 2, p + (1 - p) / 2)).select("name", "q")
    s = moments(counts).join(q, "name").select("name", F.col("mean").alias("m"), F.col("std").alias("sd"), "q")
    far = counts.join(q, "name").groupBy("name", F.abs(F.col("x") - F.col("q")[1]).alias("x")).agg(F.sum("n").alias("n"))
    mad = quantiles(far, (0.5,)).select("name", F.col("q")[0].alias("mad"))
    q, sd, k = F.col("q"), F.coalesce("sd", F.lit(0.0)), sensitivity.iqr
    wide = 3.5 * 1.4826 * F.col("mad")
    rows = [("zscore", F.col("m") - sensitivity.z * sd, F.col("m") + sensitivity.z * sd), ("iqr", q[0] - k * (q[2] - q[0]), q[2] + k * (q[2] - q[0])), ("percentile", q[3], q[4]), ("modified_zscore", q[1] - wide, q[1] + wide)]
    out = s.join(mad, "name").select("name", "mad", F.explode(F.array(*(F.struct(F.lit(n).alias("method"), a.alias("lower"), b.alias("upper")) for n, a, b in rows))).alias("r"))
    return out.filter((F.col("r.method") != "modified_zscore") | (F.col("mad") > 0)).select("name", "r.*")


def thresholds(df: DataFrame, column: str, sensitivity: Sensitivity = PRESETS["medium"]) -> DataFrame:
    """(method, lower, upper) of a column."""
    return thresholds_of(df, (column,), sensitivity).drop("name")


def fraud(df: DataFrame, sensitivity: Sensitivity = PRESETS["medium"]) -> DataFrame:
    """Adds fraud_score, fraud_reasons and fraud_flag."""
    d = with_revenue(df)
    has = lambda c, otherwise: F.coalesce(F.col(c), F.lit(otherwise)) if c in df.columns else F.lit(otherwise)
    q, p, disc, rev = has("quantity", 0), has("unit_price", 0.0), has("discount_percent", 0.0), F.coalesce(F.col("revenue"), F.lit(0.0))
    mail, name = has("customer_email", ""), F.lower(F.replace(has("product_name", ""), F.lit(" "), F.lit("")))
    local = F.substring_index(mail, "@", 1)
    tests = [
        ("High quantity + High discount", 2.0, (q > 100) & (disc > 0.5)), ("High price + Extreme discount", 3.0, (p > 10000) & (disc > 0.7)), ("Low price + High quantity", 1.5, (p < 1) & (q > 50)),
        ("Weekend high-value sale", 1.0, (F.weekday("sale_date") >= 5) & (rev > 50000) if "sale_date" in df.columns else F.lit(False)),
        ("Suspicious email pattern", 0.5, (mail != "") & (F.lower(mail).rlike(r"([a-z])\1\1") | (F.length(mail) - F.length(F.replace(mail, F.lit("."), F.lit(""))) > 3) | (F.length(local) < 3))),
        ("Round number combination", 0.8, (q % 10 == 0) & (p % 100 == 0) & (q > 10) & (p > 100)),
        ("Extreme unit price", 1.2, (p > 100000) & F.lit("region" in df.columns and "category" in df.columns)),
        ("Suspicious product name pattern", 0.3, (F.size(F.array_distinct(F.split(name, ""))) < 5) & (F.length(name) > 10)),
    ]
    score = sum((F.when(t, s).otherwise(0.0) for _, s, t in tests), F.lit(0.0))
    return d.withColumns({"fraud_score": half_even(score, 1), "fraud_reasons": F.concat_ws("; ", *(F.when(t, n) for n, _, t in tests)), "fraud_flag": half_even(score, 1) >= sensitivity.fraud_score})


def reason_counts(df: DataFrame, column: str) -> DataFrame:
    """(reason, n) of a column of reasons joined by '; '."""
    return df.select(F.explode(F.split(column, "; ")).alias("reason")).filter("reason <> ''").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def without_outliers(df: DataFrame, column: str, z: float = 3.0) -> DataFrame:
    """Rows under z standard deviations from the mean; all rows if the column is constant, none that are null."""
    x = F.col(column).cast("double")
    d = df.crossJoin(F.broadcast(df.agg(F.avg(x).alias("_mean"), F.stddev_samp(x).alias("_std"))))  # one row
    return d.filter(F.coalesce(F.try_divide(F.abs(x - F.col("_mean")), F.col("_std")), F.when(x.isNotNull(), 0.0)) < z).select(*df.columns)
