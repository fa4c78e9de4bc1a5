"""Rule validation: a registry of column predicates, checked in one aggregate."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.written import written
from . import text_dates

log = logging.getLogger(__name__)

# Fixed values of the default rules.
CATEGORY_VALUES = ["Electronics", "Fashion", "Home & Garden", "Unknown"]
REGION_VALUES = ["North", "South", "East", "West", "Northeast", "Northwest", "Southeast", "Southwest", "Unknown"]
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
Z_LIMIT = 3.0
THRESHOLDS = {"info": 1.0, "warning": 5.0, "error": 10.0, "critical": 20.0}


@dataclass(frozen=True)
class DateRange:
    """Dates from low to high, days included. A text column is read as a whole: see text_dates."""

    low: str | None = None
    high: str | None = None


@dataclass(frozen=True)
class Rule:
    """valid: from the column to a predicate, true where the value is fine; a DateRange, "unique" and "zscore" are built in.
    kind: what error distributions call the rule."""

    name: str
    field: str
    severity: str
    valid: Callable[[Column], Column] | DateRange | str
    enabled: bool = True
    kind: str = "custom"


def in_range(low, high):
    return lambda c: F.coalesce(c.try_cast("double").between(low, high), F.lit(False))


def one_of(values):
    return lambda c: c.isNull() | c.isin(values)


DEFAULT_RULES = (
    Rule("order_id_not_null", "order_id", "critical", lambda c: c.isNotNull(), kind="not_null"),
    Rule("order_id_unique", "order_id", "error", "unique", kind="unique"),
    Rule("product_name_not_null", "product_name", "error", lambda c: c.isNotNull(), kind="not_null"),
    Rule("product_name_length", "product_name", "warning", lambda c: c.isNull() | F.length(c).between(1, 200), kind="range"),
    Rule("category_enum", "category", "warning", one_of(CATEGORY_VALUES), kind="enum"),
    Rule("quantity_positive", "quantity", "error", in_range(1, 10000), kind="range"),
    Rule("quantity_statistical", "quantity", "warning", "zscore", kind="statistical"),
    Rule("unit_price_positive", "unit_price", "error", in_range(0.01, 100000), kind="range"),
    Rule("discount_range", "discount_percent", "error", in_range(0, 1), kind="range"),
    Rule("region_enum", "region", "warning", one_of(REGION_VALUES), kind="enum"),
    Rule("email_format", "customer_email", "warning", lambda c: c.isNull() | c.rlike(EMAIL), kind="format"),
    Rule("sale_date_range", "sale_date", "error", DateRange("2020-01-01", "2030-12-31"), kind="range"),
    Rule("revenue_calculation", "revenue", "error", lambda c: c.isNull() | F.coalesce(c.try_cast("double") > 0, F.lit(False)), kind="business_logic"),
)


class Rules:
    """Rules by name, which may be added, switched on and off, and picked."""

    def __init__(self, rules: Iterable[Rule] = DEFAULT_RULES):
        self.by_name = {r.name: r for r in rules}

    def register(self, name: str, field: str, valid, severity: str = "error", kind: str = "custom") -> Rule:
        """Adds a rule, in place of one of the same name. An unknown severity raises."""
        if severity not in THRESHOLDS:
            raise ValueError(f"unknown severity: {severity}")
        self.by_name[name] = Rule(name, field, severity, valid, kind=kind)
        return self.by_name[name]

    def switch(self, enabled: bool, *names: str) -> None:
        """On or off; unknown names raise KeyError, and none is switched."""
        self.by_name |= {n: replace(self.by_name[n], enabled=enabled) for n in names}

    def remove(self, *names: str) -> None:
        for n in names:
            self.by_name.pop(n, None)

    def pick(self, *names: str) -> tuple[Rule, ...]:
        """The named rules, all by default; unknown names are warned of and left out."""
        for n in names:
            if n not in self.by_name:
                log.warning("unknown rule: %s", n)
        return tuple(self.by_name[n] for n in names if n in self.by_name) if names else tuple(self.by_name.values())


def _used(df: DataFrame, rules: Iterable[Rule]) -> list[Rule]:
    return [r for r in rules if r.enabled and r.field in df.columns]


def _prepared(df: DataFrame, used: list[Rule], once: bool = False) -> DataFrame:
    """df beside one row of what built-in rules must know of whole columns: mean and deviation, and how dates are read.
    once: the row is computed now, for all that read it."""
    kinds, facts, ways = dict(df.dtypes), [], {}
    for c in dict.fromkeys(r.field for r in used if r.valid == "zscore"):
        x = F.col(f"`{c}`").try_cast("double")
        facts += [F.avg(x).alias(f"_m_{c}"), F.stddev_samp(x).alias(f"_s_{c}")]
    for c in dict.fromkeys(r.field for r in used if isinstance(r.valid, DateRange) and kinds[r.field] == "string"):
        facts += text_dates.counts(F.col(f"`{c}`"), f"_d_{c}_")
        ways[f"_way_{c}"] = text_dates.best(f"_d_{c}_")
    if not facts:
        return df
    one = df.agg(*facts).withColumns(ways)
    one = one.drop(*(c for c in one.columns if c.startswith("_d_")))
    return df.crossJoin(F.broadcast(written(one, "facts") if once else one))  # one row


def _predicate(d: DataFrame, r: Rule) -> Column:
    """True where the value is fine; d is of _prepared()."""
    c, kind = F.col(f"`{r.field}`"), dict(d.dtypes)[r.field]
    if r.valid == "zscore":
        x, m, s = c.try_cast("double"), F.col(f"`_m_{r.field}`"), F.col(f"`_s_{r.field}`")
        return x.isNull() | F.coalesce(s <= 0, F.lit(True)) | (F.abs(x - m) / F.when(s > 0, s) <= Z_LIMIT)
    if isinstance(r.valid, DateRange):
        if kind == "string":
            at = text_dates.read_by(c, F.col(f"`_way_{r.field}`"))
        else:
            at = c if kind.startswith(("date", "timestamp")) else F.lit(None).cast("timestamp")  # a number is no date
        return text_dates.in_range(c, at, r.valid.low, r.valid.high)
    return r.valid(c)


def _valid_count(d: DataFrame, r: Rule) -> Column:
    if r.valid == "unique":
        c = F.col(f"`{r.field}`")
        return F.count_distinct(c) + F.max(c.isNull().cast("long"))
    return F.count_if(_predicate(d, r))


def _planned(d: DataFrame, used: list[Rule]) -> tuple[dict[str, Column], dict[str, str]]:
    """By rule, counts that can be analysed, and what is wrong with the others."""
    columns, errors = {}, {}
    for r in used:
        try:
            column = _valid_count(d, r).alias(r.name)
        except Exception as e:  # a user's rule may raise anything
            errors[r.name] = f"{type(e).__name__}: {e}"
            continue
        try:
            d.agg(column)  # analysed, not run
            columns[r.name] = column
        except AnalysisException as e:
            errors[r.name] = f"AnalysisException: {e}"
    return columns, errors


def _results(one: DataFrame, used: list[Rule], errors: dict[str, str]) -> DataFrame:
    """one: a row of n and the counts of the rules without errors."""
    count = lambda r: F.lit(0) if r.name in errors else F.coalesce(F.col(f"`{r.name}`"), F.lit(0))
    schema = "array<struct<rule_name: string, field: string, severity: string, limit: double, valid_records: bigint, error: string>>"
    rows = F.array(*(F.struct(F.lit(r.name).alias("rule_name"), F.lit(r.field).alias("field"), F.lit(r.severity).alias("severity"), F.lit(THRESHOLDS[r.severity]).alias("limit"), count(r).cast("long").alias("valid_records"), F.lit(errors.get(r.name)).cast("string").alias("error")) for r in used)).cast(schema)
    rate = F.rint(F.try_divide((F.col("n") - F.col("r.valid_records")).cast("double"), F.col("n").cast("double")) * 1e6) / 1e4
    return one.select("n", F.explode(rows).alias("r")).select(
        "r.rule_name", "r.field", "r.severity", F.col("n").alias("total_records"), "r.valid_records", F.coalesce(rate, F.lit(0.0)).alias("error_rate"), (F.coalesce(rate, F.lit(0.0)) <= F.col("r.limit")).alias("passed"), "r.error"
    )


def validate(df: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES) -> DataFrame:
    """A row per rule: rule_name, field, severity, total_records, valid_records, error_rate, passed. Rules that are off
    or whose field is missing are skipped. A rule that can't be planned (it raises, or names a column that isn't there)
    counts every record as invalid; the others aren't touched. The result is lazy, so a rule that fails on some row fails
    the query: validate_isolated() runs the rules and finds it. The default rules fail on no row.
    """
    used = _used(df, rules)
    d = _prepared(df, used)
    columns, errors = _planned(d, used)
    return _results(d.agg(F.count(F.lit(1)).alias("n"), *columns.values()), used, errors).drop("error")


def _kept(df: DataFrame, used: list[Rule]) -> DataFrame:
    """df written once: the rules' fields, or all columns if rules read others. df as it is if a column can't be computed,
    as then only the rules that read it fail, or if rules are bound to df itself."""
    wrong = _planned(_prepared(df, used), used)[1].keys()
    for d in (df.select(*(f"`{c}`" for c in dict.fromkeys(r.field for r in used))), df):
        bare = df.sparkSession.createDataFrame([], d.schema)  # for analysis
        if _planned(_prepared(bare, used), used)[1].keys() == wrong:
            try:
                return written(d, "rules")
            except (PySparkException, Py4JJavaError) as e:
                log.warning("rules run on rows that can't be written: %s", str(e)[:500])
                return df
    return df


def validate_isolated(df: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES) -> DataFrame:
    """validate(), run at once, with a column error: null, or why the rule couldn't be planned or failed on some row. Such
    a rule alone counts every record as invalid.

    The columns that the rules read are written once, and all passes read them. Rules are one aggregate, those on unique
    values another, as it shuffles by value. Where one fails, its rules are halved until those that fail are found; halves
    that don't fail give their counts. So k such rules of n cost at most 2 k log2 n passes more, over the written columns.
    An error of the rows themselves, without any rule, is raised.
    """
    used, total = _used(df, rules), None
    rows = _kept(df, used)
    d = _prepared(rows, used, once=True)
    columns, errors = _planned(d, used)
    unique = [r.name for r in used if r.valid == "unique" and r.name in columns]
    found, todo = {}, [x for x in (unique, [name for name in columns if name not in unique]) if x] or [[]]
    while todo:
        some = todo.pop()
        try:
            row = d.agg(F.count(F.lit(1)).alias("n"), *(columns[name] for name in some)).first()
        except (PySparkException, Py4JJavaError) as e:
            if total is None:
                total = rows.count()  # raises if the rows can't be read at all
            if len(some) == 1:
                errors[some[0]] = f"{type(e).__name__}: {e}"[:500]
            elif some:
                todo += [some[len(some) // 2 :], some[: len(some) // 2]]
            continue
        total = row["n"]
        found |= {name: row[i + 1] for i, name in enumerate(some)}
    names = [r.name for r in used if r.name in found]
    one = df.sparkSession.createDataFrame([(total, *(found[n] for n in names))], ", ".join(["n bigint", *(f"`{n}` bigint" for n in names)]))
    return _results(one, used, errors)


def status(results: DataFrame) -> DataFrame:
    """One row: the worst severity among failed rules, and the quality score."""
    rank = {"critical": 3, "error": 2, "warning": 1, "info": 1}
    worst = F.max(F.when(~F.col("passed"), F.try_element_at(F.create_map(*(F.lit(x) for kv in rank.items() for x in kv)), F.col("severity"))).otherwise(0))
    name = F.element_at(F.array(*map(F.lit, ("passed", "warning", "error", "critical"))), worst + 1)
    return results.agg(F.when(F.max("total_records") > 0, name).otherwise("skipped").alias("status"), F.count_if(~F.col("passed")).alias("failed_rules"), (F.rint(F.try_divide(F.sum("valid_records").cast("double"), F.sum("total_records").cast("double")) * 1e4) / 100).alias("quality_score"))


def by_field(results: DataFrame) -> DataFrame:
    return results.groupBy("field").agg(F.count(F.lit(1)).alias("rules"), F.max("error_rate").alias("worst_error_rate"), (F.rint(F.avg("error_rate") * 1e4) / 1e4).alias("avg_error_rate"))


def duplicate_order_ids(df: DataFrame) -> DataFrame:
    """Adds is_duplicate: every copy, nulls alike. Counts are joined back, so a common id needs no window."""
    n = df.groupBy("order_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").withColumnRenamed("order_id", "_id")
    return df.join(n, F.col("order_id").eqNullSafe(F.col("_id")), "left").withColumn("is_duplicate", F.col("_n").isNotNull()).drop("_n", "_id")


def first_failures(df: DataFrame, rule: Rule, n: int = 10) -> DataFrame:
    """Up to n distinct values that fail a predicate rule."""
    d = _prepared(df, [rule])
    return d.filter(~F.coalesce(_predicate(d, rule), F.lit(False))).select(F.col(f"`{rule.field}`").alias("value")).distinct().orderBy("value").limit(n)


def problematic_values(df: DataFrame, rules=DEFAULT_RULES, n: int = 10) -> DataFrame:
    """(rule_name, value, records, place): by predicate rule, the n most frequent values that fail it; ties by value, null
    being one. Values are counted before they are ranked, and ranks are cut in each task first."""
    used = [r for r in _used(df, rules) if not isinstance(r.valid, str)]
    d = _prepared(df, used)
    _, errors = _planned(d, used)  # rules that can't be planned have no values
    sound = [r for r in used if r.name not in errors]
    wrong = [F.when(~F.coalesce(_predicate(d, r), F.lit(False)), F.struct(F.lit(r.name).alias("rule_name"), F.col(f"`{r.field}`").cast("string").alias("value"))) for r in sound]
    failed = F.array_compact(F.array(*wrong)) if wrong else F.array().cast("array<struct<rule_name: string, value: string>>")
    counts = d.select(F.explode(failed).alias("f")).groupBy("f.rule_name", "f.value").agg(F.count(F.lit(1)).alias("records"))
    place = F.row_number().over(Window.partitionBy("rule_name").orderBy(F.col("records").desc(), F.col("value").asc_nulls_first()))
    return counts.withColumn("place", place).filter(F.col("place") <= n)


def error_distribution(results: DataFrame, rules=DEFAULT_RULES) -> DataFrame:
    """(error_type, rules): failed rules by kind and severity, as kind_severity. Unknown rules are custom."""
    kinds = F.create_map(*(F.lit(x) for r in rules for x in (r.name, r.kind)))
    kind = F.coalesce(F.try_element_at(kinds, F.col("rule_name")), F.lit("custom"))
    return results.filter(~F.col("passed")).groupBy(F.concat_ws("_", kind, "severity").alias("error_type")).agg(F.count(F.lit(1)).alias("rules"))


def error_report(results: DataFrame, problems: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES) -> DataFrame:
    """(rule_name, field, severity, error_type, failed_records, error_rate, values): a row per failed rule; values are
    those of problematic_values(), the most frequent first, null as null, and empty where there are none."""
    kinds = F.create_map(*(F.lit(x) for r in rules for x in (r.name, r.kind)))
    kind = F.coalesce(F.try_element_at(kinds, F.col("rule_name")), F.lit("custom"))
    values = problems.groupBy("rule_name").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "value", "records"))), lambda x: F.struct(x["value"].alias("value"), x["records"].alias("records"))).alias("values"))  # as many as were asked for
    failed = results.filter(~F.col("passed")).join(values, "rule_name", "left")
    none = F.array().cast("array<struct<value: string, records: bigint>>")
    return failed.select("rule_name", "field", "severity", F.concat_ws("_", kind, "severity").alias("error_type"), (F.col("total_records") - F.col("valid_records")).alias("failed_records"), "error_rate", F.coalesce("values", none).alias("values"))


def history_summary(history: DataFrame) -> DataFrame:
    """Of results of many runs, a row for all ("all"), each severity and each field: total, passed, failed, avg_error_rate,
    success_rate in %. Each mean is of its own group. operations.recent() picks the last hours."""
    severity, field = F.grouping("severity") == 0, F.grouping("field") == 0
    g = history.groupingSets([(), ("severity",), ("field",)], "severity", "field")
    mean = F.try_divide(F.sum(F.col("error_rate").cast("decimal(20,6)")).cast("double"), F.count("error_rate").cast("double"))
    out = g.agg(
        F.when(severity, "severity").when(field, "field").otherwise("all").alias("by"), F.coalesce(F.when(severity, F.col("severity")), F.when(field, F.col("field")), F.lit("all")).alias("key"), F.count(F.lit(1)).alias("total"),
        F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), (F.rint(mean * 1e4) / 1e4).alias("avg_error_rate"), (F.rint(F.try_divide(F.count_if("passed") * F.lit(100.0), F.count(F.lit(1)).cast("double")) * 1e4) / 1e4).alias("success_rate"),
    )
    return out.drop("severity", "field")


def recent_failures(history: DataFrame, n: int = 10) -> DataFrame:
    """The last n failed results by timestamp, ties by rule name."""
    return history.filter(~F.col("passed")).orderBy(F.col("timestamp").desc(), "rule_name").limit(n)
