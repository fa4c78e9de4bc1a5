import datetime
import json
import logging
import random
import uuid

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import cleaning
from quarrymill.operators import text_dates, validation
from quarrymill.operators.validation import DateRange, Rule, Rules
from quarrymill.sources import outputs


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "sale_date string")


def test_the_general_way_is_enough(spark):
    df = texts(spark, "2023-01-15", "01/02/2023", "13.02.2023", None, "Unknown", "2019-12-31", "20230203", " 2023-03-04T05:06:07Z ")
    r = text_dates.date_report(df, "sale_date", "2020-01-01", "2030-12-31").first()
    assert (r.way, r.total, r.non_null, r.no_date_words, r.general_reads, r.reads, r.unreadable, r.out_of_range, r.valid) == ("general", 8, 7, 1, 5, 5, 2, 1, 5)
    assert r.earliest == datetime.datetime(2019, 12, 31) and r.latest == datetime.datetime(2023, 3, 4, 5, 6, 7)


def test_the_way_that_reads_most(spark):
    way = lambda *v: text_dates.date_report(texts(spark, *v), "sale_date").first()
    r = way("15/01/2023", "16/01/2023", "17/01/2023", "03/04/2023")
    assert (r.way, r.reads, r.latest) == ("%d/%m/%Y", 4, datetime.datetime(2023, 4, 3))
    assert way("15/01/2023", "16.01.2023", "n/a", None).way == "day_first"
    r = way("x", "y", "2023-01-01")
    assert (r.way, r.reads, r.unreadable) == ("general", 1, 2)  # nothing reads more
    assert way().way == "general" and way(None).valid == 1


def test_date_rules_on_text_dates_and_numbers(spark):
    rule = Rule("d", "sale_date", "error", DateRange("2020-01-01", "2030-12-31"))
    valid = lambda df: validation.validate(df, (rule,)).first().valid_records
    assert valid(texts(spark, "25/01/2023", "26/01/2023", "27/01/2050", "no", None)) == 3
    assert valid(texts(spark, "2030-12-31").selectExpr("cast('2030-12-31 23:00:00' as timestamp) AS sale_date")) == 1
    assert valid(texts(spark, "1").selectExpr("20230101 AS sale_date")) == 0
    assert [(r.rule_name, r.value) for r in validation.problematic_values(texts(spark, "2023-01-01", "no"), (rule,)).collect()] == [("d", "no")]
    assert [r.value for r in validation.first_failures(texts(spark, "2023-01-01", "no"), rule).collect()] == ["no"]


def test_default_rules_fail_on_no_row(spark):
    dirty = spark.createDataFrame([("1", "", "x", "abc", "12,5", "-", "y", "13/13/2023", "z", "?")], "order_id string, product_name string, category string, quantity string, unit_price string, discount_percent string, region string, sale_date string, customer_email string, revenue string")
    got = {r.rule_name: r.valid_records for r in validation.validate(dirty).collect()}
    assert got["quantity_positive"] == got["sale_date_range"] == got["unit_price_positive"] == 0 and got["quantity_statistical"] == 1 and len(got) == 13
    d = cleaning.with_revenue(cleaning.typed(dirty.drop("revenue"))).first()
    assert d.quantity is None and d.sale_date is None and d.revenue is None
    assert cleaning.with_revenue(dirty.drop("revenue")).first().revenue is None


def test_rules_that_fail_at_run_time(spark):
    df = spark.createDataFrame([("1", 5), ("x", 0), (None, 2)], "s string, n int")
    runs = []

    def counted(rule):
        return Rule(rule.name, rule.field, rule.severity, lambda c: runs.append(1) or rule.valid(c))

    def raises(c):
        raise KeyError("no")

    fine = [Rule(f"fine{i}", "n", "error", lambda c, i=i: c > i) for i in range(9)]
    bad = [Rule("cast", "s", "critical", lambda c: c.cast("int") > 0), Rule("divide", "n", "warning", lambda c: 10 / c > 1), Rule("plan", "n", "error", raises), Rule("column", "n", "error", lambda c: c > F.col("elsewhere"))]
    got = {r.rule_name: r for r in validation.validate_isolated(df, [*fine[:4], *bad, *fine[4:], Rule("off", "n", "error", lambda c: c > 0, enabled=False), Rule("u", "s", "error", "unique")]).collect()}
    assert {n: r.valid_records for n, r in got.items()} == {f"fine{i}": sum(x > i for x in (5, 0, 2)) for i in range(9)} | {"cast": 0, "divide": 0, "plan": 0, "column": 0, "u": 3}
    assert {n for n, r in got.items() if r.error} == {"cast", "divide", "plan", "column"} and "CAST_INVALID_INPUT" in got["cast"].error and "DIVIDE_BY_ZERO" in got["divide"].error
    assert all(r.total_records == 3 for r in got.values()) and not got["cast"].passed
    assert {r.rule_name: r.valid_records for r in validation.validate_isolated(df.limit(0), fine).collect()} == {f.name: 0 for f in fine}
    assert validation.validate_isolated(df, []).isEmpty() and validation.validate(df, []).isEmpty()


def test_rows_that_cannot_be_read_raise(spark):
    broken = spark.createDataFrame([("x",)], "s string").select(F.col("s").cast("int").alias("n"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        validation.validate_isolated(broken.filter("n > 0"), [Rule("r", "n", "error", lambda c: c > 0)])


def test_rules_by_name(spark, caplog):
    rules = Rules([])
    rules.register("small", "n", lambda c: c < 3, "warning")
    rules.register("even", "n", lambda c: c % 2 == 0)
    df = spark.createDataFrame([(1,), (2,), (4,)], "n int")
    names = lambda *n: sorted(r.rule_name for r in validation.validate(df, rules.pick(*n)).collect())
    assert names() == ["even", "small"] and names("even") == ["even"]
    with caplog.at_level(logging.WARNING):
        assert names("even", "odd") == ["even"] and "odd" in caplog.text
    rules.switch(False, "even")
    assert names() == ["small"]
    rules.switch(True, "even")
    rules.register("even", "n", lambda c: c > 100)
    assert {r.rule_name: r.valid_records for r in validation.validate(df, rules.pick()).collect()} == {"small": 2, "even": 0}
    rules.remove("even")
    assert names() == ["small"] and len(Rules().pick()) == 13
    for wrong in (lambda: rules.register("x", "n", lambda c: c > 0, "fatal"), lambda: rules.switch(True, "small", "none")):
        with pytest.raises((ValueError, KeyError)):
            wrong()


def test_reports_are_written_and_found(spark, tmp_path):
    df = spark.createDataFrame([(None, "a", 5), ("2", "b", 0), ("2", "b", 0)], "order_id string, category string, quantity int")
    rules = (*validation.DEFAULT_RULES, Rule("bad", "category", "error", lambda c: c.cast("int") > 0))
    paths = outputs.write_validation_reports(df, f"file://{tmp_path}", rules, stamp="1")
    assert json.loads((tmp_path / "validation_report_1.json").read_text())["status"] == "critical" and set(paths) == {"report", "errors", "debug"}
    got = outputs.validation_report(spark, f"file://{tmp_path}")
    assert {r["rule_name"]: r["valid_records"] for r in got["rules"]} == {"order_id_not_null": 2, "order_id_unique": 2, "category_enum": 0, "quantity_positive": 1, "quantity_statistical": 3, "bad": 0}
    errors = {e["rule_name"]: e for e in got["errors"]}
    assert errors["category_enum"]["values"] == [{"value": "b", "records": 2}, {"value": "a", "records": 1}] and errors["bad"]["values"] == [] and errors["bad"]["error_type"] == "custom_error"
    assert list(got["rule_errors"]) == ["bad"] and "revenue_calculation" in got["skipped_rules"] and got["schema"]["quantity"] == "int"
    assert {"subject": "enum_warning", "advice": "extend_allowed_values"} in got["advice"] and got["error_types"]["enum_warning"] == 1


def test_isolated_rules_read_their_rows_once(spark, tmp_path):
    """The rows are computed once however many rules fail, unless a column can't be computed or a rule needs df itself."""
    (tmp_path / "seen").mkdir()

    def noted(rows):
        for batch in rows:
            with open(tmp_path / "seen" / uuid.uuid4().hex, "w") as f:
                f.write(str(len(batch)))
            yield batch

    df = spark.range(1, 9, numPartitions=1).selectExpr("id AS n", "id % 2 AS m", "cast(id % 4 AS string) AS u", "'x' AS s").mapInPandas(noted, "n bigint, m bigint, u string, s string")
    bad = [Rule(f"bad{i}", "s", "error", lambda c, i=i: c.cast("int") > i) for i in range(3)]
    fine = [Rule("big", "n", "error", lambda c: c > 4), Rule("other", "n", "error", lambda c: c > F.col("m") * 7), Rule("u", "u", "error", "unique"), Rule("z", "n", "error", "zscore")]
    got = {r.rule_name: (r.valid_records, r.error is not None) for r in validation.validate_isolated(df, [bad[0], *fine, *bad[1:]]).collect()}
    assert got == {"big": (4, False), "other": (4, False), "u": (4, False), "z": (8, False)} | {f"bad{i}": (0, True) for i in range(3)}
    assert sum(int(p.read_text()) for p in (tmp_path / "seen").iterdir()) == 8
    broken = spark.createDataFrame([("1", 2), ("x", 3)], "s string, n int").select(F.col("s").cast("int").alias("i"), "n")
    rules = [Rule("i", "i", "error", lambda c: c > 0), Rule("big", "n", "error", lambda c: c > 2), Rule("own", "n", "error", lambda c: c > broken["n"] - 1)]
    assert {r.rule_name: (r.valid_records, r.error is not None) for r in validation.validate_isolated(broken, rules).collect()} == {"i": (0, True), "big": (1, False), "own": (2, False)}
    assert {r.rule_name: r.valid_records for r in validation.validate_isolated(broken, rules[1:]).collect()} == {"big": 1, "own": 2}


def test_shapes_reject_nothing_that_a_format_reads(spark):
    """Every format by Spark alone, and behind its shape, over texts that nearly fit; few texts that fail reach a parser."""
    r = random.Random(5)
    number = lambda: r.choice(["0", "00", "1", "01", "001", "2", "02", "9", "10", "12", "012", "13", "28", "29", "30", "31", "031", "32", "99", "-1", "+1", "2023", "+2023", "-2023", "02023", "12023", "+12023", "0000", "202", ""])
    months = ["Jan", "feb", "MAR", "May", "Sept", "Sep", "Jän", "1", "January", ""]
    texts_ = [f"{a}{s}{b}{s}{c}{z}" for a, s, b, c, z in ((number(), r.choice("-/. "), number(), number(), r.choice(["", "", " 1:2:3", "T01:02:03", "t1:2:3", " 24:00:00", " 1:2", " 23:59:60", "T1:2:3Z", "T1:2:3z", " ", "x", "\\n"])) for _ in range(6000))]
    texts_ += [f"{m} {number()}, {number()}" for m in months for _ in range(60)] + [f"{number()} {m} {number()}" for m in months for _ in range(60)] + [number() + number() for _ in range(500)] + ["20230228", "120230228", "+120230228", "20230230"] + ["2023-2-1 1:2:3", "2023-2-1T1:2:3", "2023-2-1t1:2:3z", "2/1/2023 1:2:3", "2023/2/1", "1.2.2023", "Feb 1, 2023", "1 feb 2023", "1-2-2023"] + [f"2023-{m}-{d}" for m in range(14) for d in range(33)]
    c, forms = F.trim("sale_date"), sorted({f for w in text_dates.WAYS.values() for f in w})
    df = texts(spark, *texts_).select("sale_date", *(F.try_to_timestamp(c, F.lit(f)).alias(f"a{i}") for i, f in enumerate(forms)), *(text_dates._read(c, f).alias(f"b{i}") for i, f in enumerate(forms)), *(c.rlike(text_dates.shape(f)).alias(f"s{i}") for i, f in enumerate(forms)))
    got = df.agg(*(F.count_if(~F.col(f"a{i}").eqNullSafe(F.col(f"b{i}"))).alias(f"x{i}") for i in range(len(forms))), *(F.count(f"a{i}").alias(f"n{i}") for i in range(len(forms)))).first()
    assert {f: got[f"x{i}"] for i, f in enumerate(forms)} == dict.fromkeys(forms, 0) and all(got[f"n{i}"] for i in range(len(forms)))
    usual = texts(spark, "25/01/2023", "25.01.2023", "n/a").select(*(c.rlike(text_dates.shape(f)).cast("int").alias(f) for f in forms))
    assert {f: sum(x[f] for x in usual.collect()) for f in forms if f in ("d/M/yyyy", "d.M.yyyy", "M/d/yyyy", "yyyy-M-d", "yyyyMMdd")} == {"d/M/yyyy": 1, "d.M.yyyy": 1, "M/d/yyyy": 0, "yyyy-M-d": 0, "yyyyMMdd": 0}
    assert text_dates.date_report(texts(spark, "9999999-01-01", "-300000-01-01", "999999990228", "2023-01-01"), "sale_date").first().reads == 1  # no such timestamps
