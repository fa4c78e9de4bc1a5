import json

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import anomalies, dashboards, field_rules, operations, reports, validation
from quarrymill.operators.validation import Rule
from quarrymill.plans import tracking
from quarrymill.sources import files, generate, outputs


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_broken_rule_fails_alone(spark):
    df = spark.createDataFrame([(1,), (None,)], "x int")

    def raises(c):
        raise ValueError("no")

    rules = (Rule("fine", "x", "error", lambda c: c.isNotNull(), kind="not_null"), Rule("raises", "x", "critical", raises), Rule("elsewhere", "x", "warning", lambda c: F.col("y") > c))
    got = {r.rule_name: (r.valid_records, r.passed) for r in validation.validate(df, rules).collect()}
    assert got == {"fine": (1, False), "raises": (0, False), "elsewhere": (0, False)}
    assert rows_of(validation.error_distribution(validation.validate(df, rules), rules)) == [("custom_critical", 1), ("custom_warning", 1), ("not_null_error", 1)]


def test_problematic_values(spark):
    df = spark.createDataFrame([(v,) for v in ["a", "b", "b", None, "ok", "c", "c", "c"]], "category string")
    rules = (Rule("r", "category", "error", validation.one_of(["ok"])), Rule("n", "category", "error", lambda c: c.isNotNull()), Rule("u", "category", "error", "unique"))
    assert rows_of(validation.problematic_values(df, rules, 2)) == [("n", None, 1, 1), ("r", "b", 2, 2), ("r", "c", 3, 1)]
    assert validation.problematic_values(df.limit(0), rules).isEmpty()


def test_history(spark):
    schema = "rule_name string, field string, severity string, error_rate double, passed boolean, timestamp timestamp_ntz"
    at = [F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")]
    h = spark.createDataFrame([("a", "f", "error", 50.0, False, None), ("b", "g", "error", 0.0, True, None), ("c", "f", "warning", 10.0, False, None)], schema).withColumn("timestamp", F.when(F.col("rule_name") == "c", at[1]).otherwise(at[0]))
    got = {(r["by"], r.key): (r.total, r.failed, r.avg_error_rate, r.success_rate) for r in validation.history_summary(h).collect()}
    assert got[("all", "all")] == (3, 2, 20.0, 33.3333) and got[("field", "f")] == (2, 2, 30.0, 0.0) and got[("severity", "error")] == (2, 1, 25.0, 50.0)
    assert {k[1] for k in got} == {"all", "f", "g", "error", "warning"}
    assert [r.rule_name for r in validation.recent_failures(h).collect()] == ["a", "c"]
    assert rows_of(validation.history_summary(h.limit(0)).select("by", "total", "avg_error_rate")) in ([], [("all", 0, None)])


def test_anomaly_report(spark):
    d = anomalies.fraud(anomalies.detect(generate.anomalous(spark, 500)), anomalies.PRESETS["high"])
    r = reports.detailed_report(d)
    shares = {x.flag: (x.records, x.percentage) for x in r["shares"].collect()}
    assert set(shares) == {f"{m}_anomaly_{k}" for m in anomalies.MEASURES for k in ("zscore", "iqr")} | {"fraud_flag"}
    n = d.filter("revenue_anomaly_iqr").count()
    assert shares["revenue_anomaly_iqr"] == (n, pytest.approx(n / 5, abs=1e-4))
    score = lambda x: sum(x[f"{m}_anomaly_score"] or 0.0 for m in anomalies.MEASURES)
    want = sorted(((-round(score(x), 6), x.order_id) for x in d.collect()))[:5]
    assert [(x.total_anomaly_score, x.order_id) for x in r["top"].collect()] == [(pytest.approx(-s, abs=2e-6), i) for s, i in want]
    one = {(x.method): (x.lower, x.upper) for x in anomalies.thresholds(d, "revenue").collect()}
    assert {x.method: (x.lower, x.upper) for x in r["thresholds"].filter("name = 'revenue'").collect()} == one
    assert r["reasons"].columns == ["reason", "n"]
    assert reports.flag_shares(d.select("order_id")).isEmpty() and reports.top_scored(d.limit(0)).isEmpty()


def test_advice(spark):
    report = "total_records long, total_anomalies long, revenue_zscore long, revenue_iqr long, quantity_zscore long, quantity_iqr long, discount_zscore long, discount_iqr long"
    advice = lambda *row: [r.advice for r in reports.detection_advice(spark.createDataFrame([row], report)).collect()]
    assert advice(100, 6, 1, 0, 0, 0, 0, 2) == ["many_anomalies", "review_revenue", "review_discount"]
    assert advice(100, 5, 0, 0, 0, 0, 0, 0) == ["none"] and advice(0, 0, 0, 0, 0, 0, 0, 0) == ["few_anomalies"]
    shares = spark.createDataFrame([("a", 1, 15.0), ("b", 1, 6.0)], "flag string, records long, percentage double")
    reasons = spark.createDataFrame([("Suspicious email pattern", 3), ("other", 1)], "reason string, n long")
    assert rows_of(reports.share_advice(shares, reasons)) == [("Suspicious email pattern", "verify_emails"), ("analysis", "lower_sensitivity")]
    df = spark.createDataFrame([("a", None), ("a", 1), ("c", -1)], "order_id string, quantity int")
    got = rows_of(reports.field_advice(field_rules.field_quality(df), field_rules.row_quality(df), 2))
    assert got == [("all", "make_ids_unique"), ("all", "validate_on_entry"), ("quantity", "require_or_default"), ("quantity", "review_collection")]
    errors = spark.createDataFrame([("range_error", 2), ("custom_error", 1)], "error_type string, rules long")
    assert rows_of(reports.error_advice(errors)) == [("range_error", "review_bounds")]


def test_validated_rows(spark):
    rows, fields, quality = reports.validated(generate.clean(spark, 50))
    assert rows.filter("revenue < 0 OR is_duplicate").isEmpty() and quality.first().valid_records == 50 and fields.count() == 9


def test_files_are_inspected(spark, tmp_path):
    def file(name, data):
        (tmp_path / name).write_bytes(data)
        return f"file://{tmp_path}/{name}"

    fine = files.inspect(spark, file("a.csv", "id;name\n1;é\n2;b\n".encode()))
    assert (fine["fine"], fine["encoding"], fine["delimiter"], fine["columns"]) == (True, "utf-8", ";", ["id", "name"])
    assert files.inspect(spark, file("b.csv", "id,name\n1,é\n2,b\n".encode("latin-1")))["encoding"] == "cp1252"
    assert files.detect_encoding("aé".encode()[:-1]) == "utf-8" and files.detect_encoding("aé".encode()[:-1], whole=True) == "cp1252"
    assert files.detect_encoding(b"\x81") == "latin-1"
    for name, data in (("c.csv", b""), ("d.csv", b"\n1,2\n"), ("e.parquet", b"x")):
        assert not files.inspect(spark, file(name, data))["fine"]
    assert not files.inspect(spark, f"file://{tmp_path}/none.csv")["fine"] and not files.check_file(spark, f"file://{tmp_path}/none.csv")[0]
    many = file("f.csv", b"id\n" + b"123456789\n" * 50000)
    assert files.estimated_rows(spark, many) == (50000, True)
    n, exact = files.estimated_rows(spark, many, exact_up_to=10)
    assert not exact and abs(n - 50000) < 500
    df, stats = files.timed_ingestion(spark, file("g.csv", b"a,b\n1,2\n3,4,5\n6,7\n"))
    assert df.columns == ["a", "b"] and (stats["rows"], stats["dropped"]) == (2, 1) and stats["rows_per_second"] > 0
    assert files.ingestion_stats(0, 0, 0.0)["success_rate"] == 100.0


def test_outputs_are_found(spark, tmp_path):
    base = f"file://{tmp_path}"
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,), (3,)], "x int")
    assert outputs.load_newest(spark, f"{base}/analytical_t_*.csv") is None
    files.export(a, base, "analytical_t", stamp="1")
    files.export(b, base, "fixed", ("parquet", "odd"), stamp="")
    files.export(b, base, "processed", ("parquet",), stamp="1")
    assert files.export(a.limit(0), base, "none", skip_empty=True) == {} and files.metadata(b)["digest"] == files.metadata(b.repartition(3))["digest"] != files.metadata(a)["digest"]
    got = outputs.resolve(spark, base, ("t", "fixed", "made", "gone"), lambda rows: {"made": rows.filter("x = 3")}, f"{base}/processed_*.parquet")
    assert {n: s.rsplit("/", 1)[-1] for n, (s, _) in got.items()} == {"t": "analytical_t_1.csv", "fixed": "fixed.parquet", "made": "derived", "gone": "missing"}
    assert got["t"][1].first().x == 1 and got["made"][1].count() == 1 and got["gone"][1] is None
    assert outputs.validation_report(spark, base) == {}
    for name, value in (("validation_report_1", {"a": 1, "b": 1}), ("validation_debug_report_1", {"b": 2}), ("validation_debug_report_2", {"b": 3})):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    assert outputs.validation_report(spark, base) == {"a": 1, "b": 3}


def test_persistence_and_fresh(spark, tmp_path):
    p = outputs.Persistence(spark, f"file://{tmp_path}")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    out = p.export_dataset(df, "t")
    assert out["consistent"] == {"csv": True, "parquet": True} and files.consistent(p.versions.latest("t"), df)
    assert p.status()["versions"]["entries"] == 1 and p.lineage.consumed_by(out["version"]).count() == 1
    now, made = [0.0], []
    f = outputs.Fresh(300.0, lambda: now[0])
    make = lambda: made.append(1) or len(made)
    assert (f.get("k", make), f.get("k", make), f.age("z")) == (1, 1, None)
    now[0] = 301.0
    assert f.age("k") == 301.0 and f.get("k", make) == 2
    f.refresh()
    assert f.get("k", make) == 3


def test_tracking(spark):
    now = iter(range(100))
    t = tracking.Tracker(lambda: next(now))
    with t.track("a") as facts:
        facts["records"] = 10
    with pytest.raises(ValueError), t.track("b"):
        raise ValueError("x")
    s = operations.processing_summary(t.table(spark)).first()
    assert (s.total_operations, s.completed_operations, s.total_records_processed, s.average_throughput) == (2, 1, 10, 10.0)
    assert t.stats() == {"operations": 2, "records": 10, "errors": ["ValueError: x"], "success_rate": 0.5}
    t.reset()
    assert t.stats()["success_rate"] == 0.0

    def helps(error, context):
        return context["x"]

    def fails(error, context):
        raise KeyError

    r = tracking.Recovery()
    r.add("io", fails)
    r.add("io", helps)
    assert r.handle(OSError(), "io", {"x": 5}) == 5 and r.handle(OSError(), "other") is None
    with pytest.raises(OSError):
        r.handle(OSError(), "other", critical=True)
    assert rows_of(operations.recovery_summary(r.table(spark)).select("action", "successes")) == [("fails", 0), ("helps", 1)]
    timings = tracking.rule_timings(spark.createDataFrame([("a",)], "order_id string"))
    assert timings.count() == 2 and dashboards.slowest_rules(timings, 1).count() == 1
    assert tracking.benchmark(lambda: spark.range(3), 1)["runs"] == 1
