import json

from pyspark.sql import functions as F

from quarrymill.functions import cleaning
from quarrymill.operators import dashboards, field_rules, operations, tables, validation
from quarrymill.plans import pipeline
from quarrymill.sources import files, generate, store

SALES = "order_id string, product_name string, category string, quantity int, unit_price double, discount_percent double, region string, sale_date timestamp_ntz, customer_email string"


def test_clean_rows_are_valid_and_do_not_depend_on_partitions(spark):
    a, b = generate.clean(spark, 2000), generate.clean(spark, 2000).repartition(7)
    assert files.consistent(a, b)
    q = field_rules.row_quality(a).first()
    assert (q.total_records, q.valid_records, q.quality_score) == (2000, 2000, 1.0)
    shares = {r.category: r.n / 2000 for r in a.groupBy("category").agg(F.count("*").alias("n")).collect()}
    assert all(abs(shares[c] - w) < 0.05 for c, w in generate.CATEGORY_WEIGHTS.items())
    assert a.filter("unit_price < 10 OR unit_price > 3000 OR discount_percent NOT BETWEEN 0 AND 0.5").isEmpty()


def test_dirty_rows_come_out_clean(spark):
    d = generate.dirty(spark, 2000)
    assert not d.filter("customer_email IS NULL OR quantity IS NULL OR order_id IS NULL").isEmpty()
    assert d.select("order_id").distinct().count() < 2000
    q = {r.field: r.invalid_values for r in field_rules.field_quality(cleaning.clean(d)).collect()}
    assert q["quantity"] == q["unit_price"] == q["discount_percent"] == q["customer_email"] == 0
    assert {r.field for r in cleaning.report(d).filter("errors > 0").collect()} == {"quantity", "unit_price", "discount_percent", "customer_email"}


def test_anomalies_and_mixture(spark):
    assert dashboards.anomaly_records(generate.anomalous(spark, 2000)).count() > 5
    n = {r.data_scenario: r.n for r in generate.mixed(spark, 200).groupBy("data_scenario").agg(F.count("*").alias("n")).collect()}
    assert n == {"clean": 140, "dirty": 50, "anomaly": 10}


def test_empty_tables(spark):
    e = spark.createDataFrame([], SALES)
    assert dashboards.dashboard_regions(e).isEmpty() and dashboards.anomaly_records(e).isEmpty()
    k = dashboards.kpis(dashboards.dashboard_regions(e), tables.dashboard_products(e), dashboards.anomaly_records(e)).first()
    assert (k.total_regions, k.top_region, k.total_anomalies, k.avg_anomaly_score) == (0, "N/A", 0, 0.0)
    assert dashboards.anomaly_kpis(dashboards.anomaly_records(e)).first().most_common_type == "N/A"
    assert field_rules.row_quality(e).first().quality_score == 0.0
    assert validation.status(validation.validate(e)).first().status == "skipped"
    assert cleaning.report(e).first().error_rate == 0.0


def test_anomaly_flags_and_ties(spark):
    df = spark.createDataFrame([("b", 5.0, True, 4.0), ("a", 5.0, True, 4.0), ("c", 9.0, False, 9.0), ("d", 1.0, None, None)], "order_id string, revenue double, is_anomaly boolean, anomaly_score double")
    assert [r.order_id for r in dashboards.anomaly_records(df).collect()] == ["a", "b"]
    assert [r.order_id for r in dashboards.anomaly_records(df.drop("is_anomaly")).collect()] == ["c", "a", "b"]


def test_null_of_optional_field_fails_its_row_only(spark):
    df = spark.createDataFrame([("a", None), ("b", "x@y.com"), (None, "bad")], "order_id string, customer_email string")
    by = {r.field: r for r in field_rules.field_quality(df).collect()}
    assert (by["order_id"].valid_values, by["order_id"].null_values, by["order_id"].invalid_values) == (2, 1, 0)
    assert (by["customer_email"].valid_values, by["customer_email"].invalid_values) == (2, 1)
    assert field_rules.row_quality(df).first().valid_records == 1
    assert "quantity" in field_rules.missing_fields(df) and "customer_email" not in field_rules.missing_fields(df.select("order_id"))
    assert ("order_id", "many nulls") in {tuple(r) for r in field_rules.findings(field_rules.field_quality(df)).collect()}


def test_operations(spark):
    rows = spark.createDataFrame([("MemoryError", "x"), ("E", "Timeout!"), ("E", "file gone"), ("E", "quality"), ("E", "corrupt"), (None, None)], "kind string, message string")
    assert [r[0] for r in rows.coalesce(1).select(operations.failure_type(F.col("kind"), F.col("message"))).collect()] == ["memory_error", "timeout_error", "io_error", "validation_error", "data_corruption", "processing_error"]
    m = spark.createDataFrame([(1, 96.0, None), (2, None, "failed")], "id int, memory_percent double, overall_status string")
    assert {(r.id, r.rule) for r in operations.fired_alerts(m, "id").collect()} == {(1, "high_memory_usage"), (1, "critical_memory_usage"), (2, "pipeline_failure")}
    assert operations.fired_alerts(m.select("id"), "id").isEmpty()
    s = spark.createDataFrame([("a", "healthy"), ("a", "critical"), ("b", "odd")], "part string, status string")
    assert {(r.part, r.status) for r in operations.health_rollup(s, "part").collect()} == {("a", "critical"), ("b", "healthy")}
    assert operations.processing_summary(spark.createDataFrame([], "status string, records long, duration double")).first().average_throughput == 0.0


def test_versions_cache_checkpoints_lineage(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    v = store.Versions(spark, f"file://{tmp_path}/v")
    assert v.latest("t") is None
    v.create(df.limit(1), "t")
    v.create(df, "t", "second")
    assert files.consistent(v.latest("t"), df) and [e["description"] for e in v.list("t")] == ["second", ""]
    c = store.Cache(spark, f"file://{tmp_path}/c")
    assert c.get("q") is None
    c.put(df, "q", {"a": 1})
    assert c.get("q") is None and c.get("q", {"a": 1}).count() == 2
    assert store.Cache(spark, f"file://{tmp_path}/c", max_age=-1).get("q", {"a": 1}) is None
    store.Cache(spark, f"file://{tmp_path}/c", max_bytes=1).put(df, "r")
    assert c.read_json() == []
    k = store.Checkpoints(spark, f"file://{tmp_path}/k")
    for _ in range(3):
        k.create(df, "stage")
    assert k.cleanup(keep=2) == 0 and k.cleanup(keep=2, max_age=-1) == 1 and len(k.list()) == 2
    n = store.Lineage(spark, f"file://{tmp_path}/l")
    assert n.table().isEmpty()
    n.track("clean", ["raw"], ["cleaned"])
    assert n.produced_by("cleaned").first().operation == "clean" and n.consumed_by("cleaned").isEmpty()


def test_exports_are_checked(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    out = files.export(df, f"file://{tmp_path}", "t")
    assert store.check_exports(df, out) == {"csv": True, "parquet": True}
    assert store.check_exports(df.limit(1), out) == {"csv": False, "parquet": False}
    assert store.checksums(spark, out["parquet"]).filter("length(md5) = 32").count() >= 1
    assert json.loads(store.dashboard_json({"t": df}))["tables"]["t"]["rows"] == 2


def test_pipeline_from_csv(spark, tmp_path):
    generate.dirty(spark, 300).coalesce(1).write.csv(f"file://{tmp_path}/in", header=True)
    out = pipeline.run(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    assert len(out["validation"]) == 13 and spark.read.parquet(out["exports"]["region_wise_performance"]["parquet"]).count() >= 4


def test_check_and_error_reports_are_saved(spark, tmp_path):
    from quarrymill.sources import outputs

    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    base = f"file://{tmp_path}"
    paths = files.export(df, base, "t")
    got = json.loads((tmp_path / "export_check_1.json").read_text() if outputs.save_check_report(df, paths, base, "1") else "")
    assert got["passed"] and got["exports"]["csv"]["consistent"] and got["exports"]["parquet"]["bytes"] > 0
    outputs.save_check_report(df.limit(1), paths, base, "2")
    assert not json.loads((tmp_path / "export_check_2.json").read_text())["passed"]
    errors = spark.createDataFrame([("io", "a", 1), ("io", "b", 3), ("x", "c", 2)], "category string, message string, ts int")
    outputs.save_error_report(errors, ("category",), ("ts", "message"), base, "1", last=2)
    got = json.loads((tmp_path / "error_report_1.json").read_text())
    assert {c["category"]: c["errors"] for c in got["counts"]} == {"io": 2, "x": 1} and [r["message"] for r in got["recent"]] == ["b", "c"]
    assert [r.s for r in dashboards.first_rows(df, "id", 1, low=1).collect()] == ["b"]
