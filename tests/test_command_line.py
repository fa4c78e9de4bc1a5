import json
import logging

import pytest
from pyspark.sql import functions as F

from quarrymill.__main__ import arguments, main, read_config
from quarrymill.functions import cleaning
from quarrymill.operators import reports
from quarrymill.plans import logs
from quarrymill.sources import generate

HEAD = "order_id,product_name,category,quantity,unit_price,discount_percent,region,sale_date,customer_email\n"


def test_config(tmp_path):
    (tmp_path / "c.toml").write_text('output = "x"\nanomaly_threshold = 2\nskip_stages = ["export"]\ninput = ["a.csv"]\n')
    a = arguments(["--config", str(tmp_path / "c.toml"), "--output", "y"])
    assert (a.output, a.anomaly_threshold, a.skip_stages, a.input, a.log_level, a.formats) == ("y", 2.0, ["export"], ["a.csv"], "WARN", ["csv", "parquet"])
    for wrong in ({"other": 1}, {"output": 1}, {"skip_stages": ["none"]}, {"formats": ["json"]}):
        (tmp_path / "c.json").write_text(json.dumps(wrong))
        with pytest.raises(ValueError):
            read_config(str(tmp_path / "c.json"))
    with pytest.raises(SystemExit):
        arguments([])


def test_dirty_rows_without_cleaning_and_status(spark, tmp_path, capsys):
    path, out, log_file = tmp_path / "sales.csv", f"file://{tmp_path}/out", tmp_path / "run.log"
    path.write_text(HEAD + 'o1,"a ""lamp""\nin two lines",x,abc,$5,150%,n,2024-13-45,no\no2,b,y,3,10,0.1,north,25/01/2024,a@b.co\no3,c\n')
    (tmp_path / "c.json").write_text(json.dumps({"log_file": str(log_file), "formats": ["parquet"], "log_level": "INFO"}))
    assert main(["--status-only", "--output", out], spark) == {"tables": dict.fromkeys(("monthly_sales_summary", "top_products", "region_wise_performance", "category_discount_map", "anomaly_records")), "validation": None}
    done = main(["--input", str(path), str(tmp_path / "none.csv"), "--output", out, "--skip-stages", "clean", "--config", str(tmp_path / "c.json")], spark)
    assert done["validation"]["status"] in ("error", "critical") and (done["ingestion"]["rows"], done["ingestion"]["dropped"]) == (2, 1)
    assert "no such file" in done["input"][str(tmp_path / "none.csv")] and set(done["exports"]["top_products"]) == {"parquet"}
    assert [r.month for r in spark.read.parquet(done["exports"]["monthly_sales_summary"]["parquet"]).collect()] == ["2024-01"]
    after = main(["--status-only", "--output", out], spark)
    assert after["validation"]["status"] == done["validation"]["status"] and after["tables"]["top_products"].endswith(".parquet")
    said = [json.loads(line) for line in log_file.read_text().splitlines()]
    assert {"quality", "processing"} <= {s.get("topic") for s in said} and json.loads(capsys.readouterr().out.splitlines()[-1]) == after
    logs.set_up("WARNING")


def test_logs(tmp_path):
    counts = logs.set_up("INFO", str(tmp_path / "all.log"), {str(tmp_path / "quality.log"): ("quality",)}, name="quarrymill.test")
    log = logging.getLogger("quarrymill.test.x")
    log.debug("hidden")
    log.info("rows", extra={"topic": "quality", "n": 3})
    try:
        raise KeyError("k")
    except KeyError:
        log.exception("failed")
    lines = [json.loads(x) for x in (tmp_path / "all.log").read_text().splitlines()]
    assert [(x["level"], x["message"]) for x in lines] == [("INFO", "rows"), ("ERROR", "failed")] and lines[0]["n"] == 3 and "KeyError" in lines[1]["error"]
    assert [json.loads(x)["message"] for x in (tmp_path / "quality.log").read_text().splitlines()] == ["rows"]
    assert counts.by_level == {"INFO": 1, "ERROR": 1}
    logs.set_up(name="quarrymill.test")
    assert len(logging.getLogger("quarrymill.test").handlers) == 2


def test_time_series_and_scenarios(spark):
    t = generate.time_series(spark, 3000).withColumn("month", F.month("sale_date"))
    by = {r.month: r for r in t.groupBy("month").agg(F.avg("quantity").alias("q"), F.avg("discount_percent").alias("d"), F.avg((F.col("category") == "Electronics").cast("int")).alias("e")).collect()}
    assert len(by) == 12 and by[12].q > 1.8 * by[3].q and by[12].d > 0.2 > 0.12 > by[3].d and by[11].e > 0.4 > by[7].e
    s = generate.scenarios(spark, {"clean": 30, "dirty": 40, "anomaly": 20, "time_series": 10})
    got = s.collect()
    assert len({r.order_id for r in got}) == 100 and all(r.order_id for r in got) and sorted(tuple(r) for r in got if r.data_scenario == "clean") == sorted(tuple(r) for r in generate.scenarios(spark, {"clean": 30}).collect())
    assert len({r.data_scenario for r in got[:25]}) > 2  # mixed
    assert generate.scenarios(spark, {}).isEmpty() and generate.mixed(spark, 50, shuffled=True).count() == 50
    with pytest.raises(ValueError, match="odd"):
        generate.scenarios(spark, {"odd": 1})


def test_cleaning_advice_and_standards(spark):
    df = spark.createDataFrame([("abc", "NORTH", "2023-01-01"), ("1", "north ", "no"), ("2", None, None), ("50000", "n", "2023-01-01")], "quantity string, region string, sale_date string")
    assert sorted(map(tuple, reports.cleaning_advice(cleaning.report(df), cleaning.issues(df)).collect())) == [("quantity", "improve_collection"), ("quantity", "review_entry_guidelines")]
    fine = df.filter("quantity = '1'")
    assert [tuple(r) for r in reports.cleaning_advice(cleaning.report(fine), cleaning.issues(fine)).collect()] == [("all", "none")]
    got = {r.field: tuple(r)[1:] for r in cleaning.standardization_report(df).collect()}
    assert got == {"region": (3, 2, 0.3333, 1, 0, 1.0), "sale_date": (2, 1, 0.5, 1, 2, 0.5)}
    assert cleaning.standardization_report(df.limit(0)).isEmpty()
