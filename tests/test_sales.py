import pytest
import datetime

from quarrymill.functions import cleaning as c
from quarrymill.operators import anomalies, validation
from quarrymill.sources import files


def values(spark, f, items):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v string").coalesce(1)
    return [r[0] for r in df.orderBy("i").select(f(df.v)).collect()]


def test_numbers(spark):
    assert values(spark, c.quantity, ["5", "10.5", "0", "-2", "abc", "", None, "15", "20 units", "15000", "0.9", "nan"]) == [5, 10, 1, 1, 1, 1, 1, 15, 20, 10000, 1, 1]
    assert values(spark, c.discount, ["0.15", "15", "1.0", "150", "-0.1", "abc", "", None, "25%", "100.1"]) == [0.15, 0.15, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.25, 1.0]
    assert values(spark, c.unit_price, ["10.99", "0", "-5.50", "abc", "", None, "$15.99", "2000000"]) == [10.99, 0.01, 0.01, 0.01, 0.01, 0.01, 15.99, 1e6]


def test_texts(spark):
    assert values(spark, c.product_name, ["apple iphone 13", "  extra   spaces  ", "product@#$%with&*special()chars", "", None, "product with and in the name", "a", "Product-Name_With-Special_Chars"]) == ["Apple Iphone 13", "Extra Spaces", "Productwith&special()chars", "Unknown Product", "Unknown Product", "Product w/ & in the Name", "A", "Product-Name_With-Special_Chars"]
    assert values(spark, c.category, ["electronics", "FASHION", "home goods", "elec", "tech", "unknown_category", "", None, "Home & Garden"]) == ["Electronics", "Fashion", "Home Goods", "Electronics", "Electronics", "Unknown Category", "Other", "Other", "Home Garden"]
    assert values(spark, c.region, ["north", "nort", "w", "southeast", "unknown_region", "", None]) == ["North", "North", "West", "Southeast", "Unknown_region", "Unknown", "Unknown"]
    assert values(spark, c.email, ["user@example.com", "INVALID.EMAIL", "test@domain.co.uk", "", None, "user@", "@domain.com"]) == ["user@example.com", None, "test@domain.co.uk", None, None, None, None]


def test_dates(spark):
    got = values(spark, c.sale_date, ["2023-01-15", "15/01/2023", "2023-02-29", "2024-02-29", "2023-13-01", "", None, "2023-01-15 10:30:00"])
    d = datetime.datetime
    assert got == [d(2023, 1, 15), d(2023, 1, 15), None, d(2024, 2, 29), None, None, None, d(2023, 1, 15, 10, 30)]


def test_constant_column_has_no_anomaly(spark):
    df = spark.createDataFrame([(str(i), 10, 100.0, 0.1, 900.0) for i in range(50)], "order_id string, quantity int, unit_price double, discount_percent double, revenue double")
    assert anomalies.report(anomalies.detect(df)).first().total_anomalies == 0
    by = {r.rule_name: r for r in validation.validate(df).collect()}
    assert by["order_id_unique"].passed and by["quantity_statistical"].passed


def test_export_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "id int, s string")
    out = files.export(df, str(tmp_path), "t")
    assert files.consistent(df, spark.read.parquet(out["parquet"]))
    assert spark.read.csv(out["csv"], header=True).count() == 3


def test_quantiles(spark):
    """Against numpy, with long tails, negatives, ties, one value, and values that don't count."""
    import numpy as np
    from pyspark.sql import functions as F

    from quarrymill.functions import quantiles as q

    rng = np.random.default_rng(5)
    sets = {"a": rng.lognormal(0, 4, 500), "b": rng.integers(-3, 3, 400).astype(float), "c": np.array([7.5]), "d": -rng.lognormal(3, 2, 301)}
    rows = [(k, float(v)) for k, x in sets.items() for v in x] + [("a", None), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    counts = q.value_counts(df, **{k: F.when(F.col("k") == k, F.col("v")) for k in sets})
    at = (0.0, 0.05, 0.25, 0.5, 0.77, 0.99, 1.0)
    got = {r.name: r for r in q.quantiles(counts, at).collect()}
    spread = {r.name: r for r in q.moments(counts).collect()}
    top = {r.name: r.top for r in q.top_sum(counts, lambda n: F.floor(n * 0.1)).collect()}
    for k, x in sets.items():
        assert got[k].total == len(x) and np.allclose(got[k].q, np.quantile(x, at), rtol=1e-12)
        assert np.isclose(spread[k].mean, x.mean()) and (len(x) < 2 or np.isclose(spread[k].std, x.std(ddof=1))) and (spread[k].std is None) == (len(x) < 2)
        assert np.isclose(top[k], np.sort(x)[::-1][: len(x) // 10].sum(), rtol=1e-6, atol=1e-4)
    assert not q.quantiles(counts.limit(0), at).collect()


def test_quantiles_of_dense_values(spark, monkeypatch):
    """Values that are close together, so that a bin is divided again and again; and the same figures at once."""
    import numpy as np

    from quarrymill.functions import quantiles as q

    rng = np.random.default_rng(6)
    sets = {"a": 1000 + rng.random(900) * 0.5, "b": np.r_[1.0 + np.arange(300) * 1e-12, 1.5, 2.5], "c": np.full(70, 3.25), "d": -5 - rng.random(200) * 1e-3}
    rows = [(k, float(v)) for k, x in sets.items() for v in x]
    counts = spark.createDataFrame(rows, "name string, x double").groupBy("name", "x").count().withColumnRenamed("count", "n").cache()
    at = (0.01, 0.5, 0.9)
    for dense, parts in ((10, 16), (40, 8), (100_000, 1 << 16)):
        monkeypatch.setattr(q, "DENSE", dense)
        monkeypatch.setattr(q, "PARTS", parts)
        got = {r.name: r for r in q.quantiles_and_tops(counts, at, (0.05, 0.1)).collect()}
        for k, x in sets.items():
            assert got[k].total == len(x) and np.allclose(got[k].q, np.quantile(x, at), rtol=1e-14, atol=0)
            assert np.allclose(got[k].tops, [np.sort(x)[::-1][: int(len(x) * s)].sum() for s in (0.05, 0.1)], rtol=1e-8)
    wide = spark.range(300_000).selectExpr("'w' AS name", "100 + pmod(hash(id), 1000003) / 1e7 AS x").groupBy("name", "x").count().withColumnRenamed("count", "n")
    values = np.sort(np.concatenate([np.full(r.n, r.x) for r in wide.collect()]))
    assert np.allclose(q.quantiles(wide, at).first().q, np.quantile(values, at), rtol=1e-14)


def test_command_line(spark, tmp_path, capsys):
    from quarrymill.__main__ import main

    path = tmp_path / "sales.csv"
    path.write_text("order_id,product_name,category,quantity,unit_price,discount_percent,region,sale_date,customer_email\n" + "".join(f"o{i},lamp,home goods,{i % 4 + 1},10,0.1,north,2024-01-0{i % 9 + 1},a{i}@b.co\n" for i in range(30)))
    dry = main(["--input", str(path), "--output", str(tmp_path / "out"), "--dry-run"], spark)
    assert dry["input"] == {str(path): "ok"} and "exports" not in dry and not (tmp_path / "out").exists()
    done = main(["--input", str(path), "--output", str(tmp_path / "out"), "--skip-stages", "tables"], spark)
    assert list(done["exports"]) == ["sales"] and done["validation"]["status"] in ("passed", "warning", "error", "critical")
    assert spark.read.parquet(done["exports"]["sales"]["parquet"]).count() == 30
    assert main(["--input", str(tmp_path / "none.csv")], spark)["input"][str(tmp_path / "none.csv")] != "ok"


def test_monthly_stream(spark, tmp_path):
    from quarrymill.streaming.monthly import monthly_stream

    (tmp_path / "in").mkdir()
    for n in (1, 2):
        (tmp_path / "in" / f"{n}.csv").write_text("order_id,product_name,category,quantity,unit_price,discount_percent,region,sale_date,customer_email\n" + f"o{n},lamp,home goods,{n},10,0.5,north,2024-0{n}-03,a@b.co\n" + f"p{n},lamp,home goods,1,10,0,north,2024-01-05,a@b.co\n")
    q = monthly_stream(spark, str(tmp_path / "in")).writeStream.outputMode("complete").format("memory").queryName("months").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.month: (r.total_revenue, r.transaction_count, r.total_quantity, r.avg_discount) for r in spark.table("months").collect()}
    assert got == {"2024-01": (25.0, 3, 3, 0.17), "2024-02": (10.0, 1, 2, 0.5)}


def test_anomaly_bounds_are_constants(spark, capsys):
    """Rows meet no table of statistics; values that don't count have no score."""
    rows = [("a", 10 + i % 3, 100.0, 0.1, 900.0 + i % 5) for i in range(40)] + [("b", 500, 100.0, 0.9, 50000.0), ("c", -1, 1.0, 2.0, float("nan")), ("d", None, 1.0, None, float("inf"))]
    df = spark.createDataFrame(rows, "order_id string, quantity int, unit_price double, discount_percent double, revenue double")
    found = anomalies.detect(df)
    anomalies.top_records(found).explain()
    assert "Join" not in capsys.readouterr().out
    got = {r.order_id: r for r in found.collect()}
    for m, c in anomalies.MEASURES.items():
        xs = [r[("order_id", "quantity", "unit_price", "discount_percent", "revenue").index(c)] for r in rows[:-2]]
        mean = sum(xs) / len(xs)
        std = (sum((x - mean) ** 2 for x in xs) / (len(xs) - 1)) ** 0.5
        assert got["b"][f"{m}_anomaly_score"] == pytest.approx(abs(xs[-1] - mean) / std) and got["b"][f"{m}_anomaly_iqr"]
        assert all(not got[o][f"{m}_anomaly_{k}"] and got[o][f"{m}_anomaly_score"] == 0.0 and got[o][f"{m}_anomaly_reason"] == "Normal" for o in "cd" for k in ("zscore", "iqr"))
    assert [r.order_id for r in anomalies.top_records(found).collect()] == ["b"]
    none = anomalies.detect(df.filter("order_id = 'd'")).first()
    assert none.quantity_anomaly_reason == "No valid data" and none.quantity_anomaly_score == 0.0
