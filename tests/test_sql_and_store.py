import random
import threading

import pytest
from pyspark.sql import functions as F

from quarrymill.functions.cleaning import clean
from quarrymill.operators import sketches
from quarrymill.plans import surface
from quarrymill.sources import files, generate, store


def test_writers_at_once_lose_nothing(spark, tmp_path):
    base, errors = f"file://{tmp_path}", []
    store.Folder(spark, base).add({"key": "first"})

    def write(n):
        try:
            folder = store.Folder(spark, base)
            for i in range(12):
                folder.add({"key": f"{n}-{i}"})
                if i % 5 == n:
                    folder.gather()
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    got = store.Folder(spark, base)
    assert sorted(e["key"] for e in got.read_json()) == sorted(["first", *(f"{n}-{i}" for n in range(3) for i in range(12))])
    keys = [e["key"] for e in got.read_json() if e["key"].startswith("1-")]
    assert keys == [f"1-{i}" for i in range(12)]  # in the order of writing
    got.remove(*(e for e in got.read_json() if e["key"] != "2-7"))
    got.gather()
    assert [e["key"] for e in got.read_json()] == ["2-7"]
    got.gather(keep=0)
    assert [e["key"] for e in got.read_json()] == ["2-7"] and len(list((tmp_path / "log").glob("*.json"))) == 1


def test_two_writers_of_one_cache_key(spark, tmp_path):
    c = store.Cache(spark, f"file://{tmp_path}")
    threads = [threading.Thread(target=lambda n=n: c.put(spark.range(n), "q")) for n in (3, 5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert c.get("q").count() in (3, 5)
    c.put(spark.range(7), "q")
    assert c.get("q").count() == 7 and len([e for e in c.read_json()]) == 1
    with pytest.raises(KeyError):
        c.load("none")


def test_sketches_of_any_months(spark):
    r = random.Random(1)
    rows = [(f"o{r.randrange(4000)}", f"2023-{r.randrange(1, 7):02d}-05", r.lognormvariate(3, 1)) for _ in range(20_000)] + [("late", None, 1.0), ("null", "2024-01-01", None), ("nan", "2024-01-01", float("nan"))]
    df = spark.createDataFrame(rows, "order_id string, sale_date string, revenue double").withColumn("sale_date", F.col("sale_date").cast("timestamp"))
    df = df.withColumns({"quantity": F.lit(1), "unit_price": F.lit(1.0), "discount_percent": F.lit(0.0)})
    stored = sketches.monthly_sketches(df.repartition(5))
    part = sketches.estimates(sketches.merged(sketches.months_between(stored, "2023-02", "2023-04")), (0.1, 0.5, 0.9)).first()
    own = [x for x in rows if x[1] and "2023-02" <= x[1][:7] <= "2023-04"]
    values, orders = sorted(x[2] for x in own), len({x[0] for x in own})
    assert part.transactions == len(own) and part.revenue == pytest.approx(sum(values), abs=0.01)
    assert abs(part.unique_orders / orders - 1) < 0.03
    for p, q in zip((0.1, 0.5, 0.9), part.quantiles, strict=True):
        assert abs(sum(v <= q for v in values) / len(values) - p) < 0.02
    odd = sketches.estimates(sketches.months_between(stored, "2024-01")).first()
    assert (odd.transactions, odd.unique_orders, odd.quantiles) == (0, 2, None)
    assert sketches.merged(stored.limit(0)).first().transactions is None
    years = sketches.estimates(sketches.merged(stored, F.substring("month", 1, 4).alias("year"))).collect()
    assert {y.year for y in years} == {"2023", "2024"}


def test_sql_surface(spark, tmp_path):
    names = surface.register(spark, clean(generate.mixed(spark, 300)))
    calls = {"sales_between": "DATE'2023-02-01', DATE'2023-02-28'", "monthly_between": "'2023-02', '2023-04'", "sales_of_region": "'South'", "products_of_category": "'Fashion'", "anomalies_over": "1.5", "csv_fields": "'a,\"b,c\",', ','"}
    got = {n: spark.sql(f"SELECT * FROM {n}({calls[n]})" if n in calls else f"SELECT * FROM {n}") for n in names}
    assert set(calls) < set(names) and all(len(df.columns) for df in got.values())
    assert [r.value for r in got["csv_fields"].orderBy("place").collect()] == ["a", "b,c", ""]
    assert got["monthly_between"].count() == 3 and not got["monthly_sales_summary"].isEmpty()
    assert got["sales_between"].count() == got["sales"].filter("month(sale_date) = 2").count() > 0
    assert got["sales_of_region"].filter("region <> 'South'").isEmpty() and got["products_of_category"].count() > 1
    assert got["anomalies_over"].count() <= got["sales_anomalies"].count()
    lines = spark.sql("SELECT count(*) AS n FROM VALUES ('1;2'), (NULL), ('3') AS t(line), LATERAL csv_fields(line, ';')")
    assert lines.first().n == 3
    files.export(got["region_wise_performance"], f"file://{tmp_path}", "analytical_regions")
    assert list(surface.register_exports(spark, f"file://{tmp_path}", ("regions", "gone"))) == ["regions"]
    assert spark.sql("SELECT * FROM exported_regions").count() == got["region_wise_performance"].count()
    assert all(not spark.sql(f"SELECT * FROM {n}").isEmpty() for n in surface.register_generated(spark, 50))
    for n in names:
        spark.catalog.dropTempView(n)
