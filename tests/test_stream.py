import shutil
from pathlib import Path

from pyspark.sql import functions as F

from quarrymill.functions.cleaning import DATE_FORMATS, clean, sale_date, with_revenue
from quarrymill.operators import tables
from quarrymill.plans import file_queries
from quarrymill.sources import generate
from quarrymill.sources.files import RAW_COLUMNS
from quarrymill.streaming import monthly
from quarrymill.streaming.monthly import MonthlyStore, digest, keep_monthly


def rows(df):
    return sorted(tuple(r[c] for c in ("month", "total_revenue", "transaction_count", "total_quantity", "avg_discount", "unique_orders", "avg_order_value")) for r in df.collect())


def test_restarts_and_repeats_count_once(spark, tmp_path):
    raw = generate.dirty(spark, 400).select(*RAW_COLUMNS).distinct()
    made = tmp_path / "made"
    raw.repartition(4).write.csv(f"file://{made}", header=True)
    parts = sorted(made.glob("part-*.csv"))
    (tmp_path / "in").mkdir()
    base = f"file://{tmp_path}"
    go = lambda: keep_monthly(spark, f"{base}/in", f"{base}/store", f"{base}/cp").awaitTermination()

    for p in parts[:2]:
        shutil.copy(p, tmp_path / "in" / p.name)
    go()
    store = MonthlyStore(spark, f"{base}/store")
    first = rows(store.table())
    # the same rows under another name, and the rest
    shutil.copy(parts[0], tmp_path / "in" / "again.csv")
    for p in parts[2:]:
        shutil.copy(p, tmp_path / "in" / p.name)
    go()
    want = rows(tables.monthly_sales_summary(clean(spark.read.csv(f"file://{made}", header=True, schema=", ".join(f"{c} string" for c in RAW_COLUMNS)))))
    assert rows(store.table()) == want and first != want and len(store.versions()) <= 3
    go()
    assert rows(store.table()) == want


def test_a_batch_may_be_run_again(spark, tmp_path):
    store = MonthlyStore(spark, f"file://{tmp_path}/s")
    assert store.table().isEmpty()
    d = with_revenue(clean(generate.dirty(spark, 300)))
    halves = [d.filter("pmod(hash(order_id), 2) = 0"), d.filter("pmod(hash(order_id), 2) = 1")]
    store.upsert(halves[0], 0)
    store.upsert(halves[1].limit(20), 1)  # fails half-way, say
    store.upsert(halves[1], 1)
    store.upsert(halves[1], 1)
    store.upsert(d.limit(0), 2)
    assert rows(store.table()) == rows(tables.monthly_sales_summary(d))
    store.upsert(d.filter("sale_date IS NOT NULL").limit(1), 3)  # no new order
    assert sum(r[5] for r in rows(store.table())) == sum(r[5] for r in rows(tables.monthly_sales_summary(d)))


def test_streamed_files_follow_the_lines(spark, monkeypatch):
    """Some 6,000 lines are seven files in two batches, with the rows that two files give."""
    calls, real = [], file_queries.keep_monthly

    def noted(session, folder, store, checkpoint, files_per_trigger=1):
        calls.append((len(list(Path(folder.removeprefix("file://")).glob("part-*.csv"))), files_per_trigger))
        return real(session, folder, store, checkpoint, files_per_trigger)

    monkeypatch.setattr(file_queries, "keep_monthly", noted)
    many, few = (rows(file_queries._streamed(spark, "/root/testdata/sf0.001", n)) for n in (1000, 10**9))
    n = -(-spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count() // 1000)
    assert calls == [(n, -(-n // 2)), (2, 1)] and n > 2 and many == few


def test_orders_of_a_month_and_batch_are_one_file(spark, tmp_path):
    """Without adaptive execution, as in a stream, each of 16 tasks would write a file for each month."""
    d = with_revenue(clean(generate.dirty(spark, 400)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        MonthlyStore(spark, f"file://{tmp_path}/s").upsert(d, 0)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    files = [len(list(p.glob("part-*.parquet"))) for p in tmp_path.glob("s/orders/month=*/batch=0")]
    assert len(files) > 1 and set(files) == {1}


def test_orders_of_a_large_month_are_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(monthly, "_ROWS", 5)
    d, store = with_revenue(clean(generate.dirty(spark, 400))), MonthlyStore(spark, f"file://{tmp_path}/s")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as in a stream
    try:
        store.upsert(d, 0)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert max(len(list(p.glob("part-*.parquet"))) for p in tmp_path.glob("s/orders/month=*/batch=0")) > 1
    assert rows(store.table()) == rows(tables.monthly_sales_summary(d))


def test_state_is_on_disk_and_holds_digests(spark, tmp_path):
    """A batch for each file and none without; the session's settings stay as they are, and one that it has holds."""
    raw = generate.dirty(spark, 200).select(*RAW_COLUMNS).distinct()
    raw.repartition(2).write.csv(f"file://{tmp_path}/in", header=True)
    name, other = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    got = []
    for given in (None, other):
        if given:
            spark.conf.set(name, given)
        try:
            base = f"file://{tmp_path}/{len(got)}"
            query = keep_monthly(spark, f"file://{tmp_path}/in", f"{base}/store", f"{base}/cp")
            query.awaitTermination()
            assert spark.conf.get(name, None) == given
        finally:
            spark.conf.unset(name)
        got.append(([p["batchId"] for p in query.recentProgress], any("rocksdb" in k for k in query.lastProgress["stateOperators"][0]["customMetrics"]), rows(MonthlyStore(spark, f"{base}/store").table())))
        state = b"".join(p.read_bytes() for p in (tmp_path / str(len(got) - 1) / "cp" / "state").rglob("*") if p.is_file() and "chema" in str(p.relative_to(tmp_path)))
        assert b"_key" in state and b"product_name" not in state
    assert got[0][:2] == ([0, 1], True) and got[1][:2] == ([0, 1], False) and got[0][2] == got[1][2]


def test_digests_tell_rows_apart(spark):
    """Nulls, empty texts, borders between columns and what looks like a length."""
    values = [("ab", "c"), ("a", "bc"), ("abc", ""), ("", "abc"), (None, "abc"), ("abc", None), ("-", "abc"), (None, None), ("", ""), ("-", "-"), ("1:a", None), ("a", "1:a"), ("é", "c"), ("e", "c")]
    d = spark.createDataFrame(values + values, "a string, b string").select(digest(("a", "b")).alias("d"))
    assert d.distinct().count() == len(values) and d.filter("d IS NULL OR length(d) <> 32").isEmpty()


def test_sale_dates_are_read_as_by_trying_all_formats(spark):
    """A format is tried only on texts of its shape; years that Spark's parser raises on can't be read."""
    days = ["1995-01-31", "1995-1-3", "31/12/1995", "12/31/1995", "3/4/1995", "03-04-1995", "12-31-1995", "1995/2/3", "3.4.1995", "Jan 3, 1995", "jan 03, 1995", "January 3, 1995", "1995-02-30", "30/02/1995", "0001-01-01", "12345-01-01", "+12345-01-01", "-1995-01-01", "95-01-01", "1/1/95", "00/01/1995", "13/13/1995", "", "x", "1995-01", "Sept 3, 1995"]
    texts = [d + t for d in days for t in ("", " 10:11:12", " 1:2:3", "T10:11:12", "t10:11:12Z", "T1:2:3Z", " 24:00:00", " 25:00:00", " 10:11", "\n", " ")] + [" 1995-01-31 ", "１９９５-01-31", None]
    d = spark.createDataFrame([(x,) for x in texts], "s string")
    plain = F.coalesce(*(F.try_to_timestamp(F.trim("s"), F.lit(f)) for f in DATE_FORMATS))
    got = d.select("s", sale_date(F.col("s")).cast("string").alias("a"), plain.cast("string").alias("b")).collect()
    assert [(r.s, r.a) for r in got] == [(r.s, r.b) for r in got] and sum(r.a is not None for r in got) > 40
    ends = spark.createDataFrame([("+294246-12-31",), ("+300000-01-01",), ("-300000-01-01",)], "s string").select(F.year(sale_date(F.col("s"))).alias("x"))
    assert [r.x for r in ends.collect()] == [294246, None, None]
