"""Files as a stream: the monthly table kept up as files arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.cleaning import clean, with_revenue
from ..functions.numeric import davg, dsum, half_even, ratio
from ..sources.files import RAW_COLUMNS
from ..sources.store import Folder

_STATE = "month string, revenue decimal(38,6), transactions bigint, quantity bigint, discount decimal(38,6), discounts bigint, orders bigint"
#: Versions of the table that are kept besides the last one.
KEPT = 2
#: What an upsert uses of a row.
_USED = ("sale_date", "order_id", "quantity", "discount_percent", "revenue")
#: Rows of a month and batch, from which on its orders are written as several files.
_ROWS = 4_000_000
_CONF = "spark.sql.streaming."
#: Settings of the stream where the session has none: state on the executors' disks, in bounded memory; rows that have had their
#: time leave the state with the next files, and not in a batch of its own.
_SETTINGS = {
    f"{_CONF}stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", f"{_CONF}stateStore.rocksdb.boundedMemoryUsage": "true",
    f"{_CONF}stateStore.rocksdb.trackTotalNumberOfRows": "false", f"{_CONF}noDataMicroBatches.enabled": "false",
}


def raw_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(", ".join(f"{c} string" for c in RAW_COLUMNS)).option("header", True).option("maxFilesPerTrigger", files_per_trigger).csv(folder)


def monthly_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    d = with_revenue(clean(raw_stream(spark, folder, files_per_trigger))).filter("sale_date IS NOT NULL")
    return d.groupBy(F.date_format("sale_date", "yyyy-MM").alias("month")).agg(half_even(dsum("revenue")).alias("total_revenue"), F.count("revenue").alias("transaction_count"), F.sum("quantity").alias("total_quantity"), half_even(davg("discount_percent")).alias("avg_discount"))


def digest(columns: tuple[str, ...]) -> Column:
    """SHA-256 of the columns as text, each with its length, nulls apart: 32 bytes that stand for a row in a stream's state."""
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (F.col(x).cast("string") for x in columns)]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def once(raw: DataFrame, key: tuple[str, ...] = RAW_COLUMNS, delay: str = "2 days") -> DataFrame:
    """A row that is delivered again within ``delay`` of its arrival goes; key: the columns that tell rows apart, all by
    default, as an order may have several rows. The watermark follows arrival, not the date of sale: no late sale is lost."""
    arrived = raw.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", delay)
    return arrived.dropDuplicatesWithinWatermark(list(key)).drop("_arrived")


class MonthlyStore:
    """The monthly table as versions, one for each batch, and the orders of each month.

    A batch adds its sums to the last version before it and writes version=<batch>; of its orders, those that no earlier
    batch has go to orders/month=<month>/batch=<batch>. A batch that is run again, after a failure, finds the same version
    before it and overwrites what it has written: nothing counts twice. Versions without Spark's mark of success don't
    count. Only the months of a batch are read of the orders.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.folder = spark, Folder(spark, base)

    def versions(self) -> list[int]:
        fs, p = self.folder._at("versions/version=*/_SUCCESS")
        return sorted(int(f.getPath().getParent().getName().partition("=")[2]) for f in fs.globStatus(p) or [])

    def _before(self, batch: int) -> DataFrame:
        earlier = [v for v in self.versions() if v < batch]
        return self.spark.read.schema(_STATE).parquet(f"{self.folder.base}/versions/version={earlier[-1]}") if earlier else self.spark.createDataFrame([], _STATE)

    def upsert(self, rows: DataFrame, batch: int) -> None:
        """rows: cleaned, with revenue."""
        d = rows.filter("sale_date IS NOT NULL").withColumn("month", F.date_format("sale_date", "yyyy-MM")).persist()
        try:
            sums = d.groupBy("month").agg(
                F.coalesce(F.sum(F.col("revenue").cast("decimal(20,6)")), F.lit(0)).alias("revenue"), F.count("revenue").alias("transactions"), F.coalesce(F.sum("quantity"), F.lit(0)).cast("bigint").alias("quantity"),
                F.coalesce(F.sum(F.col("discount_percent").cast("decimal(20,6)")), F.lit(0)).alias("discount"), F.count("discount_percent").alias("discounts"), F.count("order_id").alias("orders"),
            ).collect()  # at most a row for each month there is; orders: rows that name one
            months = [r.month for r in sums]
            own = d.select("month", "order_id").filter("order_id IS NOT NULL").distinct()
            base = f"{self.folder.base}/orders"
            if self.folder.size("orders"):
                seen = self.spark.read.schema("order_id string, month string, batch bigint").parquet(base).filter(F.col("month").isin(months) & (F.col("batch") < batch))
                own = own.join(seen.select("month", "order_id"), ["month", "order_id"], "left_anti")
            for m in months:  # what an earlier try has left
                self.folder.delete(f"orders/month={m}/batch={batch}")
            # a month's orders meet before they are written, else each task would write a file for each month
            share = F.pmod(F.xxhash64("order_id"), F.lit(max(1, -(-max((r.orders for r in sums), default=1) // _ROWS))))
            own.repartition("month", share).withColumn("batch", F.lit(batch).cast("long")).write.partitionBy("month", "batch").mode("append").parquet(base)
            new = self.spark.read.schema("order_id string, month string, batch bigint").parquet(base).filter(F.col("month").isin(months) & (F.col("batch") == batch)).groupBy("month").agg(F.count(F.lit(1)).alias("orders"))
            names = [c.split()[0] for c in _STATE.split(", ")]
            both = self._before(batch).unionByName(self.spark.createDataFrame(sums, _STATE).drop("orders").join(new, "month", "left").na.fill(0, ["orders"]).select(names))
            state = both.groupBy("month").agg(*(F.sum(c).cast(kind).alias(c) for c, kind in (x.split() for x in _STATE.split(", ")[1:])))
            state.coalesce(1).write.mode("overwrite").parquet(f"{self.folder.base}/versions/version={batch}")  # a row for a month
        finally:
            d.unpersist()
        for v in self.versions()[: -1 - KEPT]:
            self.folder.delete(f"versions/version={v}")

    def table(self) -> DataFrame:
        """The last version, with the columns of tables.monthly_sales_summary()."""
        last = (self.versions() or [-1])[-1]
        t = self._before(last + 1).select("month", half_even(F.col("revenue").cast("double")).alias("total_revenue"), F.col("transactions").alias("transaction_count"), F.col("quantity").alias("total_quantity"), half_even(ratio(F.col("discount").cast("double"), F.col("discounts"))).alias("avg_discount"), F.col("orders").alias("unique_orders"))
        return t.withColumn("avg_order_value", half_even(ratio(F.col("total_revenue"), F.col("unique_orders"))))


def keep_monthly(spark: SparkSession, folder: str, store: str, checkpoint: str, files_per_trigger: int = 1, key: tuple[str, ...] = RAW_COLUMNS, delay: str = "2 days", once_through: bool = True) -> StreamingQuery:
    """Keeps MonthlyStore(spark, store) up with the CSV files of a folder; starts where its checkpoint ends. once_through:
    ends when it has read what is there, else it waits for more. Rows meet by the digest of their key, cleaned, with what an
    upsert uses."""
    target = MonthlyStore(spark, store)
    raw = raw_stream(spark, folder, files_per_trigger).withColumn("_key", digest(key))
    rows = once(with_revenue(clean(raw)).filter("sale_date IS NOT NULL").select(*_USED, "_key"), ("_key",), delay).drop("_key")
    writer = rows.writeStream.foreachBatch(lambda d, batch: target.upsert(d, batch)).option("checkpointLocation", checkpoint)
    own = {k: v for k, v in _SETTINGS.items() if spark.conf.get(k, None) is None}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        return (writer.trigger(availableNow=True) if once_through else writer).start()  # the stream has a copy of the settings
    finally:
        for k in own:
            spark.conf.unset(k)
