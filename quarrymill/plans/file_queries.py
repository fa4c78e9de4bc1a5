"""Queries that go through files: what is written is read again, and compared with SQL over the tables themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.numeric import half_even
from ..functions.written import shared
from ..operators import dashboards, tables
from ..sources import files, outputs, store
from ..sources.files import RAW_COLUMNS
from ..streaming.monthly import MonthlyStore, keep_monthly
from .queries import MONTHLY, SALES, _a, _r, _s, _t, sales
from .report_queries import _RESULTS, REGIONS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def _csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.options(header=True, sep=sep, escape='"', nullValue="", emptyValue="").csv(path)


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Events as CSV in two kinds of files, with other columns in another order, another delimiter, quotes and line breaks."""
    e = _t(spark, d, "events").select(F.col("event_id").cast("string").alias("event_id"), "event_type", F.col("value").cast("string").alias("value"), F.concat(F.lit('said "'), "event_type", F.lit('",\n'), F.col("props")).alias("note"))
    folder = _folder(spark, "events")
    _csv(e.filter("event_id % 3 <> 0").select("event_id", "event_type", "value", "note"), f"{folder}/a")
    _csv(e.filter("event_id % 3 = 0").select("note", "event_type", "event_id"), f"{folder}/b", ";")
    got = files.ingest(spark, [f"{folder}/a", f"{folder}/b"])
    return got.rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("values"), F.sum(F.col("event_id").cast("long")).alias("ids"), F.sum(F.length("note")).alias("characters"), F.count_if(F.col("note").contains("\n")).alias("breaks"))


QUERIES["src11_files_by_their_heads"] = _events
ORACLES["src11_files_by_their_heads"] = """SELECT event_type, count(*) AS n, count(CASE WHEN event_id % 3 <> 0 THEN value END) AS values, sum(event_id)::BIGINT AS ids, sum(length('said "' || event_type || '",' || chr(10) || props))::BIGINT AS characters, count(*) AS breaks FROM events GROUP BY 1"""


def _ingestion(spark: SparkSession, d: str) -> DataFrame:
    """Parts as lines, some of which have a field too many, and what is counted while they are read."""
    p = _t(spark, d, "part").select(F.concat_ws(",", F.col("p_partkey").cast("string"), F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(""), F.when(F.col("p_partkey") % 10 == 0, "a,b").otherwise("a")).alias("value"))
    folder = _folder(spark, "parts")
    p.write.option("lineSep", "\n").text(f"{folder}/body")
    head = spark.createDataFrame([("part,brand,note",)], "value string")
    head.unionByName(spark.read.text(f"{folder}/body")).coalesce(1).write.text(f"{folder}/one")  # one file with its head
    _, stats = files.timed_ingestion(spark, f"{folder}/one", delimiter=",")
    return spark.createDataFrame([(stats["rows"], stats["dropped"], stats["nulls"]["brand"], files.estimated_rows(spark, f"{folder}/one")[0])], "rows bigint, dropped bigint, null_brands bigint, lines bigint")


QUERIES["src12_figures_of_a_read"] = _ingestion
ORACLES["src12_figures_of_a_read"] = "SELECT count(*) FILTER (p_partkey % 10 <> 0) AS rows, count(*) FILTER (p_partkey % 10 = 0) AS dropped, count(*) FILTER (p_partkey % 10 <> 0 AND NOT p_size > 25) AS null_brands, count(*) AS lines FROM part"


def _exported(spark: SparkSession, d: str) -> DataFrame:
    """The monthly table, exported, checked and found again in both formats."""
    month, folder = tables.monthly_sales_summary(sales(spark, d)), _folder(spark, "exports")
    paths = files.export_tables({"monthly_sales_summary": month}, folder)["monthly_sales_summary"]
    schema = month.schema
    back = {"csv": spark.read.schema(schema).csv(paths["csv"], header=True), "parquet": spark.read.parquet(outputs.newest(spark, f"{folder}/analytical_monthly_sales_summary_*.parquet"))}
    fine = store.check_exports(back["parquet"], paths)
    parts = [t.withColumns({"format": F.lit(kind), "consistent": F.lit(fine[kind])}) for kind, t in back.items()]
    return parts[0].unionByName(parts[1])


QUERIES["snk4_exports"] = _exported
ORACLES["snk4_exports"] = f"WITH {SALES}, m AS ({MONTHLY}) SELECT *, true AS consistent FROM m, (VALUES ('csv'), ('parquet')) AS f(format)"


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """Two versions of the customers by segment: the last one, and how many there are; the same out of a cache."""
    c, folder = _t(spark, d, "customer"), _folder(spark, "versions")
    v, cache = store.Versions(spark, f"{folder}/v"), store.Cache(spark, f"{folder}/c")
    v.create(c.limit(1).groupBy("c_mktsegment").count(), "segments")
    v.create(c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers")), "segments", "all")
    cache.put(v.latest("segments"), "segments", {"of": "all"})
    return cache.get("segments", {"of": "all"}).withColumn("versions", F.lit(len(v.list("segments"))).cast("long"))


QUERIES["snk6_versions_and_cache"] = _versions
ORACLES["snk6_versions_and_cache"] = "SELECT c_mktsegment, count(*) AS customers, 2::BIGINT AS versions FROM customer GROUP BY 1"


def _reports(spark: SparkSession, d: str) -> DataFrame:
    """The rules' results out of the written validation report."""
    folder = _folder(spark, "reports")
    outputs.write_validation_reports(sales(spark, d), folder)
    found = outputs.validation_report(spark, folder)
    rows = [(r["rule_name"], r["field"], r["severity"], r["total_records"], r["valid_records"], r["error_rate"], r["passed"]) for r in found["rules"]]  # a row per rule
    return spark.createDataFrame(rows, "rule_name string, field string, severity string, total_records bigint, valid_records bigint, error_rate double, passed boolean")


QUERIES["dsh13_validation_report"] = _reports
ORACLES["dsh13_validation_report"] = f"WITH {SALES}, {_RESULTS} SELECT * FROM results"


#: Rows of a file that is streamed, some 60 MB of CSV.
_ROWS = 500_000


def _streamed(spark: SparkSession, d: str, rows: int = _ROWS) -> DataFrame:
    """The monthly table as a stream of CSV files keeps it up, in two batches; a row that comes twice counts once. The number
    of files follows that of the lines."""
    folder, parts = _folder(spark, "stream"), max(2, -(-_t(spark, d, "lineitem").count() // rows))
    raw = sales(spark, d).withColumn("sale_date", F.date_format("sale_date", "yyyy-MM-dd HH:mm:ss")).select(*RAW_COLUMNS)
    raw.repartition(parts, "order_id").write.csv(f"{folder}/in", header=True)
    keep_monthly(spark, f"{folder}/in", f"{folder}/store", f"{folder}/checkpoint", -(-parts // 2)).awaitTermination()
    return MonthlyStore(spark, f"{folder}/store").table()


QUERIES["stream_monthly"] = _streamed
ORACLES["stream_monthly"] = f"""WITH {SALES}, u AS (SELECT DISTINCT {', '.join(RAW_COLUMNS)} FROM sales), x AS (SELECT *, quantity * unit_price * (1 - discount_percent) AS revenue FROM u),
    m AS (SELECT strftime(sale_date, '%Y-%m') AS month, {_r(_s('revenue'))} AS total_revenue, count(revenue) AS transaction_count, sum(quantity)::BIGINT AS total_quantity, {_r(_a('discount_percent'))} AS avg_discount, count(DISTINCT order_id) AS unique_orders FROM x GROUP BY 1)
    SELECT *, {_r('total_revenue / nullif(unique_orders, 0)')} AS avg_order_value FROM m"""

# Dashboards that had no query
QUERIES["dsh5_market_share"] = lambda spark, d: _shares(sales(spark, d))
ORACLES["dsh5_market_share"] = f"WITH {SALES}, {REGIONS} SELECT region, market_share_pct FROM regions"
QUERIES["dsh6_first_products"] = lambda spark, d: dashboards.first_rows(tables.dashboard_products(sales(spark, d)).select("product_name", "total_revenue"), "total_revenue", 3)
ORACLES["dsh6_first_products"] = f"WITH {SALES} SELECT product_name, {_r(_s('revenue'))} AS total_revenue FROM sales GROUP BY 1 ORDER BY total_revenue DESC, product_name LIMIT 5"


def _shares(s: DataFrame) -> DataFrame:
    bare = dashboards.dashboard_regions(s).drop("market_share_pct")
    return dashboards.with_market_share(bare).select("region", half_even(F.col("market_share_pct"), 4).alias("market_share_pct"))
