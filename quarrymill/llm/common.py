"""Shared helpers: the shared folder, written intermediate tables and Arrow batch bounds."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes of one Arrow batch sent to a Python worker; a single longer row still travels alone.
ARROW_BATCH_BYTES = 8 << 20
#: A side is broadcast only if its written files are no larger than this.
BROADCAST_FILE_BYTES = 4 << 20

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the cluster names none (local tests) a temporary folder of our own is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="quarrymill-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return "file://" + _own["dir"]


class Scratch:
    """Intermediate tables of one operator call, written to the shared folder.

    A written table cuts the lineage and survives lost executors. Tables that are no longer needed are dropped
    as soon as possible; those that a returned DataFrame still reads stay until the folder is cleared.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.base}/{self._n:03d}-{name}"

    def write(self, df: DataFrame, name: str, codec: str = "snappy") -> str:
        path = self.path(name)
        df.write.option("compression", codec).parquet(path)
        return path

    def table(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        return self.spark.read.schema(df.schema).parquet(self.write(df, name, codec))

    def _hadoop(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def size(self, path: str) -> int:
        fs, p = self._hadoop(path)
        return fs.getContentSummary(p).getLength()

    def drop(self, path: str) -> None:
        fs, p = self._hadoop(path)
        fs.delete(p, True)

    def small(self, path: str, limit: int = BROADCAST_FILE_BYTES) -> bool:
        return self.size(path) <= limit


def bound_arrow(spark: SparkSession, limit: int = ARROW_BATCH_BYTES) -> None:
    """Bounds Arrow batches by bytes, so that long texts can't pile up in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(limit))


def named(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns as a struct, whatever their names; own() takes them out again."""
    return F.struct(*(named(c).alias(c) for c in df.columns))


def own(row: str, names: list[str]) -> list[Column]:
    """The columns that whole_row() has put under the name ``row``."""
    return [F.col(row)[c].alias(c) for c in names]


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
