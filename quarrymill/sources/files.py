"""Reading and writing sales files: checked CSV input, versioned exports with manifests."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import logging
import re
import time
from collections.abc import Iterable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from . import records

RAW_COLUMNS = ("order_id", "product_name", "category", "quantity", "unit_price", "discount_percent", "region", "sale_date", "customer_email")
EXTENSIONS = (".csv", ".tsv", ".txt")
ENCODINGS = ("utf-8", "cp1252", "latin-1")
DELIMITERS = ",;\t|"
LARGE = 10 << 30  # bytes from which a file gets a warning
PROBE = 64 << 10  # bytes that are looked at before a file is read
STAMP = "yyyy-MM-dd HH:mm:ss"
log = logging.getLogger(__name__)


def head(spark: SparkSession, path: str, lines: int = 20) -> list[str]:
    return [r.value for r in spark.read.text(path).limit(lines).collect()]


def detect_delimiter(sample: str) -> str:
    """What the sniffer finds, if the header has it, as quoted text may mislead it; else the header's most frequent one of
    DELIMITERS, a comma if it has none."""
    head = re.split(r"[\r\n]", sample, maxsplit=1)[0]
    try:
        found = csv.Sniffer().sniff(sample[:8192], DELIMITERS).delimiter
    except csv.Error:
        found = ""
    return found if found and found in head else max(DELIMITERS, key=head.count)


def _status(spark: SparkSession, path: str):
    """Of a path: its file system, its status; None if there is nothing."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return fs, fs.getFileStatus(p) if fs.exists(p) else None


def _first_bytes(fs, status, size: int = PROBE) -> bytes:
    at = fs.open(status.getPath())
    try:
        return bytes(at.readNBytes(size))
    finally:
        at.close()


def detect_encoding(start: bytes, whole: bool = False) -> str:
    """The first of ENCODINGS that reads the bytes. A character that the end cuts off is no error, unless they are whole."""
    for name in ENCODINGS:
        try:
            start.decode(name)
        except UnicodeDecodeError as e:
            if whole or name != "utf-8" or e.start < len(start) - 3 or e.reason != "unexpected end of data":
                continue
        return name
    return ENCODINGS[-1]


def inspect(spark: SparkSession, path: str, delimiter: str | None = None) -> dict:
    """fine, message, and as far as known: bytes, encoding, delimiter, columns, header (the first record as it stands).
    Looks at the first PROBE bytes alone.

    A folder is not a file; read_sales_csv() takes both. Sizes from LARGE on are only warned of.
    """
    out: dict = {"fine": False}
    if not path.lower().endswith(EXTENSIONS):
        return out | {"message": f"unsupported extension: {path}"}
    try:
        fs, status = _status(spark, path)
        if status is None or status.isDirectory():
            return out | {"message": f"not a file: {path}" if status else f"can't be read: no such file: {path}"}
        start = _first_bytes(fs, status)
    except Exception as e:  # a file system that isn't there, or a file that may not be read
        return out | {"message": f"can't be read: {type(e).__name__}"}
    out |= {"bytes": status.getLen(), "encoding": detect_encoding(start, status.getLen() <= len(start))}
    if out["bytes"] >= LARGE:
        log.warning("%s has %.1f GB", path, out["bytes"] / (1 << 30))
    text = start.decode(out["encoding"], "replace")
    lines = re.split(r"\r\n|\r|\n", text)
    if not lines[0].strip():
        return out | {"message": "no header line"}
    out["delimiter"] = delimiter or detect_delimiter(text)
    record = csv.reader(io.StringIO(text, newline=""), delimiter=out["delimiter"])
    out["columns"] = [c.strip().removeprefix("\ufeff") for c in next(record)]
    out["header"] = "\n".join(lines[: record.line_num]).removeprefix("\ufeff")
    return out | ({"fine": True, "message": "ok"} if any(out["columns"]) else {"message": "no columns in the header"})


def check_file(spark: SparkSession, path: str) -> tuple[bool, str]:
    """(fine, message), before anything is read in full. A folder is judged by its first line."""
    _, status = _status(spark, path) if path.lower().endswith(EXTENSIONS) else (None, None)
    if status is None or not status.isDirectory():
        found = inspect(spark, path)
        return found["fine"], found["message"]
    first = head(spark, path, 1)
    return (True, "ok") if first and first[0].strip() else (False, "no header line")


def estimated_rows(spark: SparkSession, path: str, exact_up_to: int = 100 << 20) -> tuple[int, bool]:
    """(lines without the header, exact): counted for files up to exact_up_to bytes; beyond, bytes by the mean length of
    the lines in the first PROBE bytes. For progress only: quoted line breaks count as lines."""
    fs, status = _status(spark, path)
    if status is None:
        raise FileNotFoundError(path)
    size = fs.getContentSummary(status.getPath()).getLength()
    if size <= exact_up_to or status.isDirectory():
        return max(spark.read.text(path).count() - 1, 0), True
    start = _first_bytes(fs, status)
    return max(size * start.count(b"\n") // len(start) - 1, 0) if b"\n" in start else size // 100, False


def ingestion_stats(read: int, dropped: int, seconds: float) -> dict:
    """Rows a second and success in % of a read; nothing read is no failure."""
    total = read + dropped
    return {"rows": read, "dropped": dropped, "seconds": seconds, "rows_per_second": read / seconds if seconds > 0 else 0.0, "success_rate": 100.0 * read / total if total else 100.0}


def listed(spark: SparkSession, path: str) -> list[str]:
    """The files of a path, a pattern or a folder, in order; hidden ones don't count. The path itself if there are none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out = []
    for status in fs.globStatus(p) or []:
        inner = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        out += [f.getPath().toString() for f in inner if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
    return sorted(out) or [path]


def heads(spark: SparkSession, paths: Iterable[str], delimiter: str | None = None) -> tuple[list[dict], dict[str, str]]:
    """inspect() of each file that is fine, with its path; by path, what is wrong with the others. Some files at a time."""
    files = [f for path in paths for f in listed(spark, path)]

    def look(path: str) -> dict:
        try:
            return inspect(spark, path, delimiter) | {"path": path}
        except (csv.Error, UnicodeError) as e:
            return {"path": path, "fine": False, "message": f"no header can be read: {e}"}

    with ThreadPool(16) as pool:
        found = pool.map(look, files)
    return [f for f in found if f["fine"]], {f["path"]: f["message"] for f in found if not f["fine"]}


def _unique(names: list[str]) -> tuple[str, ...]:
    """Names without repeats: a, a.1, a.2; an empty one is column_<its place>."""
    out: list[str] = []
    for i, n in enumerate(n or f"column_{i}" for i, n in enumerate(names)):
        k = next(k for k in range(i + 1) if (f"{n}.{k}" if k else n) not in out)
        out.append(f"{n}.{k}" if k else n)
    return tuple(out)


class Ingestion:
    """rows: lazy. skipped: by path, why a file is left out. stats(): of the first action on rows, which should read all of them."""

    def __init__(self, rows: DataFrame, skipped: dict[str, str], observed: Observation, columns: list[str]):
        self.rows, self.skipped, self.observed, self.columns, self.began = rows, skipped, observed, columns, time.monotonic()

    def stats(self) -> dict:
        """ingestion_stats(), nulls by column and files that were skipped, counted while rows went by; waits for an action."""
        got = self.observed.get
        seconds = time.monotonic() - self.began
        return ingestion_stats(got["n"] - got["dropped"], got["dropped"], seconds) | {"nulls": {c: got[f"null_{i}"] for i, c in enumerate(self.columns)}, "skipped": self.skipped}


def ingest(spark: SparkSession, paths: str | list[str], delimiter: str | None = None, encoding: str | None = None, with_path: bool = False, breaks: bool | None = None) -> Ingestion:
    """CSV files as rows of text columns, a scan for each kind of file.

    Each file is read by its own head: its columns by name, its delimiter and its encoding, unless these are given. Columns
    that a file hasn't are null. Files that can't be read are left out and named; if none is left, it raises. Records are
    whole, whatever line breaks their quoted fields have, and long files still split: see records. breaks: whether quoted
    line breaks occur; None looks for them, in a pass over the lines with quotes. Records with too few or too many fields
    are dropped and counted; a record that equals its file's header is one. Empty lines don't count.
    """
    found, skipped = heads(spark, [paths] if isinstance(paths, str) else paths, delimiter)
    for path, why in skipped.items():
        log.warning("left out: %s: %s", path, why)
    if not found:
        raise ValueError(f"no file can be read: {skipped}")
    kinds: dict[tuple, list[str]] = {}
    for f in found:
        kinds.setdefault((_unique(f["columns"]), f["delimiter"], encoding or f["encoding"], f["header"]), []).append(f["path"])
    columns = list(dict.fromkeys(c for names, *_ in kinds for c in names))
    bad, source = (next(n for n in (name + "_" * i for i in range(99)) if n not in columns) for name in ("corrupt_record", "source_file"))
    parts = [records.parsed(records.whole(spark, own, sep, code, head, breaks), names, sep, bad, source) for (names, sep, code, head), own in kinds.items()]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    observed = Observation("ingestion")
    rows = rows.observe(observed, F.count(F.lit(1)).alias("n"), F.count(bad).alias("dropped"), *(F.count_if(named(c).isNull() & F.col(bad).isNull()).alias(f"null_{i}") for i, c in enumerate(columns)))
    rows = rows.filter(F.col(bad).isNull()).drop(bad)
    return Ingestion(rows if with_path else rows.drop(source), skipped, observed, columns)


def read_sales_csv(spark: SparkSession, paths: str | list[str], delimiter: str | None = None, encoding: str | None = None, with_path: bool = False) -> DataFrame:
    """The rows of ingest()."""
    return ingest(spark, paths, delimiter, encoding, with_path).rows


def timed_ingestion(spark: SparkSession, path: str, **options) -> tuple[DataFrame, dict]:
    """The rows, and what ingest() counts while they are read once."""
    got = ingest(spark, path, **options)
    got.rows.write.format("noop").mode("overwrite").save()
    return got.rows, got.stats()


def named(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def metadata(df: DataFrame) -> dict:
    """Rows, columns, types, nulls by column, and a digest of these that doesn't depend on the order of rows; one aggregate."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *(F.count_if(named(c).isNull()).alias(f"_{i}") for i, c in enumerate(df.columns))).first()
    out = {"rows": one[0], "columns": df.columns, "dtypes": dict(df.dtypes), "nulls": dict(zip(df.columns, one[1:], strict=True))}
    return out | {"digest": hashlib.md5(json.dumps(out, sort_keys=True).encode()).hexdigest()[:8]}


def export(df: DataFrame, folder: str, name: str, formats=("csv", "parquet"), stamp: str | None = None, skip_empty: bool = False) -> dict[str, str]:
    """Writes <folder>/<name>_<stamp>.<format> and a manifest beside each. Unknown formats are warned of and left out.

    df is computed once: what is written first is read back for the other format and for the manifest. stamp "" writes
    <name>.<format>. skip_empty: a table without rows leaves nothing.
    """
    stamp = time.strftime("%Y%m%d_%H%M%S") if stamp is None else stamp
    for kind in formats:
        if kind not in ("csv", "parquet"):
            log.warning("unknown format: %s", kind)
    kinds = [k for k in ("parquet", "csv") if k in formats]
    if not kinds or (skip_empty and df.isEmpty()):
        return {}
    spark, out, facts = df.sparkSession, {}, None
    for kind in kinds:
        path = f"{folder}/{name}{'_' * bool(stamp)}{stamp}.{kind}"
        w = df.write.mode("overwrite")
        if kind == "csv":
            w.options(header=True, timestampFormat=STAMP, timestampNTZFormat=STAMP).csv(path)
        else:
            w.parquet(path, compression="snappy")
            df = spark.read.schema(df.schema).parquet(path)
        facts = facts or metadata(df if kind == "parquet" else spark.read.schema(df.schema).options(header=True, timestampFormat=STAMP, timestampNTZFormat=STAMP).csv(path))
        manifest = json.dumps(facts | {"path": path, "created": stamp})
        spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.manifest")
        out[kind] = path
    return {k: out[k] for k in formats if k in out}


def export_tables(tables: dict[str, DataFrame], folder: str, stamp: str | None = None, formats=("csv", "parquet")) -> dict[str, dict[str, str]]:
    return {n: export(t, folder, f"analytical_{n}", formats, stamp=stamp) for n, t in tables.items()}


def consistent(a: DataFrame, b: DataFrame) -> bool:
    """Same columns, types and rows, counting repeats."""
    return dict(a.dtypes) == dict(b.dtypes) and a.exceptAll(b.select(*a.columns)).isEmpty() and b.select(*a.columns).exceptAll(a).isEmpty()
