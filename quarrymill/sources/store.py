"""Tables kept by name in a folder: versions, a cache with an age and a size limit, checkpoints, lineage.

Rows are Parquet; what is known of them is a log of JSON files, read and written through Hadoop, so any file system that
Spark reads will do. The data files are written first, under a name of their own: a table that the log doesn't name
doesn't exist.

Any number of writers may work on a folder at once. Files of the log are never changed: each has a name that no other
writer can choose, and is renamed to it when it is whole. Removing an entry adds a file that says so. From time to time
a writer gathers the files into one and deletes them; what two writers have gathered twice counts once.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .files import STAMP, consistent, metadata


#: Files of a log from which on it is gathered.
GATHER = 200


class Folder:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _at(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def delete(self, name: str) -> None:
        fs, p = self._at(name)
        fs.delete(p, True)

    def size(self, name: str) -> int:
        fs, p = self._at(name)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def write_json(self, name: str, value: dict) -> None:
        fs, p = self._at(name)
        out = fs.create(p, True)
        try:
            out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        finally:
            out.close()

    def read_json(self, pattern: str | None = None) -> list[dict]:
        """The JSON files of the folder that match; without a pattern, the log's entries, oldest first."""
        if pattern is None:
            return [e for _, e in sorted(self._live(self._files()).items())]
        fs, p = self._at(pattern)
        found = fs.globStatus(p) or []
        if not len(found):
            return []
        return [json.loads(r.value) for r in self.spark.read.text([f.getPath().toString() for f in found], wholetext=True).collect()]

    def _put(self, value: dict) -> str:
        """A new file of the log: hidden until it is whole."""
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        self.write_json(f"log/.{name}.tmp", value)
        fs, p = self._at(f"log/.{name}.tmp")
        if not fs.rename(p, self._at(f"log/{name}.json")[1]):
            raise OSError(f"{self.base}/log/{name}.json can't be written")
        return name

    def _files(self, tries: int = 5) -> dict[str, dict]:
        """The log's files by name. Another writer may gather and delete some of them meanwhile: then they are listed anew."""
        for left in reversed(range(tries)):
            fs, p = self._at("log/*.json")
            paths = [f.getPath().toString() for f in fs.globStatus(p) or []]
            if not paths:
                return {}
            try:
                rows = self.spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name"), "value").collect()
                return {r[0].removesuffix(".json"): json.loads(r[1]) for r in rows}
            except (PySparkException, Py4JJavaError):
                if not left:
                    raise
        return {}

    @staticmethod
    def _live(found: dict[str, dict]) -> dict[str, dict]:
        """Entries by name: added or gathered, and not removed."""
        gone = {x for f in found.values() for x in f.get("gone", [])}
        out = {name: f["entry"] for name, f in found.items() if "entry" in f}
        for f in found.values():
            out |= f.get("gathered", {})
        return {k: v for k, v in out.items() if k not in gone}

    def add(self, entry: dict) -> dict:
        """Adds an entry to the log; gathers the log's files when there are many."""
        self._put({"entry": entry})
        fs, p = self._at("log/*.json")
        if len(fs.globStatus(p) or []) > GATHER:
            self.gather()
        return entry

    def gather(self, keep: float = 24 * 3600.0) -> None:
        """One file in place of those that are there, but for removals of the last ``keep`` seconds: another writer may
        just now gather what they remove."""
        found = self._files()
        young = {n for n, f in found.items() if "gone" in f and time.time() - int(n[:20]) / 1e9 < keep}
        self._put({"gathered": self._live(found)})
        for name in found.keys() - young:
            self.delete(f"log/{name}.json")

    def save(self, df: DataFrame, key: str, **facts) -> dict:
        """Writes the rows, then the entry: facts with key, where the rows are, when and how large."""
        data = f"{key}-{uuid.uuid4().hex}.parquet"
        df.write.parquet(f"{self.base}/{data}")
        return self.add({"created": time.time()} | facts | {"key": key, "data": data, "bytes": self.size(data)})

    def load(self, key: str) -> DataFrame:
        """The rows that were saved last under a key."""
        found = [e for e in self.read_json() if e["key"] == key]
        if not found:
            raise KeyError(key)
        return self.spark.read.parquet(f"{self.base}/{found[-1]['data']}")

    def remove(self, *entries: dict) -> None:
        """Removes entries, and then their rows."""
        gone = [n for n, e in self._live(self._files()).items() if e in entries]
        if gone:
            self._put({"gone": gone})
        for e in entries:
            if "data" in e:
                self.delete(e["data"])


class Versions(Folder):
    """Versions of a dataset, newest first."""

    def create(self, df: DataFrame, name: str, description: str = "") -> dict:
        return self.save(df, f"{name}_{time.time_ns()}_{uuid.uuid4().hex[:8]}", name=name, description=description, metadata=metadata(df))

    def list(self, name: str | None = None) -> list[dict]:
        return sorted((e for e in self.read_json() if name in (None, e["name"])), key=lambda e: e["created"], reverse=True)

    def latest(self, name: str) -> DataFrame | None:
        all_ = self.list(name)
        return self.load(all_[0]["key"]) if all_ else None


class Cache(Folder):
    """Results by identifier and parameters. Entries over max_age seconds don't count; beyond max_bytes the oldest go, down to 80 %."""

    def __init__(self, spark: SparkSession, base: str, max_age: float = 24 * 3600.0, max_bytes: int = 2 << 30):
        super().__init__(spark, base)
        self.max_age, self.max_bytes = max_age, max_bytes

    @staticmethod
    def key(identifier: str, params: dict | None = None) -> str:
        return hashlib.md5((identifier + json.dumps(params or {}, sort_keys=True)).encode()).hexdigest()

    def put(self, df: DataFrame, identifier: str, params: dict | None = None) -> None:
        older = [e for e in self.read_json() if e["key"] == self.key(identifier, params)]
        self.save(df, self.key(identifier, params), identifier=identifier)
        if older:
            self.remove(*older)
        entries = sorted(self.read_json(), key=lambda e: e["created"])
        total = sum(e["bytes"] for e in entries)
        if total > self.max_bytes:
            for e in entries:
                if total <= 0.8 * self.max_bytes:
                    break
                self.remove(e)
                total -= e["bytes"]

    def get(self, identifier: str, params: dict | None = None) -> DataFrame | None:
        found = [e for e in self.read_json() if e["key"] == self.key(identifier, params)]
        return self.spark.read.parquet(f"{self.base}/{found[-1]['data']}") if found and time.time() - found[-1]["created"] <= self.max_age else None


class Checkpoints(Versions):
    """Saved stages of a run."""

    def cleanup(self, keep: int = 5, max_age: float = 48 * 3600.0) -> int:
        """Removes checkpoints that are neither among the last ones nor young; returns how many."""
        old = [e for e in self.list()[keep:] if time.time() - e["created"] > max_age]
        self.remove(*old)
        return len(old)


class Lineage(Folder):
    """Operations with what they read and wrote."""

    def track(self, operation: str, inputs: list[str], outputs: list[str], **facts) -> None:
        self.add(facts | {"key": f"lineage_{time.time_ns()}", "operation": operation, "inputs": inputs, "outputs": outputs})

    def table(self) -> DataFrame:
        rows = [(e["key"], e["operation"], e["inputs"], e["outputs"]) for e in self.read_json()]
        return self.spark.createDataFrame(rows, "key string, operation string, inputs array<string>, outputs array<string>")

    def produced_by(self, dataset: str) -> DataFrame:
        return self.table().filter(F.array_contains("outputs", dataset))

    def consumed_by(self, dataset: str) -> DataFrame:
        return self.table().filter(F.array_contains("inputs", dataset))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, md5) of the files under path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.md5("content").alias("md5"))


def check_exports(original: DataFrame, exports: dict[str, str]) -> dict[str, bool]:
    """By format, whether the written rows are the original ones; CSV is read with the original's types."""
    spark, out = original.sparkSession, {}
    for kind, path in exports.items():
        back = spark.read.parquet(path) if kind == "parquet" else spark.read.schema(original.schema).options(header=True, timestampFormat=STAMP, timestampNTZFormat=STAMP).csv(path)
        out[kind] = consistent(original, back)
    return out


def dashboard_json(tables: dict[str, DataFrame], metrics: DataFrame | None = None, rows: int = 3) -> str:
    """Metrics and, by table, its numbers of rows and columns and its first rows, as JSON."""
    first = {n: {"rows": t.count(), "columns": len(t.columns), "sample": [json.loads(x) for x in t.limit(rows).toJSON().collect()]} for n, t in tables.items()}
    return json.dumps({"metrics": json.loads(metrics.toJSON().first()) if metrics is not None else {}, "tables": first}, sort_keys=True)
