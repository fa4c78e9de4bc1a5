"""What a batch left behind, found again: the newest files of a name, tables from the first source that has them,
merged validation reports, a cache with an age, and exports with a version."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import operations, reports, validation
from .files import export
from .store import Cache, Checkpoints, Folder, Lineage, Versions, check_exports, checksums


def newest(spark: SparkSession, pattern: str) -> str | None:
    """The path that matches a glob and was changed last, ties by name; manifests and hidden files don't count."""
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(p) or []
    named = [(f.getModificationTime(), f.getPath().getName(), f.getPath().toString()) for f in found]
    named = [n for n in named if not n[1].endswith(".manifest") and not n[1].startswith((".", "_"))]
    return max(named)[2] if named else None


def load(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, or CSV with a header whose types are inferred."""
    return spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True, inferSchema=True)


def load_newest(spark: SparkSession, pattern: str) -> DataFrame | None:
    path = newest(spark, pattern)
    return load(spark, path) if path else None


def resolve(spark: SparkSession, folder: str, names: Iterable[str], derive: Callable[[DataFrame], dict[str, DataFrame]] | None = None, processed: str | None = None) -> dict[str, tuple[str, DataFrame | None]]:
    """By name, the source and the table: the newest stamped export (CSV, then Parquet), then <name>.csv or .parquet, then
    what derive makes of the newest rows that match processed. ("missing", None) if there is none; nothing is made up."""
    out: dict[str, tuple[str, DataFrame | None]] = {}
    for n in names:
        for pattern in (f"analytical_{n}_*.csv", f"analytical_{n}_*.parquet", f"{n}.csv", f"{n}.parquet"):
            if path := newest(spark, f"{folder}/{pattern}"):
                out[n] = (path, load(spark, path))
                break
        else:
            out[n] = ("missing", None)
    missing = [n for n, (source, _) in out.items() if source == "missing"]
    rows = load_newest(spark, processed) if missing and derive and processed else None
    if rows is not None:
        made = derive(rows)
        out |= {n: ("derived", made[n]) for n in missing if n in made}
    return out


def validation_report(spark: SparkSession, folder: str) -> dict:
    """The newest report, error and debug JSON of a folder, merged; of equal keys the debug file's hold. None: {}."""
    out: dict = {}
    for pattern in ("validation_report_*.json", "validation_errors_*.json", "validation_debug_report_*.json"):
        if path := newest(spark, f"{folder}/{pattern}"):
            out |= json.loads(spark.read.text(path, wholetext=True).first().value)
    return out


def write_validation_reports(df: DataFrame, folder: str, rules: Iterable[validation.Rule] = validation.DEFAULT_RULES, values: int = 10, stamp: str | None = None) -> dict[str, str]:
    """Runs the rules and writes what validation_report() reads: the report (status, quality score, rules, fields), the
    errors (failed rules with up to ``values`` distinct values each, numbers by type, advice) and the debug report (schema,
    rules that couldn't be evaluated). Returns their paths. A row per rule, or per value, comes to the driver."""
    spark, rules = df.sparkSession, tuple(rules)
    stamp, target = time.strftime("%Y%m%d_%H%M%S") if stamp is None else stamp, Folder(spark, folder)
    rows = lambda d: [r.asDict(recursive=True) for r in d.collect()]
    found = validation.validate_isolated(df, rules)
    broken = {r["rule_name"]: r["error"] for r in found.filter("error IS NOT NULL").collect()}
    sound = tuple(r for r in rules if r.name not in broken)
    results, problems = found.drop("error"), validation.problematic_values(df, sound, values)
    kinds = validation.error_distribution(results, rules)
    state = rows(validation.status(results))[0]
    report = state | {"generated": stamp, "rules": sorted(rows(results), key=lambda r: r["rule_name"]), "fields": sorted(rows(validation.by_field(results)), key=lambda r: r["field"])}
    errors = {"errors": sorted(rows(validation.error_report(results, problems, rules)), key=lambda r: r["rule_name"]), "error_types": {r.error_type: r.rules for r in kinds.collect()}, "advice": sorted(rows(reports.error_advice(kinds)), key=str)}
    debug = {"schema": dict(df.dtypes), "skipped_rules": sorted(r.name for r in rules if not r.enabled or r.field not in df.columns), "rule_errors": broken}
    names = {"report": f"validation_report_{stamp}.json", "errors": f"validation_errors_{stamp}.json", "debug": f"validation_debug_report_{stamp}.json"}
    for kind, value in (("report", report), ("errors", errors), ("debug", debug)):
        target.write_json(names[kind], value)
    return {kind: f"{target.base}/{name}" for kind, name in names.items()}


def save_check_report(original: DataFrame, exports: dict[str, str], folder: str, stamp: str | None = None) -> str:
    """Checks exports against the rows they are of, and writes export_check_<stamp>.json: by format, the path, whether all
    rows are there, files and bytes. Returns its path."""
    stamp, target = time.strftime("%Y%m%d_%H%M%S") if stamp is None else stamp, Folder(original.sparkSession, folder)
    fine, found = check_exports(original, exports), {}
    for kind, path in exports.items():
        sums = checksums(original.sparkSession, path).agg({"length": "sum", "path": "count"}).first()
        found[kind] = {"path": path, "consistent": fine[kind], "files": sums["count(path)"], "bytes": sums["sum(length)"] or 0}
    target.write_json(f"export_check_{stamp}.json", {"generated": stamp, "passed": all(fine.values()), "exports": found})
    return f"{target.base}/export_check_{stamp}.json"


def save_error_report(errors: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], folder: str, stamp: str | None = None, last: int = 1000) -> str:
    """Writes error_report_<stamp>.json: errors by ``keys``, and the ``last`` ones in the order given. Returns its path."""
    stamp, target = time.strftime("%Y%m%d_%H%M%S") if stamp is None else stamp, Folder(errors.sparkSession, folder)
    counts = [json.loads(x) for x in operations.error_summary(errors, *keys).toJSON().collect()]
    recent = [json.loads(x) for x in errors.orderBy(*(F.col(c).desc() for c in order)).limit(last).toJSON().collect()]
    target.write_json(f"error_report_{stamp}.json", {"generated": stamp, "counts": sorted(counts, key=str), "recent": recent})
    return f"{target.base}/error_report_{stamp}.json"


class Fresh:
    """Values by key that are made anew when they are older than max_age seconds. Tables are kept as plans, not rows."""

    def __init__(self, max_age: float = 300.0, clock: Callable[[], float] = time.time):
        self.max_age, self.clock, self.kept = max_age, clock, {}

    def get(self, key: str, make: Callable):
        if key not in self.kept or self.age(key) > self.max_age:
            self.kept[key] = (self.clock(), make())
        return self.kept[key][1]

    def age(self, key: str) -> float | None:
        """Seconds since the value was made; None if there is none."""
        return self.clock() - self.kept[key][0] if key in self.kept else None

    def refresh(self, *keys: str) -> None:
        """Forgets the keys, all by default."""
        for k in keys or tuple(self.kept):
            self.kept.pop(k, None)


class Persistence:
    """Versions, cache, checkpoints and lineage under one folder."""

    def __init__(self, spark: SparkSession, base: str):
        self.versions, self.cache = Versions(spark, f"{base}/versions"), Cache(spark, f"{base}/cache")
        self.checkpoints, self.lineage, self.exports = Checkpoints(spark, f"{base}/checkpoints"), Lineage(spark, f"{base}/lineage"), f"{base}/exports"

    def export_dataset(self, df: DataFrame, name: str, formats=("csv", "parquet"), description: str = "") -> dict:
        """Exports, checks the exports and adds a version, computing df once; says where all of them are."""
        version = self.versions.create(df, name, description)
        rows = self.versions.load(version["key"])
        paths = export(rows, self.exports, name, formats)
        self.lineage.track("export", [version["key"]], list(paths.values()), description=description)
        return {"version": version["key"], "paths": paths, "consistent": check_exports(rows, paths)}

    def status(self) -> dict:
        """Entries and bytes of each part."""
        parts = {"versions": self.versions, "cache": self.cache, "checkpoints": self.checkpoints}
        return {n: {"entries": len(e), "bytes": sum(x["bytes"] for x in e)} for n, p in parts.items() for e in [p.read_json()]}
