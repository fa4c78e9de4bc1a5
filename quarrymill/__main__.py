"""The batch from the command line: python -m quarrymill --input FILE... --output FOLDER."""

from __future__ import annotations

import argparse
import json
import logging
import tomllib

from pyspark.sql import SparkSession

from .functions.cleaning import clean, typed, with_revenue
from .operators import validation
from .plans import logs
from .plans.pipeline import TABLES, analytical_tables
from .sources import files, outputs

STAGES = ("clean", "validate", "tables", "export")
#: Options that a configuration may set; what the command line says goes first.
CONFIGURABLE = {"input": list, "output": str, "skip_stages": list, "log_level": str, "log_file": str, "anomaly_threshold": float, "formats": list}
DEFAULTS = {"output": "output", "skip_stages": [], "log_level": "WARN", "log_file": None, "anomaly_threshold": 3.0, "formats": ["csv", "parquet"]}
log = logging.getLogger(__name__)


def read_config(path: str) -> dict:
    """A TOML or JSON file of options. Unknown options, or values of another kind, raise ValueError."""
    with open(path, "rb") as f:
        found = tomllib.load(f) if path.endswith(".toml") else json.load(f)
    for k, v in found.items():
        if k not in CONFIGURABLE:
            raise ValueError(f"unknown option: {k}")
        if CONFIGURABLE[k] is float and isinstance(v, int):
            found[k] = v = float(v)
        if not isinstance(v, CONFIGURABLE[k]):
            raise ValueError(f"{k} must be {CONFIGURABLE[k].__name__}")
    if wrong := set(found.get("skip_stages", [])) - set(STAGES):
        raise ValueError(f"unknown stages: {sorted(wrong)}")
    if wrong := set(found.get("formats", [])) - {"csv", "parquet"}:
        raise ValueError(f"unknown formats: {sorted(wrong)}")
    return found


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="quarrymill")
    p.add_argument("--input", nargs="+", help="CSV files or folders of sales")
    p.add_argument("--output", help="folder of the exports")
    p.add_argument("--config", help="TOML or JSON file of options")
    p.add_argument("--skip-stages", nargs="*", choices=STAGES)
    p.add_argument("--log-level", choices=("DEBUG", "INFO", "WARN", "ERROR"))
    p.add_argument("--dry-run", action="store_true", help="check the input and say what would be done")
    p.add_argument("--status-only", action="store_true", help="say what the last batch has left in the output folder")
    a = p.parse_args(args)
    given = read_config(a.config) if a.config else {}
    for k in CONFIGURABLE:
        if getattr(a, k, None) is None:
            setattr(a, k, given.get(k, DEFAULTS.get(k)))
    if not a.input and not a.status_only:
        p.error("--input is missing")
    return a


def status(spark: SparkSession, folder: str) -> dict:
    """Where the newest export of each table is, and how the last validation ended; null where there is none."""
    found = outputs.resolve(spark, folder, TABLES)
    report = outputs.validation_report(spark, folder)
    return {"tables": {n: source if df is not None else None for n, (source, df) in found.items()}, "validation": {k: report[k] for k in ("status", "failed_rules", "quality_score", "generated") if k in report} or None}


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    """What was checked, validated and exported; also printed as JSON.

    A file that can't be read is left out; without any, nothing is done. Without "clean", numbers and dates are read as
    they stand and the rules see the raw text. A rule that fails on some row fails alone.
    """
    a = arguments(args)
    spark = spark or SparkSession.builder.appName("quarrymill").getOrCreate()
    spark.sparkContext.setLogLevel(a.log_level)
    logs.set_up({"WARN": "WARNING"}.get(a.log_level, a.log_level), a.log_file)
    out: dict = {"stages": [s for s in STAGES if s not in a.skip_stages]}
    if a.status_only:
        out = status(spark, a.output)
    else:
        out["input"] = {path: files.check_file(spark, path)[1] for path in a.input}
        fine = [path for path, said in out["input"].items() if said == "ok"]
        if fine and not a.dry_run:
            out |= _run(spark, a, fine, out["stages"])
    print(json.dumps(out, default=str))
    return out


def _run(spark: SparkSession, a: argparse.Namespace, paths: list[str], stages: list[str]) -> dict:
    out: dict = {}
    got = files.ingest(spark, paths)
    rows = clean(got.rows) if "clean" in stages else got.rows
    rows = (with_revenue(rows) if "clean" in stages else rows).persist()
    try:
        if "validate" in stages:
            found = validation.validate_isolated(rows)
            out["validation"] = validation.status(found).first().asDict()
            out["reports"] = outputs.write_validation_reports(rows, a.output)
            log.info("validated", extra={"topic": "quality"} | out["validation"])
        d = rows if "clean" in stages else with_revenue(typed(rows))
        tables = analytical_tables(d, a.anomaly_threshold) if "tables" in stages else {"sales": d}
        if "export" in stages:
            out["exports"] = files.export_tables(tables, a.output, formats=tuple(a.formats))
        else:
            rows.count()
        out["ingestion"] = got.stats()
        log.info("ended", extra={"topic": "processing", "rows": out["ingestion"]["rows"]})
    finally:
        rows.unpersist()
    return out


if __name__ == "__main__":
    main()
