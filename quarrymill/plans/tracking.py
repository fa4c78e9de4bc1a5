"""What operations took and how they ended, and what to do when they fail. Kept on the driver: a row per operation."""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..operators.validation import DEFAULT_RULES, validate

SCHEMA = "operation string, status string, records bigint, duration double, message string"


class Tracker:
    """Operations of a run. table() feeds operations.processing_summary()."""

    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self.clock, self.rows = clock, []

    @contextmanager
    def track(self, operation: str):
        """Yields a dict whose "records" the operation may set. An error is recorded and raised again."""
        facts, began, status, message = {"records": 0}, self.clock(), "completed", None
        try:
            yield facts
        except BaseException as e:
            status, message = "failed", f"{type(e).__name__}: {e}"[:500]
            raise
        finally:
            self.rows.append((operation, status, int(facts["records"]), float(self.clock() - began), message))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, SCHEMA)

    def stats(self) -> dict:
        """Operations, records of completed ones, errors, success as a share; nothing done is a share of 0."""
        failed = [r for r in self.rows if r[1] == "failed"]
        return {"operations": len(self.rows), "records": sum(r[2] for r in self.rows if r[1] == "completed"), "errors": [r[4] for r in failed], "success_rate": (len(self.rows) - len(failed)) / max(len(self.rows), 1)}

    def reset(self) -> None:
        self.rows = []


class Recovery:
    """Strategies by category of error, tried in order: the first result that isn't None is the answer."""

    def __init__(self, strategies: dict[str, list[Callable]] | None = None):
        self.strategies, self.attempts = strategies or {}, []

    def add(self, category: str, strategy: Callable) -> None:
        self.strategies.setdefault(category, []).append(strategy)

    def handle(self, error: Exception, category: str, context: dict | None = None, critical: bool = False):
        """The first strategy's result, else None; a critical error is raised if none helps. A strategy that fails is passed over."""
        for s in self.strategies.get(category, []):
            try:
                result = s(error, context or {})
            except Exception:
                result = None
            self.attempts.append((category, getattr(s, "__name__", "strategy"), result is not None))
            if result is not None:
                return result
        if critical:
            raise error
        return None

    def table(self, spark: SparkSession) -> DataFrame:
        """(category, action, success), as operations.recovery_summary() takes it."""
        return spark.createDataFrame(self.attempts, "category string, action string, success boolean")


def benchmark(work: Callable[[], DataFrame], runs: int = 3) -> dict:
    """Seconds of writing what work() returns to nowhere, each run with a new plan."""
    took = []
    for _ in range(runs):
        began = time.perf_counter()
        work().write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    return {"runs": runs, "best": min(took), "mean": sum(took) / runs, "worst": max(took)}


def rule_timings(df: DataFrame, rules=DEFAULT_RULES) -> DataFrame:
    """(rule_name, seconds) of each rule alone: as many passes as rules, for finding slow ones. validate() needs one."""
    rows = [(r.name, benchmark(lambda r=r: validate(df, (r,)), 1)["best"]) for r in rules if r.enabled and r.field in df.columns]
    return df.sparkSession.createDataFrame(rows, "rule_name string, seconds double")
