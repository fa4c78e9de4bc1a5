"""Isolation Forest: trees of random splits, in which points that stand apart end early.

The trees are grown on the driver from a bounded sample and sent to the tasks: TREES * 511 nodes, however large the
table. Rows are scored in one pass, and the threshold is an exact quantile of their scores.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.quantiles import quantiles, value_counts
from ..functions.written import written

TREES, SAMPLE, SEED = 100, 256, 42
SCORE, FLAG = "isolation_forest_score", "isolation_forest_anomaly"
#: Low bits of a row's hash that say how early it is sampled.
_BITS = 40


def mean_path(n) -> np.ndarray:
    """Mean length of an unsuccessful search in a binary search tree of n points."""
    n = np.asarray(n, float)
    many = np.maximum(n, 3)
    return np.select([n <= 1, n == 2], [0.0, 1.0], 2 * (np.log(many - 1) + np.euler_gamma) - 2 * (many - 1) / many)


def grown(points: np.ndarray, tree: int, seed: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, threshold, path) by node; the children of node i are 2i + 1 and 2i + 2, a leaf has feature -1 and the
    path length of a point that ends there. A node's split depends on seed, tree and node only: a feature that isn't
    constant in it, and a threshold between that feature's least and largest value."""
    nodes = (2 << depth) - 1
    feature, threshold, path = np.full(nodes, -1, np.int16), np.zeros(nodes), np.zeros(nodes)
    todo = [(0, 0, points)]
    while todo:
        node, level, own = todo.pop()
        lo, hi = own.min(0), own.max(0)
        free = np.flatnonzero(hi > lo)
        if level == depth or not len(free):
            path[node] = level + mean_path(len(own))
            continue
        u, v = np.random.default_rng([seed, tree, node]).random(2)
        f = free[int(u * len(free))]
        at = lo[f] + v * (hi[f] - lo[f])
        feature[node], threshold[node] = f, at if at < hi[f] else lo[f]
        right = own[:, f] > threshold[node]
        todo += [(2 * node + 1, level + 1, own[~right]), (2 * node + 2, level + 1, own[right])]
    return feature, threshold, path


def path_lengths(points: np.ndarray, forest: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Mean over the trees, of finite points. All points go down to the last level: below a leaf they keep to the left, where the
    leaf's path length is found again. A node costs a few gathers from arrays that stay in the processor's cache."""
    total, n = np.zeros(len(points)), len(points)
    flat, rows = np.ascontiguousarray(points.T).ravel(), np.arange(n)
    for feature, threshold, path in zip(*forest, strict=True):
        at, levels = np.zeros(n, np.intp), len(path).bit_length() - 1
        path, threshold, start = path.copy(), np.where(feature < 0, np.inf, threshold), np.maximum(feature, 0).astype(np.intp) * n
        for i in np.flatnonzero(feature[: len(path) // 2] < 0):  # parents come first
            path[2 * i + 1] = path[i]
        for _ in range(levels):
            right = flat.take(start.take(at) + rows) > threshold.take(at)
            at += at
            at += 1
            at += right
        total += path.take(at)
    return total / len(forest[0])


def _number(df: DataFrame, name: str) -> Column:
    """A finite double, else null."""
    x = F.col(f"`{name}`").try_cast("double")
    return F.when(F.abs(x) < float("inf"), x)  # NaN counts as larger


def _pool(rows: DataFrame, size: int) -> np.ndarray:
    """(hash, features) of the ``size`` distinct rows with the lowest hashes, or of all if there are fewer. Hashes bound
    the rows that are looked at to a few times ``size``, more if many rows are equal."""
    n, share, low = rows.count(), 0.0, F.col("h").bitwiseAND((1 << _BITS) - 1)
    while n and share < 1:
        share = min(1.0, max(8 * share, 4 * size / n))
        few = rows.filter(low < int(share * (1 << _BITS))).distinct()
        found = few.orderBy(low, *few.columns).limit(size).toPandas()
        if len(found) == size:
            break
    return found if n else None


def forest_of(df: DataFrame, features: list[str], trees: int = TREES, sample: int = SAMPLE, seed: int = SEED):
    """((feature, threshold, path), points of a tree), grown from at most trees * sample rows; None without complete rows.

    A row is sampled by a hash of all its columns (but maps), so equal rows count once, and the same table gives the same
    trees however it is partitioned.
    """
    keys = [F.col(f"`{f.name}`") for f in df.schema if not any(k in f.dataType.simpleString() for k in ("map<", "variant", "interval"))]
    xs = [_number(df, c).alias(f"x{i}") for i, c in enumerate(features)]
    found = _pool(df.select(F.xxhash64(*keys).alias("h"), *xs).dropna(), trees * sample)
    if found is None:
        return None
    h, points, size = found["h"].to_numpy(np.int64).view(np.uint64), found.drop(columns="h").to_numpy(float), min(sample, len(found))
    depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
    out = []
    for t in range(trees):
        z = (h + np.uint64(t)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(grown(points[np.argsort(z ^ (z >> np.uint64(32)), kind="stable")[:size]], t, seed, depth))
    return tuple(np.stack(x) for x in zip(*out, strict=True)), size


def isolation_forest(df: DataFrame, features: list[str], contamination: float = 0.1, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """df with isolation_forest_anomaly and isolation_forest_score: the lower, the odder; below 0 it is an anomaly, as is
    a share of ``contamination`` of the complete rows. contamination: see anomalies.PRESETS.

    Rows with a feature that is null or no finite number are no anomalies and have score 0.0. Features that aren't there
    raise. Splits lie between a feature's least and largest value in a node, so scaling wouldn't change a tree. With
    all points equal, every score is 0.0. The rows are written once, as sampling goes over them twice before they are
    scored, and the scored rows once, as the threshold reads them before the result.
    """
    if missing := [c for c in features if c not in df.columns]:
        raise ValueError(f"Missing features: {missing}")
    spark, df = df.sparkSession, written(df, "rows")
    grew = forest_of(df, features, trees, sample, seed)
    if grew is None:
        return df.withColumns({FLAG: F.lit(False), SCORE: F.lit(0.0)})
    nodes, whole = spark.sparkContext.broadcast(grew[0]), float(mean_path(grew[1])) or 1.0

    @F.pandas_udf("double")
    def raw(*columns: pd.Series) -> pd.Series:
        points = np.stack([c.to_numpy(float) for c in columns], 1)
        fine = ~np.isnan(points).any(1)
        out = np.full(len(points), np.nan)
        out[fine] = -(2.0 ** (-path_lengths(points[fine], nodes.value) / whole))
        return pd.Series(out).astype("object").where(fine, None)

    xs = [_number(df, c) for c in features]
    complete = reduce(lambda a, b: a & b, (x.isNotNull() for x in xs))
    scored = written(df.withColumn("_raw", F.when(complete, raw(*xs))), "forest")
    limit = quantiles(value_counts(scored, raw=F.col("_raw")), (contamination,)).select(F.col("q")[0].alias("_limit"))  # one row
    score = F.coalesce(F.col("_raw") - F.col("_limit"), F.lit(0.0))
    return scored.crossJoin(F.broadcast(limit)).withColumns({FLAG: score < 0, SCORE: score}).drop("_raw", "_limit")
