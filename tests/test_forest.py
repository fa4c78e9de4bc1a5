import math
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.operators import anomalies, forest


def frame(spark, n, seed=1):
    r = random.Random(seed)
    rows = [(i, r.gauss(10, 2), r.gauss(0, 1), r.choice([1, 2, 3])) for i in range(n)] + [(1000 + i, 60.0 + i, 9.0, 40) for i in range(3)]
    rows += [(2000, None, 1.0, 1), (2001, float("nan"), 1.0, 1), (2002, 1.0, float("inf"), 1), (2003, 10.0, 0.0, None)]
    return spark.createDataFrame(rows, "id int, a double, b double, c int")


def brute(df, contamination, trees, sample):
    """Every tree grown by recursion, every row walked down every tree, the quantile by sorting."""
    rows = [r for r in df.withColumn("h", F.xxhash64("id", "a", "b", "c")).collect() if all(r[c] is not None and math.isfinite(r[c]) for c in "abc")]
    pool = sorted({(r.h, float(r.a), float(r.b), float(r.c)) for r in rows}, key=lambda x: ((x[0] & ((1 << 40) - 1)), *x))[: trees * sample]
    size, mask = min(sample, len(pool)), (1 << 64) - 1
    depth = max(1, math.ceil(math.log2(max(size, 2))))

    def c(n):
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n

    def grow(points, tree, node, level):
        free = [f for f in range(3) if max(p[f] for p in points) > min(p[f] for p in points)]
        if level == depth or not free:
            return level + c(len(points))
        u, v = np.random.default_rng([42, tree, node]).random(2)
        f = free[int(u * len(free))]
        lo, hi = min(p[f] for p in points), max(p[f] for p in points)
        cut = lo + v * (hi - lo)
        sides = [[p for p in points if (p[f] > cut) == side] for side in (False, True)]
        return f, cut, grow(sides[0], tree, 2 * node + 1, level + 1), grow(sides[1], tree, 2 * node + 2, level + 1)

    def mix(h, t):
        z = ((h & mask) + t) * 0x9E3779B97F4A7C15 & mask
        z = (z ^ (z >> 29)) * 0xBF58476D1CE4E5B9 & mask
        return z ^ (z >> 32)

    grown = [grow([p[1:] for p in sorted(pool, key=lambda p, t=t: mix(p[0], t))[:size]], t, 0, 0) for t in range(trees)]

    def walk(node, p):
        while isinstance(node, tuple):
            node = node[3] if p[node[0]] > node[1] else node[2]
        return node

    raw = {r.id: -(2 ** (-(sum(walk(g, (r.a, r.b, r.c)) for g in grown) / trees) / c(size))) for r in rows}
    at = (len(raw) - 1) * contamination
    s = sorted(raw.values())
    limit = s[math.floor(at)] + (s[math.ceil(at)] - s[math.floor(at)]) * (at - math.floor(at))
    return {r.id: raw[r.id] - limit if r.id in raw else 0.0 for r in df.collect()}


@pytest.mark.parametrize(("n", "trees", "sample"), [(300, 12, 16), (40, 8, 256)])
def test_by_brute_force(spark, n, trees, sample):
    df = frame(spark, n)
    got = {r.id: r for r in forest.isolation_forest(df.repartition(3), ["a", "b", "c"], 0.05, trees, sample).collect()}
    want = brute(df, 0.05, trees, sample)
    assert set(got) == set(want)
    for i, w in want.items():
        assert got[i][forest.SCORE] == pytest.approx(w, abs=1e-9) and (got[i][forest.FLAG] == (w < 0) or abs(w) < 1e-9)
    assert all(got[1000 + i][forest.FLAG] for i in range(3)) and not any(got[i][forest.FLAG] for i in (2000, 2001, 2002, 2003))


def test_share_of_anomalies_and_odd_tables(spark):
    df = frame(spark, 2000)
    share = anomalies.PRESETS["high"].contamination
    n = forest.isolation_forest(df, ["a", "b"], share).filter(forest.FLAG).count()
    assert abs(n / 2003 - share) < 0.002
    with pytest.raises(ValueError, match="Missing features"):
        forest.isolation_forest(df, ["a", "gone"])
    empty = forest.isolation_forest(df.filter("a IS NULL"), ["a", "b"])
    assert [(r[forest.FLAG], r[forest.SCORE]) for r in empty.collect()] == [(False, 0.0)]
    same = spark.createDataFrame([(1.0, 2.0)] * 5, "a double, b double")
    assert {(r[forest.FLAG], r[forest.SCORE]) for r in forest.isolation_forest(same, ["a", "b"]).collect()} == {(False, 0.0)}
    assert forest.isolation_forest(same.limit(0), ["a"]).isEmpty()


def test_rows_are_computed_once(spark, tmp_path):
    def noted(rows):
        for batch in rows:
            (tmp_path / uuid.uuid4().hex).write_text(str(len(batch)))
            yield batch

    df = frame(spark, 60).mapInPandas(noted, "id int, a double, b double, c double")
    assert forest.isolation_forest(df, ["a", "b"], 0.1, 4, 16).count() == 67
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) == 67


def test_leaves_at_any_depth():
    r = np.random.default_rng(3)
    points = np.round(r.normal(size=(200, 3)), 1)
    points[:120] = points[0]  # early leaves
    trees = [forest.grown(points[r.permutation(200)[:64]], t, 1, 6) for t in range(9)]

    def walk(tree, p):
        feature, threshold, path = tree
        i = 0
        while feature[i] >= 0:
            i = 2 * i + 1 + int(p[feature[i]] > threshold[i])
        return path[i]

    got = forest.path_lengths(points, tuple(np.stack(x) for x in zip(*trees, strict=True)))
    assert got.tolist() == [sum((walk(t, p) for t in trees), 0.0) / 9 for p in points]
