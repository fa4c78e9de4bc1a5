import hashlib
import math
import random

import numpy as np
import pytest

from quarrymill.llm import kdtree

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v double, cluster string, tree int"


def vectors(n, dims, seed, spread):
    r = random.Random(seed)
    middles = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    return [(i, [float(np.float32(x + r.gauss(0, spread))) for x in r.choice(middles)]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 0.5, "y", 2) for i, v in rows], SCHEMA)


def brute(rows, k, rounds, dims):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(64 * x) < kdtree.LIMIT for x in v)]
    by = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [list(v) for _, v in by[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    sums = {j: sum(d for _, d, o in found if o == j) for j in range(len(centroids))}
    return sorted(((i, j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in found), key=repr)


ODD = [(900, None), (901, []), (902, [0.5] * 3), (903, [0.5, None, 0.5, 0.5]), (904, [float("nan")] * 4), (905, [float("inf"), 0.0, 0.0, 0.0]), (906, [1e30, 0.0, 0.0, 0.0]), (None, [0.25, 0.5, -0.75, 1.0]), (None, [0.25, 0.5, -0.75, 1.0]), (7, [0.125, 0.25, 0.5, 0.375])]


@pytest.mark.parametrize(("rows", "k"), [(vectors(700, 4, 1, 0.05) + ODD, 6), (vectors(90, 4, 2, 3.0) + [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(1000, 1400)], 16), (ODD, 16), ([(i, [0.0, 0.0, 0.0, 1.0]) for i in range(200)], 3)])
def test_by_brute_force(spark, rows, k):
    got = kdtree.clustered(frame(spark, rows).repartition(3), k=k, dims=4)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, k, 3, 4)


def test_empty(spark):
    assert kdtree.clustered(frame(spark, [])).collect() == []
    assert kdtree.clustered(frame(spark, ODD)).collect() == []


def test_trees_prune_without_losing_ties():
    r = np.random.default_rng(3)
    points = r.integers(-9, 9, (4000, 3)).astype(np.int16)  # many equal distances
    tree, order = kdtree.Tree.build(points)
    assert (tree.points == points[order]).all()
    again = kdtree.Tree.unpacked(tree.packed())
    centroids = np.array([[0, 0, 0], [1, 1, 1], [0, 0, 0], [-5, 5, 3], [40, 40, 40]], np.int64)
    seen, whole = 0, 0
    want = ((points[order][:, None].astype(np.int64) - centroids) ** 2).sum(2)
    for node, a, b, some in again.parts(centroids):
        assert (again.sums[node] == points[order][a:b].sum(0)).all()
        own, d = again.nearest(a, b, some, centroids)
        assert (own == want[a:b].argmin(1)).all() and (d == want[a:b].min(1)).all() and 4 not in some
        seen, whole = seen + b - a, whole + (len(some) == 1)
    assert seen == 4000 and whole > 10
