"""Centroid clustering by filtering kd-trees, in integers, so that results don't depend on the order of rows.

Every chunk of a partition's vectors becomes a kd-tree, written once and read in each round. Nodes hold their count,
their integer sums and their box. A round sends the centroids down each tree: a centroid that another one beats, strictly,
everywhere in a node's box is no candidate below; a node with one candidate goes to it as a whole, by count and sums; the
vectors of a leaf are compared with the candidates that are left.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, bound_arrow, require

#: Vectors of a tree: some 10 MB in memory at 64 components.
CHUNK = 8192
#: Vectors of a leaf at most.
LEAF = 32
#: Integer components are smaller than this in size, so that squared distances fit 64 bits.
LIMIT = 1 << 26
#: Nodes whose candidates are judged at once.
NODES = 128


def kept(vectors: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """(id, v): vectors of ``dims`` components, none null, non-finite or too large for LIMIT; v as doubles."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    fine = F.forall("v", lambda x: F.coalesce(F.abs(x * scale) < float(LIMIT), F.lit(False)))  # NaN is larger than any
    return vectors.select(F.col(f"`{id_col}`").alias("id"), v.alias("v")).filter((F.size("v") == dims) & F.coalesce(fine, F.lit(False)))


def seeds(rows: DataFrame, k: int, scale: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of ``seed:id``, nulls last, ties by components; fewer if there are fewer."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()
    return np.array([[math.floor(x * scale) for x in r.v] for r in first], np.int64)


class Tree:
    """Vectors in the tree's order; nodes level by level, node j of level l having the j-th of 2**l equal shares."""

    def __init__(self, points: np.ndarray, lo: np.ndarray, hi: np.ndarray, sums: np.ndarray):
        self.points, self.lo, self.hi, self.sums = points, lo, hi, sums
        self.depth = (len(lo) + 1).bit_length() - 2

    def bounds(self, level: int) -> np.ndarray:
        return (np.arange((1 << level) + 1) * len(self.points)) >> level

    @classmethod
    def build(cls, points: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree, and the order in which it holds the points."""
        order, dims = np.arange(len(points)), points.shape[1]
        depth = max(0, (-(-len(points) // LEAF) - 1).bit_length())
        lo, hi, sums = (np.empty(((2 << depth) - 1, dims), t) for t in (points.dtype, points.dtype, np.int64))
        tree = cls(points, lo, hi, sums)
        for level in range(depth + 1):
            cuts, below = tree.bounds(level).tolist(), tree.bounds(level + 1).tolist()
            for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                own, node = points[order[a:b]], (1 << level) - 1 + j
                lo[node], hi[node], sums[node] = own.min(0), own.max(0), own.sum(0, dtype=np.int64)
                if level < depth:
                    widest = int(np.argmax(hi[node].astype(np.int64) - lo[node]))
                    order[a:b] = order[a:b][np.argpartition(own[:, widest], below[2 * j + 1] - a)]
        tree.points = points[order]
        return tree, order

    def packed(self) -> bytes:
        kind = self.points.dtype
        return b"".join([np.array([kind.itemsize, *self.points.shape, len(self.lo)], np.int64).tobytes(), self.points.tobytes(), self.lo.tobytes(), self.hi.tobytes(), self.sums.tobytes()])

    @classmethod
    def unpacked(cls, blob: bytes) -> Tree:
        size, n, dims, nodes = np.frombuffer(blob, np.int64, 4).tolist()
        kind, at, parts = {2: np.int16, 4: np.int32}[size], 32, []
        for rows, t in ((n, kind), (nodes, kind), (nodes, kind), (nodes, np.int64)):
            parts.append(np.frombuffer(blob, t, rows * dims, at).reshape(rows, dims))
            at += parts[-1].nbytes
        return cls(*parts)

    def parts(self, centroids: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(node, first vector, last one + 1, candidates), a single candidate having the whole node; together, all vectors."""
        nodes, left = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
        for level in range(self.depth + 1):
            cuts, at = self.bounds(level), (1 << level) - 1
            for i in range(0, len(nodes), NODES):
                own = slice(i, i + NODES)
                left[own] &= ~beaten(self.lo[at + nodes[own]].astype(np.int64), self.hi[at + nodes[own]].astype(np.int64), centroids, left[own])
            done = (left.sum(1) == 1) | (level == self.depth)
            for j, some in zip(nodes[done].tolist(), left[done], strict=True):
                yield at + j, int(cuts[j]), int(cuts[j + 1]), np.flatnonzero(some)
            nodes, left = (2 * nodes[~done][:, None] + np.arange(2)).ravel(), np.repeat(left[~done], 2, axis=0)

    def nearest(self, a: int, b: int, candidates: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of vectors a to b: the nearest candidate, the smallest of equal ones, and its squared distance."""
        d = ((self.points[a:b, None, :].astype(np.int64) - centroids[candidates]) ** 2).sum(2)
        at = d.argmin(1)
        return candidates[at], d[np.arange(b - a), at]


def beaten(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray, left: np.ndarray) -> np.ndarray:
    """By box and centroid: whether the candidate nearest to the box's middle is strictly nearer to every point of the
    box. The difference of two squared distances is linear, so it is least in the corner towards the centroid."""
    middle = ((2 * centroids - (lo + hi)[:, None, :]) ** 2).sum(2)
    best = centroids[np.where(left, middle, np.iinfo(np.int64).max).argmin(1)][:, None, :]
    corner = np.where(centroids > best, hi[:, None, :], lo[:, None, :])
    return ((centroids - best) * (centroids + best - 2 * corner)).sum(2) > 0


def _planted(scale: int, dims: int):
    """Rows (id, v) come in, rows (ids, tree) go out."""

    def tree(parts: list) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        v = rows.column(1).combine_chunks()
        points = np.floor(v.flatten().to_numpy(zero_copy_only=False) * scale).astype(np.int32).reshape(-1, dims)
        points = points.astype(np.int16) if np.abs(points).max() < 1 << 15 else points
        grown, order = Tree.build(points)
        ids = rows.column(0).combine_chunks().take(pa.array(order))
        return pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([grown.packed()], pa.binary())], ["ids", "tree"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                take = min(CHUNK - n, b.num_rows - at)
                held.append(b.slice(at, take))
                n, at = n + take, at + take
                if n == CHUNK:
                    yield tree(held)
                    held, n = [], 0
        if held:
            yield tree(held)

    return run


def _totals(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        count, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            for blob in b.column(0):
                t = Tree.unpacked(blob.as_py())
                for node, a, z, some in t.parts(centroids):
                    if len(some) == 1:
                        count[some] += z - a
                        sums[some] += t.sums[node]
                        continue
                    own, _ = t.nearest(a, z, some, centroids)
                    count += np.bincount(own, minlength=k)
                    np.add.at(sums, own, t.points[a:z])
        yield pa.record_batch([np.repeat(np.arange(k), dims), np.tile(np.arange(dims), k), np.repeat(count, dims), sums.ravel()], ["cluster", "dim", "n", "s"])

    return run


def _assigned(centroids: np.ndarray, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, blob in zip(b.column(0), b.column(1), strict=True):
                t = Tree.unpacked(blob.as_py())
                cluster, distance = np.empty(len(t.points), np.int32), np.empty(len(t.points), np.int64)
                for _, a, z, some in t.parts(centroids):
                    cluster[a:z], distance[a:z] = t.nearest(a, z, some, centroids)
                yield pa.record_batch([ids.values, pa.array(cluster), pa.array(distance)], ["id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(a row per kept vector: id_col, cluster, distance (squared); the centroids).

    Components become floor(scale * x). Left out are vectors of another length, with a null or non-finite component, or
    with one whose integer reaches LIMIT in size. Seeds are the k vectors with the smallest SHA-256 of ``seed:id``; a row
    without an id is one only if others are too few. A round moves each non-empty centroid to the floor of its mean.
    Equal distances go to the smaller number. Repeated rows and null ids stay rows of their own; no vectors, no rows.

    The driver holds k centroids and, of each round, their sums: k * dims numbers.
    """
    require(vectors, id_col, vec_col)
    spark = vectors.sparkSession
    bound_arrow(spark)
    rows, kind = kept(vectors, id_col, vec_col, dims, scale), vectors.schema[id_col].dataType.simpleString()
    centroids = seeds(rows, k, scale, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance long"), np.empty((0, dims), np.int64)
    trees = Scratch(spark, "kdtree").table(rows.mapInArrow(_planted(scale, dims), f"ids array<{kind}>, tree binary"), "trees")
    for _ in range(rounds):
        sums = trees.select("tree").mapInArrow(_totals(centroids), "cluster long, dim long, n long, s long")
        for r in sums.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(28,0)")).alias("s")).filter("n > 0").collect():
            centroids[r.cluster, r.dim] = int(r.s) // r.n
    found = trees.mapInArrow(_assigned(centroids, kind), f"id {kind}, cluster int, distance long")
    return found.withColumnRenamed("id", id_col), centroids


def clustered(vectors: DataFrame, **options) -> DataFrame:
    """cluster() with cluster_inertia and inertia (distances summed over the cluster and over all) and centroid_sha256
    (of the final centroid's components, decimal, joined by commas). A sum beyond 64 bits is null."""
    found, centroids = cluster(vectors, **options)
    spark, name = found.sparkSession, found.columns[0]
    found = Scratch(spark, "clusters").table(found, "found")
    facts = spark.createDataFrame([(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())], "cluster int, centroid_sha256 string")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("s"))
    both = sums.join(sums.agg(F.sum("s").alias("a")), how="cross").join(facts, "cluster")  # a row for each of k clusters, and one row
    long = lambda c: F.col(c).try_cast("long")
    return found.join(F.broadcast(both), "cluster").select(name, "cluster", "distance", long("s").alias("cluster_inertia"), long("a").alias("inertia"), "centroid_sha256")


def oracle(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> str:
    """Equal SQL; floors of quotients by whole numbers."""
    out = f"""WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [floor({scale} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
            WHERE len(embedding) = {dims} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {dims}),
        x AS MATERIALIZED (SELECT r, unnest(range({dims})) AS i, unnest(v) AS val FROM e),
        s AS (SELECT v, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, v) - 1 AS c FROM e),
        c0 AS MATERIALIZED (SELECT c, unnest(range({dims})) AS i, unnest(v) AS val FROM s WHERE c < {k})"""
    for n in range(rounds + 1):
        out += f""",
        a{n} AS MATERIALIZED (SELECT r, c, d FROM (SELECT x.r, c{n}.c, sum((x.val - c{n}.val) * (x.val - c{n}.val)) AS d FROM x JOIN c{n} USING (i) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""
        if n < rounds:
            out += f""",
        u{n} AS (SELECT c, i, sum(val)::HUGEINT AS t, count(*)::HUGEINT AS m FROM x JOIN a{n} USING (r) GROUP BY ALL),
        c{n + 1} AS MATERIALIZED (SELECT c, i, coalesce((t - ((t % m) + m) % m) // m, val)::BIGINT AS val FROM c{n} LEFT JOIN u{n} USING (c, i))"""
    return (
        out
        + f""",
        h AS (SELECT c, sha256(string_agg(val::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
        SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a{rounds} JOIN e USING (r) JOIN h USING (c)"""
    )
