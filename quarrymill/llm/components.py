"""Connected components by alternating large-star and small-star rounds, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges: (a, b) longs. Returns (node, label) for every node with an edge; label is the smallest node reachable.

    Neighbours are never gathered in lists: a round takes minima with partial aggregation and joins them back, so a
    hub's edges can be split between tasks. Every round is written to the shared folder.
    """
    now = scratch.write(edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), "edges")
    read = lambda path: scratch.spark.read.schema("v long, m long").parquet(path)
    seen = None
    while True:
        e = read(now)
        both = e.select(F.col("v").alias("u"), F.col("m").alias("w")).union(e.select(F.col("m"), F.col("v")))
        least = both.groupBy("u").agg(F.min("w").alias("x")).select("u", F.least("u", "x").alias("m"))
        large = both.join(least, "u").filter("w > u").select(F.col("w").alias("v"), "m").distinct()
        # small star: of each node's smaller neighbours, all hang under the least
        low = large.groupBy("v").agg(F.min("m").alias("x"))
        small = large.join(low, "v").filter("m <> x").select(F.col("m").alias("v"), F.col("x").alias("m")).union(low.select("v", F.col("x").alias("m"))).distinct()
        after = scratch.write(small, "star")
        scratch.drop(now)
        now = after
        mark = read(now).agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    e = read(now)
    return e.select(F.col("v").alias("node"), F.col("m").alias("label")).union(e.select(F.col("m"), F.col("m"))).distinct()
