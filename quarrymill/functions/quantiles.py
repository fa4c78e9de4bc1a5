"""Exact quantiles without a task that sees all values.

Values are counted by a shuffled aggregation. Bins of nearly equal ratio (so that long tails don't fill one bin) give
the bin that holds each rank. Where such a bin has too many values, as prices in one band do, it is divided evenly
between its least and its largest value, and so on; only bins with a wanted rank are then looked at value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .written import written

#: Bins for each factor of e in a value; a few thousand bins hold what occurs, some 200,000 all doubles.
BINS = 128
_EDGE = 100_000
#: Values that a task sorts of one bin; a bin that has more is divided into so many parts.
DENSE, PARTS = 100_000, 1 << 16


def value_counts(df: DataFrame, **values: Column) -> DataFrame:
    """(name, x, n) of the named columns, as doubles; null and NaN don't count."""
    pairs = F.array(*(F.struct(F.lit(k).alias("name"), F.nanvl(c.cast("double"), F.lit(None).cast("double")).alias("x")) for k, c in values.items()))
    rows = df.select(F.explode(pairs).alias("p")).select("p.name", F.when(F.col("p.x") == 0, 0.0).otherwise(F.col("p.x")).alias("x")).filter("x IS NOT NULL")
    return rows.groupBy("name", "x").agg(F.count(F.lit(1)).alias("n"))


def _bin(x: Column) -> Column:
    """Never falls as x rises."""
    size = F.floor(F.log(F.abs(x)) * BINS) + _EDGE
    return F.when(x == 0, F.lit(0)).when(F.abs(x) == float("inf"), 2 * _EDGE * F.signum(x)).otherwise(size * F.signum(x)).cast("long")


def at_ranks(counts: DataFrame, ranks: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """counts: (name, x, n). ranks: of the number of values, gives labels with ranks from 0 on. Returns (name, total, at),
    at being a map from label to value; ranks that don't exist aren't in it.

    Bins are counted at once and written, so that those that are too dense are known; three rounds are enough for any
    doubles. counts is gone over once a round and once for the result: write it if it is dear.
    """
    keys, rows = ["bin0"], counts.withColumn("bin0", _bin(F.col("x")))
    sizes = [F.sum("n").alias("m"), F.count(F.lit(1)).alias("values"), F.min("x").alias("lo"), F.max("x").alias("hi")]
    by = Window.partitionBy("name")  # bins of a name
    bins = written(rows.groupBy("name", *keys).agg(*sizes), "bins").withColumns({"upto": F.sum("m").over(by.orderBy("bin0")), "total": F.sum("m").over(by)})
    wants = F.array(*(F.struct(F.lit(k).alias("label"), r.cast("long").alias("rank")) for k, r in ranks(F.col("total")).items()))
    bins = bins.withColumn("ws", wants)
    while True:
        mine = F.filter("ws", lambda w: (w["rank"] >= F.col("upto") - F.col("m")) & (w["rank"] < F.col("upto")))
        picks = bins.withColumn("ws", mine).filter(F.size("ws") > 0).withColumn("before", F.col("upto") - F.col("m"))
        if (picks.agg(F.max(F.when(F.col("lo") < F.col("hi"), F.col("values")))).first()[0] or 0) <= DENSE:
            break
        new, at = f"bin{len(keys)}", (F.col("x") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo"))
        rows = rows.join(picks.select("name", *keys, "lo", "hi"), ["name", *keys]).withColumn(new, F.floor(F.coalesce(at, F.lit(0.0)) * PARTS)).drop("lo", "hi")
        parts = written(rows.groupBy("name", *keys, new).agg(*sizes), "bins").join(picks.select("name", *keys, "total", "before", "ws"), ["name", *keys])
        bins = parts.withColumn("upto", F.col("before") + F.sum("m").over(Window.partitionBy("name", *keys).orderBy(new))).drop("before")  # PARTS rows
        keys.append(new)
    inside = rows.join(picks.select("name", *keys, "total", "before", "ws"), ["name", *keys])
    inside = inside.groupBy("name", *keys, "x").agg(F.sum("n").alias("n"), F.first("total").alias("total"), F.first("before").alias("before"), F.first("ws").alias("ws"))
    inside = inside.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("name", *keys).orderBy("x")))  # DENSE rows
    hits = inside.withColumn("got", F.filter("ws", lambda w: (w["rank"] >= F.col("upto") - F.col("n")) & (w["rank"] < F.col("upto")))).filter(F.size("got") > 0)
    hits = hits.select("name", "total", F.explode("got").alias("w"), "x")
    return hits.groupBy("name").agg(F.first("total").alias("total"), F.map_from_entries(F.collect_list(F.struct("w.label", "x"))).alias("at"))


def _place(total: Column, p: float) -> Column:
    return (total - 1).cast("double") * F.lit(float(p))


def _marks(t: Column, probabilities: tuple[float, ...]) -> dict[str, Column]:
    return {f"{i}{side}": f(_place(t, p)) for i, p in enumerate(probabilities) for side, f in (("a", F.floor), ("b", F.ceil))}


def _between(probabilities: tuple[float, ...]) -> Column:
    """Of total and at: a value for each probability, interpolated between neighbours."""

    def value(i: int, p: float) -> Column:
        at, a, b = _place(F.col("total"), p), F.col("at")[f"{i}a"], F.col("at")[f"{i}b"]
        return F.when(F.floor(at) == F.ceil(at), a).otherwise((F.ceil(at) - at) * a + (at - F.floor(at)) * b)

    return F.array(*(value(i, p) for i, p in enumerate(probabilities)))


def quantiles(counts: DataFrame, probabilities: tuple[float, ...]) -> DataFrame:
    """(name, total, q): q has a value for each probability, interpolated between neighbours."""
    return at_ranks(counts, lambda t: _marks(t, probabilities)).select("name", "total", _between(probabilities).alias("q"))


def quantiles_and_tops(counts: DataFrame, probabilities: tuple[float, ...], shares: tuple[float, ...]) -> DataFrame:
    """quantiles() with tops: for each share, the sum of the floor(total * share) largest values."""
    k = [F.floor(F.col("total") * s) for s in shares]
    edge = lambda t: {f"top{i}": F.when(F.floor(t * s) >= 1, t - F.floor(t * s)).otherwise(t - 1) for i, s in enumerate(shares)}
    got = at_ranks(counts, lambda t: _marks(t, probabilities) | edge(t)).select("name", "total", _between(probabilities).alias("q"), F.array(*(F.col("at")[f"top{i}"] for i in range(len(shares)))).alias("edges"))
    d = counts.join(got.select("name", "edges"), "name")
    exact, sums = (F.col("x") * F.col("n").cast("double")).cast("decimal(28,6)"), []
    for i in range(len(shares)):
        over = F.col("x") > F.col("edges")[i]
        sums += [F.coalesce(F.sum(F.when(over, exact)), F.lit(0)).cast("double").alias(f"s{i}"), F.coalesce(F.sum(F.when(over, F.col("n"))), F.lit(0)).alias(f"m{i}")]
    tops = F.array(*(F.when(k[i] >= 1, F.col(f"s{i}") + (k[i] - F.col(f"m{i}")) * F.col("edges")[i]).otherwise(0.0) for i in range(len(shares))))
    return got.join(d.groupBy("name").agg(*sums), "name").select("name", "total", "q", tops.alias("tops"))


def moments(counts: DataFrame) -> DataFrame:
    """(name, total, mean, std, low, high); std is of a sample, null for one value."""
    first = counts.groupBy("name").agg(F.sum("n").alias("total"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean"), F.min("x").alias("low"), F.max("x").alias("high"))
    far = counts.join(first.select("name", "mean"), "name").groupBy("name").agg(F.sum(F.col("n") * (F.col("x") - F.col("mean")) ** 2).alias("s"))
    return first.join(far, "name").select("name", "total", "mean", F.sqrt(F.try_divide(F.col("s"), F.col("total") - 1)).alias("std"), "low", "high")


def top_sum(counts: DataFrame, k: Callable[[Column], Column]) -> DataFrame:
    """(name, total, top): the sum of the k largest values, k being a function of their number; by the k-th largest."""
    got = at_ranks(counts, lambda t: {"at": F.when(k(t) >= 1, t - k(t)).otherwise(t - 1)})
    d = counts.join(got.select("name", "total", F.col("at")["at"].alias("at")), "name")
    over, exact = F.col("x") > F.col("at"), (F.col("x") * F.col("n").cast("double"))
    g = d.groupBy("name", "total", "at").agg(F.coalesce(F.sum(F.when(over, exact.cast("decimal(28,6)"))), F.lit(0)).cast("double").alias("s"), F.coalesce(F.sum(F.when(over, F.col("n"))), F.lit(0)).alias("m"))
    return g.select("name", "total", F.when(k(F.col("total")) >= 1, F.col("s") + (k(F.col("total")) - F.col("m")) * F.col("at")).otherwise(0.0).alias("top"))
