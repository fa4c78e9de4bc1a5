"""Exact dedup by distributed MSD radix partitioning.

Texts are compared after every character of ``[\\x20\\x09-\\x0D]`` is deleted. Each round splits the groups that
are still open by their next bytes (the digit), most significant first. A group ends when it has one document, or
when its documents have no more bytes: these are equal, without any digest. Digits widen from round to round, so
that even very long copies take few rounds.

Counting a round is a ``groupBy`` with map-side partial aggregation, so a group that holds a third of all rows
arrives as one row per task. Groups go back to their documents by a shuffled join, which adaptive execution may
split where one group is large; it is the same plan at every size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Scratch, require

WHITE = " \\t\\n\\u000b\\u000c\\r"
FIRST_BYTES = 32
WIDEN = 64


def normalised(column: str) -> str:
    """SQL for the text without white space, null counting as empty."""
    return f"translate(coalesce({column}, ''), '{WHITE}', '')"


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_bytes: int = FIRST_BYTES, widen: int = WIDEN) -> DataFrame:
    """Returns a row per row of ``docs``: id_col, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in its original text stays, then the smallest id (a null id
    counts as smallest). Of repeated rows with the same id and text one stays. Null texts are empty texts and equal
    to texts of white space. An empty table gives an empty result. Other columns are ignored.
    """
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    live = docs.select(
        F.col(id_col).alias("id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("chars"),
        F.expr(f"cast({normalised(f'`{text_col}`')} as binary)").alias("rest"),
    ).withColumn("sha", F.sha2("rest", 256)).withColumn("grp", F.lit(0).cast("long"))
    done, live_path, width, rnd = [], None, first_bytes, 0
    while True:
        digit = live.withColumn("digit", F.expr(f"substring(rest, 1, {width})")).withColumn("ended", F.length("rest") <= width)
        groups = (
            digit.groupBy("grp", "digit", "ended")
            .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col("chars")).alias("c"), F.col("id").alias("i"))).alias("best"))
            .filter("n > 1")
            .select("grp", "digit", "ended", "n", F.col("best.i").alias("keep_id"), F.monotonically_increasing_id().alias("next"))
        )
        groups_path = scratch.write(groups, f"groups{rnd}")
        groups = spark.read.schema(groups.schema).parquet(groups_path)
        step = digit.join(groups.hint("merge"), ["grp", "digit", "ended"], "left").select(
            "id", "chars", "sha", "keep_id", "n", F.col("next").alias("grp"),
            F.when(F.col("n").isNotNull() & ~F.col("ended"), F.expr(f"substring(rest, {width + 1}, 2147483647)")).alias("rest"),
        )
        path = scratch.write(step.withColumn("tag", F.monotonically_increasing_id()), f"round{rnd}")
        out = spark.read.parquet(path)
        done.append(out.filter("rest is null").drop("rest").withColumn("round", F.lit(rnd)))
        scratch.drop(groups_path)
        live, width, rnd = out.filter("rest is not null").select("id", "chars", "sha", "rest", "grp"), width * widen, rnd + 1
        if live.isEmpty():
            break
    rows = done[0]
    for d in done[1:]:
        rows = rows.unionByName(d)
    grouped = rows.filter("n is not null")
    # a group may hold repeated rows with the id that stays: the first written one is kept
    first = grouped.filter(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("round", "grp").agg(F.min("tag").alias("first"))
    kept = F.col("id").eqNullSafe(F.col("keep_id"))
    single = rows.filter("n is null").select(
        F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256")
    )
    losers = grouped.filter(~kept).select(
        F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), F.lit(False).alias("kept"), F.col("sha").alias("text_sha256")
    )
    winners = grouped.filter(kept).join(first, ["round", "grp"]).select(
        F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), (F.col("tag") == F.col("first")).alias("kept"), F.col("sha").alias("text_sha256")
    )
    return single.unionByName(losers).unionByName(winners)
