"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents are counted to cells (source, language, topic) with their tokens. Cell weights are raked to the target
marginals in turn until every marginal is met. A weight never exceeds the cell's tokens, so weight / tokens is a
probability: the score that is raked goes on without that bound, so that what a full cell can't take goes to the others
of its marginal. Targets are first made feasible, value by value. A document is kept if its uniform hash is under its
cell's probability: no shuffle of texts, and the same rows at any time.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, own, require, whole_row

DIMS = ("source", "lang", "topic")
#: Share of all tokens to keep.
RATE = 0.7
#: Targets that aren't given are the observed shares to this power, normalised: it flattens the mixture.
TEMPER = 0.7
#: A target is at most this part of its value's tokens; what is beyond goes to the other values in proportion.
FULL = 0.9
#: Sweeps end when no marginal was off by this part of its target, or after MAX_SWEEPS.
TOLERANCE = 0.004
MAX_SWEEPS = 60
#: A residual from which a warning is given.
UNMET = 0.01
SEED = 17
TOKEN = r"[^\x20\x09-\x0D]+"
#: The topic of a text is the first whose pattern is found, unless the table has a column ``topic``.
TOPICS = (("legal", "[Ll]icen[cs]e|[Cc]opyright"), ("contact", "@|[+][0-9]"), ("numbers", "[0-9]{3}"), ("table", " [|] "))
OTHER_TOPIC = "prose"
MISSING = "(none)"


def topic_sql(text: str, match: str) -> str:
    """CASE over TOPICS; match names the function that looks for a pattern."""
    return "CASE " + " ".join(f"WHEN {match}({text}, '{p}') THEN '{t}'" for t, p in TOPICS) + f" ELSE '{OTHER_TOPIC}' END"


def described(docs: DataFrame) -> list[Column]:
    """Columns of docs: source, lang, topic, tokens and u, uniform by id (a null id: by text). Null texts have no tokens."""
    text = F.coalesce(F.col("text"), F.lit(""))
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(text.cast("binary")))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), name).cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32
    topic = F.lit(OTHER_TOPIC)
    for t, pattern in reversed(TOPICS):
        topic = F.when(text.rlike(pattern), F.lit(t)).otherwise(topic)
    topic = F.coalesce(F.col("topic").cast("string"), F.lit(MISSING)) if "topic" in docs.columns else topic
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c)
    return [value("source"), value("lang"), topic.alias("topic"), F.regexp_count(text, F.lit(TOKEN)).cast("long").alias("tokens"), u.alias("u")]


def feasible(sums: DataFrame, total: float, full: float = FULL) -> DataFrame:
    """sums: (value, tokens, share). Returns (value, target): tokens in proportion to share, at most full * tokens, and
    total in all if that is possible."""
    room, level = F.col("tokens") * F.lit(full), 0.0
    while True:
        over = (F.col("share") * F.lit(level) >= room) & F.lit(level > 0)
        taken, free = sums.agg(F.sum(F.when(over, room).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("share")))).first()
        after = (total - (taken or 0.0)) / free if free else level
        if after <= level * (1 + 1e-12):
            return sums.select("value", F.least(F.col("share") * F.lit(level), room).alias("target"))
        level = after


def rake(cells: DataFrame, scratch: Scratch, rate: float = RATE, temper: float = TEMPER, targets: dict[str, DataFrame] | None = None, tolerance: float = TOLERANCE, max_sweeps: int = MAX_SWEEPS, full: float = FULL) -> DataFrame:
    """cells: (source, lang, topic, tokens). Returns them with weight, probability and residual, the largest part by
    which a marginal misses its target in the end (the same in all rows).

    targets: by dimension, (value, target) rows whose shares sum to 1. Values without a target get weight 0; what is
    over ``full`` of a value's tokens goes to the others. Each sum is a grouped aggregation joined back, which doubles
    the plan; so cells are written after every sweep.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0) * rate
    now = cells.withColumn("score", F.col("tokens") * F.lit(rate))
    for dim in DIMS:
        sums = cells.groupBy(F.col(dim).alias("value")).agg(F.sum("tokens").cast("double").alias("tokens"))
        given = (targets or {}).get(dim)
        if given is None:
            sums = sums.withColumn("share", F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(temper))).otherwise(0.0))
        else:
            sums = sums.join(given.toDF("value", "share"), "value", "left").fillna(0.0, ["share"])
        goal = feasible(scratch.table(sums, f"sums-{dim}"), total, full).toDF(dim, f"t_{dim}")
        now = now.join(goal, dim)
    now, old = scratch.table(now, "cells"), None
    weight, tokens = F.least("score", F.col("tokens").cast("double")), F.col("tokens")

    def off(dim: str) -> Column:
        return F.coalesce(F.try_divide(F.abs(F.col("s") - F.col(f"t_{dim}")), F.col(f"t_{dim}")), F.when(F.col("s") > 0, 1.0).otherwise(0.0))

    for sweep in range(max_sweeps):
        now = now.withColumn("off", F.lit(0.0))
        for dim in DIMS:
            sums = now.groupBy(dim).agg(F.sum(weight).alias("s"))
            factor = F.when(F.col("s") > 0, F.col(f"t_{dim}") / F.col("s")).otherwise(F.lit(0.0))
            now = now.join(sums, dim).withColumns({"score": F.least(F.col("score") * factor, F.lit(1e200)), "off": F.greatest("off", off(dim))}).drop("s")
        path = scratch.write(now, f"sweep{sweep}")
        now = scratch.spark.read.parquet(path)
        if old:
            scratch.drop(old)
        old = path
        if (now.agg(F.max("off")).first()[0] or 0.0) <= tolerance:
            break
    worst = None
    for dim in DIMS:
        part = now.groupBy(dim, f"t_{dim}").agg(F.sum(weight).alias("s")).agg(F.max(off(dim)).alias(dim))
        worst = part if worst is None else worst.crossJoin(part)  # one row each
    share = F.when(tokens > 0, weight / tokens).otherwise(F.lit(0.0))
    residual = worst.select(F.round(F.greatest(*DIMS), 6).alias("residual"))
    return now.select(*DIMS, "tokens", weight.alias("weight"), F.round(share, 9).alias("probability")).crossJoin(F.broadcast(residual))  # one row


def _cells(slim: DataFrame) -> DataFrame:
    return slim.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Returns a row per row of docs: doc_id, source, lang, topic, n_tokens, probability, kept, residual.

    options: of rake. Null sources, languages and topics count as '(none)'. A document has its cell's probability, 0 if
    the cell has no tokens at all (null, empty and blank texts). Repeated rows have one decision; rows with null ids are
    told apart by their texts. Targets that can't be met together show in the residual. An empty table gives an empty
    result. Other columns are ignored.
    """
    require(docs, "doc_id", "text", "source", "lang")
    scratch = Scratch(docs.sparkSession, "mixing")
    slim = scratch.table(docs.select("doc_id", *described(docs)), "described")
    cells = scratch.table(rake(_cells(slim), scratch, **options), "probabilities").select(*DIMS, "probability", "residual")
    return slim.join(cells, [*DIMS]).select("doc_id", *DIMS, F.col("tokens").alias("n_tokens"), "probability", (F.col("u") < F.col("probability")).alias("kept"), "residual")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The kept rows of docs with their own columns, whatever their names; warns if a target is missed by UNMET."""
    require(docs, "doc_id", "text", "source", "lang")
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = docs.select(whole_row(docs).alias("row"), *described(docs))
    cells = rake(scratch.table(_cells(rows.drop("row")), "counted"), scratch, **options)
    path = scratch.write(cells.select(*DIMS, "probability", "residual"), "probabilities")
    cells = scratch.spark.read.parquet(path)
    if (miss := cells.agg(F.max("residual")).first()[0] or 0.0) > UNMET:
        warnings.warn(f"a marginal misses its target by {miss:.1%}", stacklevel=2)
    # cells are few and only checked sizes are broadcast; else texts are shuffled to their cells
    return rows.join(F.broadcast(cells) if scratch.small(path) else cells, [*DIMS]).filter("u < probability").select(*own("row", docs.columns))


def oracle(rate: float = RATE, temper: float = TEMPER) -> str:
    """DuckDB SQL for mix(documents). Targets are made feasible in closed form, over values sorted by their room."""
    topic = topic_sql("coalesce(text, '')", "regexp_matches")
    ctes = [
        f"d AS (SELECT doc_id, coalesce(source, '{MISSING}') AS source, coalesce(lang, '{MISSING}') AS lang, {topic} AS topic, len(regexp_extract_all(coalesce(text, ''), '{TOKEN}')) AS n_tokens, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM documents)",
        "c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL)",
        f"total AS (SELECT sum(tokens) * {rate} AS total FROM c)",
    ]
    for x in DIMS:
        ctes.append(f"""t_{x} AS (WITH v AS (SELECT {x}, sum(tokens) * {FULL} AS room, pow(sum(tokens), {temper}) AS share FROM c GROUP BY {x} HAVING sum(tokens) > 0),
            o AS (SELECT *, total, room / share AS level, coalesce(sum(room) OVER (ORDER BY room / share, {x} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken, sum(share) OVER (ORDER BY room / share, {x} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM v, total),
            l AS (SELECT min_by((total - taken) / free, level) FILTER ((total - taken) / free <= level) AS lv FROM o) SELECT {x}, least(share * lv, room) AS t_{x} FROM o, l)""")
    same = "n, source, lang, topic, tokens, t_source, t_lang, t_topic, worst"
    state, off = f"SELECT {same}, score, 0::DOUBLE AS miss FROM r WHERE n < {MAX_SWEEPS} AND worst > {TOLERANCE}", []
    for x in DIMS:
        state = f"SELECT {same}, least(score * CASE WHEN s > 0 THEN t_{x} / s ELSE 0 END, 1e200) AS score, greatest(miss, coalesce(abs(s - t_{x}) / nullif(t_{x}, 0), CASE WHEN s > 0 THEN 1 ELSE 0 END)) AS miss FROM (SELECT {same}, score, miss, sum(least(score, tokens)) OVER (PARTITION BY {x}) AS s FROM ({state}))"
        off.append(f"(SELECT max(coalesce(abs(s - t_{x}) / nullif(t_{x}, 0), CASE WHEN s > 0 THEN 1 ELSE 0 END)) FROM (SELECT t_{x}, sum(least(score, tokens)) AS s FROM f GROUP BY {x}, t_{x}))")
    ctes += [
        f"r AS (SELECT 0 AS n, source, lang, topic, tokens, coalesce(t_source, 0) AS t_source, coalesce(t_lang, 0) AS t_lang, coalesce(t_topic, 0) AS t_topic, 1::DOUBLE AS worst, tokens * {rate} AS score FROM c LEFT JOIN t_source USING (source) LEFT JOIN t_lang USING (lang) LEFT JOIN t_topic USING (topic)"
        f" UNION ALL SELECT n + 1, source, lang, topic, tokens, t_source, t_lang, t_topic, max(miss) OVER () AS worst, score FROM ({state}))",
        "f AS (SELECT * FROM r WHERE n = (SELECT max(n) FROM r))",
        "p AS (SELECT source, lang, topic, round(CASE WHEN tokens > 0 THEN least(score, tokens) / tokens ELSE 0 END, 9) AS probability FROM f)",
        f"e AS (SELECT round(greatest({', '.join(off)}), 6) AS residual)",
    ]
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\nSELECT doc_id, source, lang, topic, n_tokens, probability, u < probability AS kept, residual FROM d JOIN p USING (source, lang, topic), e"
