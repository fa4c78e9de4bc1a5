"""Source divergence audit: how far each source's terms are from those of the other sources and of its language.

Terms are counted in each task, by group of language and source, before anything is shuffled. For all pairs of a
language's sources a function f of two scaled probabilities is summed over all kept terms, exactly, in two parts:

- heavy terms, which many groups have: dense tiles of terms by blocks of groups, as integer matrices;
- light terms: as if no group had them, which is one product for a pair; corrected for each term of a group by what f is
  against a group without it, by equal counts at once; and corrected again for each pair of groups in a term's posting
  list, which a light term keeps short.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch, bound_arrow, require
from .words import LETTERS, pieces

MIN_DOCS = 10
TOP = 10
#: Probabilities are whole numbers of this.
SCALE = 1_000_000_000
#: Terms that a task counts before it sends them on.
HELD = 200_000
#: A term is light if no more groups have it, and if they are at most half of its language's.
LIGHT = 64
#: A dense tile has about so many terms, and two blocks of so many groups.
TILE_TERMS, TILE_GROUPS = 512, 256
#: Parts that a language's groups are dealt to where each meets each.
PARTS = 16


def counted(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """(lang, source, term binary, n, docs): occurrences and documents, summed by task as far as they fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, of) in held.items():
                if n:
                    terms = list(n)
                    yield pa.record_batch([pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), pa.array(terms, pa.binary()), pa.array(list(n.values()), pa.int64()), pa.array([of[t] for t in terms], pa.int64())], ["lang", "source", "term", "n", "docs"])
            held.clear()

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                n, of = held.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for words in pieces((text.as_py() or b"").translate(LETTERS)):
                    n.update(words)
                    seen.update(words)
                of.update(seen)
            if sum(len(n) for n, _ in held.values()) >= HELD:
                yield from out()
        yield from out()

    bound_arrow(docs.sparkSession)
    rows = docs.select(_text(lang_col).alias("lang"), _text(source_col).alias("source"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return rows.mapInArrow(run, "lang string, source string, term binary, n long, docs long")


def _text(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def _scaled(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)); null if there is nothing to divide by."""
    whole = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * whole(n + 2), F.nullif(whole(total + 2 * terms), F.lit(0).cast("decimal(19,0)"))) + 1


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _dense(key: tuple, tile: pa.Table) -> pa.Table:
    """Of a tile (lang, tile, x, y): f of each pair a < b, a in block x, b in block y, summed over the tile's terms.
    A row without a term says what the group's probability of a term is that it hasn't."""
    gid, p = tile["gid"].to_numpy(), tile["p"].to_numpy()
    terms = tile["term"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    here = ~np.isnan(terms) if terms.dtype.kind == "f" else np.ones(len(terms), bool)
    groups, at = np.unique(gid, return_inverse=True)
    dense = np.empty((len(groups), int(terms[here].max(initial=-1)) + 1), np.int64)
    dense[at[~here]] = p[~here, None]
    dense[at[here], terms[here].astype(np.int64)] = p[here]
    x, y = (np.flatnonzero(groups // TILE_GROUPS == k.as_py()) for k in key[2:])
    out = [(i, y[groups[y] > groups[i]]) for i in x]
    a, b = (np.concatenate([np.empty(0, np.int64), *c]) for c in ([np.full(len(j), groups[i]) for i, j in out], [groups[j] for _, j in out]))
    v = np.concatenate([np.empty(0, np.int64), *(_far(dense[i], dense[j]).sum(1) for i, j in out)])
    return pa.table({"lang": pa.array([key[0].as_py()] * len(a), pa.string()), "a": a.astype(np.int64), "b": b.astype(np.int64), "v": v.astype(np.int64)})


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of light terms (lang, postings of gid, p, p0, by gid): what f of the pairs in a list is beyond f against groups
    without the term. Lists of one length are worked on at once; a batch gives a row for a pair."""
    for b in batches:
        lists = b.column(1)
        sizes, offsets = np.diff(lists.offsets.to_numpy()), lists.offsets.to_numpy()
        gid, p, p0 = (lists.values.field(i).to_numpy() for i in range(3))
        lang = np.asarray(b.column(0).to_pylist(), object)
        names, code = np.unique(lang, return_inverse=True)
        a, z, of, v = [], [], [], []
        for m in np.unique(sizes[sizes > 1]).tolist():
            rows = np.flatnonzero(sizes == m)
            at = offsets[rows][:, None] + np.arange(m)
            for i in range(m - 1):
                left, right = at[:, i : i + 1], at[:, i + 1 :]
                beyond = _far(p[left], p[right]) - _far(p[left], p0[right]) - _far(p0[left], p[right]) + _far(p0[left], p0[right])
                a.append(np.broadcast_to(gid[left], right.shape).ravel())
                z.append(gid[right].ravel())
                of.append(np.broadcast_to(code[rows][:, None], right.shape).ravel())
                v.append(beyond.ravel())
        if a:
            keys, where = np.unique(np.stack([np.concatenate(of), np.concatenate(a), np.concatenate(z)], 1), axis=0, return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, where, np.concatenate(v))
            yield pa.record_batch([pa.array(names[keys[:, 0]], pa.string()), pa.array(keys[:, 1]), pa.array(keys[:, 2]), pa.array(sums)], ["lang", "a", "b", "v"])


def divergence_audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", light: int = LIGHT) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of each group of language and source.

    Terms are runs of letters, A-Z in lower case; a language keeps those in at least min_docs of its documents. With N
    occurrences of V kept terms, a term that occurs n times has p = 1 + floor(10**9 * (n + 2) / (N + 2 * V)), in a group
    and in a language alike, and f(p, q) = floor((p - q)**2 / (p + q)).

    Part "pair": item is another source of the language, value the sum of f over all kept terms, 0 if none is kept. Part
    "term": item is a kept term that the group has and uses more than its language does, value f against the language;
    the top ones only. Ranks go by value, the largest first, ties by the bytes of item.

    Null language, source and text count as ''. Repeated rows count as often as they are. A document without terms still
    makes its group. A language's only source has no pairs. No documents, no rows. Other columns don't matter.
    """
    require(docs, lang_col, source_col, text_col)
    scratch = Scratch(docs.sparkSession, "divergence")
    sums = counted(docs, lang_col, source_col, text_col).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = sums.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n"), F.collect_list(F.struct("source", "n")).alias("postings")).filter(F.col("docs") >= min_docs)  # a posting for a source
    terms = scratch.table(terms.drop("docs"), "terms")
    totals = terms.select("lang", F.explode("postings").alias("o")).groupBy("lang", "o.source").agg(F.sum("o.n").alias("group_n"))
    groups = docs.select(_text(lang_col).alias("lang"), _text(source_col).alias("source")).distinct()
    by = Window.partitionBy("lang")  # a row for a group
    groups = groups.withColumns({"gid": F.row_number().over(by.orderBy("source")).cast("long") - 1, "groups": F.count(F.lit(1)).over(by)})
    # what holds for a language goes to its groups, not to its terms: of terms, each language has any number
    many = (F.col("has") > light) | (2 * F.col("has") > F.col("groups"))
    langs = terms.groupBy("lang", F.size("postings").alias("has")).agg(F.count(F.lit(1)).alias("k"), F.sum("all_n").alias("s")).join(groups.select("lang", "groups").distinct(), "lang")
    langs = langs.groupBy("lang").agg(F.sum("k").alias("v"), F.sum("s").alias("lang_n"), F.sum(F.when(many, F.col("k")).otherwise(0)).alias("heavy_v"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["group_n", "v", "lang_n", "heavy_v"])
    groups = scratch.table(groups.withColumn("p0", _scaled(F.lit(0), F.col("group_n"), F.col("v"))), "groups")
    own = terms.select("lang", "term", "all_n", F.size("postings").alias("has"), F.explode("postings").alias("o")).select("lang", "term", "all_n", "has", "o.source", "o.n").join(groups, ["lang", "source"])
    p, q = _scaled(F.col("n"), F.col("group_n"), F.col("v")), _scaled(F.col("all_n"), F.col("lang_n"), F.col("v"))
    own = scratch.table(own.select("lang", "source", "gid", "groups", "heavy_v", "term", p.alias("p"), q.alias("q"), "p0", many.alias("heavy")), "cells")

    ranks = lambda: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    most = own.filter("p > q").select("lang", "source", F.col("term").cast("string").alias("item"), _f(F.col("p"), F.col("q")).alias("value")).withColumn("rank", ranks()).filter(F.col("rank") <= top)
    pairs = _pair_sums(own, groups)
    names = groups.select("lang", "gid", "source")
    pairs = pairs.join(names.select("lang", F.col("gid").alias("a"), F.col("source").alias("left")), ["lang", "a"]).join(names.select("lang", F.col("gid").alias("b"), F.col("source").alias("right")), ["lang", "b"])
    sides = F.array(F.struct(F.col("left").alias("source"), F.col("right").alias("item")), F.struct(F.col("right").alias("source"), F.col("left").alias("item")))
    pairs = pairs.select("lang", F.explode(sides).alias("s"), "value").select("lang", "s.source", "s.item", "value").withColumn("rank", ranks())
    out = pairs.withColumn("part", F.lit("pair")).unionByName(most.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def _pair_sums(own: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) of all pairs a < b of a language's groups."""
    heavy, light = own.filter("heavy"), own.filter("NOT heavy")
    # light terms as if no group had them, and each group's terms against a group without them
    none = groups.select("lang", "gid", "p0", F.col("p0").alias("p"), (F.col("v") - F.col("heavy_v")).alias("times"), F.lit(True).alias("base"))
    some = light.groupBy("lang", "gid", "p0", "p").agg(F.count(F.lit(1)).alias("times")).select("lang", "gid", "p0", "p", "times", F.lit(False).alias("base"))
    dealt = none.unionByName(some).withColumn("part", F.pmod(F.col("gid"), F.lit(PARTS)))
    others = groups.select("lang", F.col("gid").alias("other"), F.col("p0").alias("q0"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("part"))
    met = dealt.join(others, ["lang", "part"]).filter("gid <> other AND (NOT base OR gid < other)")
    alone = F.coalesce(_f(F.col("p0"), F.col("q0")), F.lit(0))
    v = F.col("times") * F.when(F.col("base"), alone).otherwise(_f(F.col("p"), F.col("q0")) - alone)
    first = met.groupBy("lang", F.least("gid", "other").alias("a"), F.greatest("gid", "other").alias("b")).agg(F.sum(v).alias("v"))
    lists = light.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("gid", "p", "p0"))).alias("postings"))  # as short as light says
    second = lists.select("lang", "postings").mapInArrow(_pairs, "lang string, a long, b long, v long")
    # dense tiles: the number of tiles follows a language's heavy terms
    tiles = F.ceil(F.col("heavy_v") / F.lit(TILE_TERMS)).cast("long")
    cells = heavy.select("lang", F.pmod(F.xxhash64("term"), tiles).alias("tile"), "gid", "groups", "term", "p")
    absent = groups.filter("heavy_v > 0").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)).alias("tile"), "gid", "groups", F.lit(None).cast("binary").alias("term"), F.col("p0").alias("p"))
    block = F.expr(f"gid div {TILE_GROUPS}")
    blocks = cells.unionByName(absent).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(groups - 1) div {TILE_GROUPS}"))))
    blocks = blocks.select("lang", "tile", F.least(block, "other").alias("x"), F.greatest(block, "other").alias("y"), "gid", "term", "p")
    third = blocks.groupBy("lang", "tile", "x", "y").applyInArrow(_dense, "lang string, a long, b long, v long")
    return first.unionByName(second).unionByName(third).groupBy("lang", "a", "b").agg(F.sum("v").alias("value"))


def oracle() -> str:
    """Equal SQL, term by term and pair by pair."""
    return rf"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        t AS MATERIALIZED (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        k AS MATERIALIZED (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT r) >= {MIN_DOCS}),
        v AS (SELECT lang, count(*) AS terms, sum(total) AS total_n FROM k GROUP BY lang),
        g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
        n AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
        s AS (SELECT lang, source, sum(c) AS group_n FROM n GROUP BY ALL),
        p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, (1 + ({SCALE}::HUGEINT * (coalesce(c, 0) + 2)) // (coalesce(group_n, 0) + 2 * terms))::BIGINT AS p, (1 + ({SCALE}::HUGEINT * (total + 2)) // (total_n + 2 * terms))::BIGINT AS q
            FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source, term) LEFT JOIN s USING (lang, source)),
        y AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        z AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN y ON y.lang = a.lang AND y.source = a.source AND y.item = b.source
            UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE c > 0 AND p > q),
        o AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM z)
        SELECT * FROM o WHERE part = 'pair' OR rank <= {TOP}"""
