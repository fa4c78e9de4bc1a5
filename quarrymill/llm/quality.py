"""Quality rules by distribution divergence, in DataFrame operations only.

A document's histograms of character classes and of common words are compared with its language's references by
Jensen-Shannon distance. References are counted over all documents of a language. A length guard keeps short texts
from being judged by their histograms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, require

SPLIT = "[\\\\x20\\\\x09-\\\\x0D]+"
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Texts of fewer words aren't judged by divergence.
GUARD_WORDS = 30
#: Jensen-Shannon distances (base 2, from 0 to 1) beyond which a document is dropped; fitted on half of a labelled sample.
MAX_CHAR_DISTANCE = 0.3
MAX_WORD_DISTANCE = 0.42
#: Common words are a language's most frequent ones, of any length, in lower case.
COMMON_WORDS = 24
#: A common word makes up this share of its language's words, so a language has 1 / COMMON_SHARE candidates at most.
COMMON_SHARE = 0.002
CLASSES = ("lower", "upper", "digit", "white", "symbol", "other")


def base_columns(docs: DataFrame) -> DataFrame:
    """doc_id, lang, lw (lower-case words), counts by CLASSES and the base metrics.

    Lower-case letters go first and white space next, so that only a small rest of a text is gone over for the other
    classes. Windows are compared by hash first: without equal hashes nothing repeats. Else they are sorted as strings,
    so the count of repeated words is exact.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", "lang", text.alias("t"), F.expr(f"array_remove(split(coalesce(text, ''), '{SPLIT}'), '')").alias("w"))
    without = lambda c, cut: F.regexp_replace(c, cut, "")
    less = lambda a, b: (F.length(a) - F.length(b)).cast("long")
    slices = ", ".join(f"slice(w, {i + 1}, greatest(size(w) - {REPEAT_WINDOW - 1}, 0))" for i in range(REPEAT_WINDOW))
    fields = ", ".join(f"x.`{i}`" for i in range(REPEAT_WINDOW))
    d = d.select(
        "doc_id", "lang", "w",
        F.size("w").cast("long").alias("n_words"),
        F.length("t").cast("long").alias("n_chars"),
        without("t", "\\p{Ll}+").alias("rest"),
        F.expr("filter(split(t, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')").alias("lines"),
        F.expr("transform(w, x -> lower(x))").alias("lw"),
        F.expr(f"transform(arrays_zip({slices}), x -> xxhash64({fields}))").alias("hashes"),
    )
    d = d.withColumn("solid", without("rest", "[\\x20\\x09-\\x0D]+"))
    again = F.size("hashes") > F.size(F.array_distinct("hashes"))
    d = d.withColumns({
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "lower": F.col("n_chars") - F.length("rest"),
        "white": less("rest", "solid"),
        "upper": less("solid", without("solid", "\\p{Lu}+")),
        "digit": less("solid", without("solid", "\\p{Nd}+")),
        "n_symbols": less("solid", without("solid", f"[{SYMBOLS}]+")),
        "sorted": F.when(again, F.expr(f"sort_array(transform(arrays_zip({slices}, sequence(1, greatest(size(w) - {REPEAT_WINDOW - 1}, 1))), x -> struct(concat_ws(' ', {fields}) AS s, x.`{REPEAT_WINDOW}` AS p)))")),
    }).drop("lines", "hashes", "w", "rest", "solid")
    d = d.withColumns({"word_chars": F.col("n_chars") - F.col("white"), "symbol": F.col("n_symbols")})
    d = d.withColumn("other", F.col("word_chars") - F.col("lower") - F.col("upper") - F.col("digit") - F.col("n_symbols"))
    pairs = "zip_with(slice(sorted, 1, size(sorted) - 1), slice(sorted, 2, size(sorted) - 1), (a, b) -> CASE WHEN a.s = b.s THEN array(a.p, b.p) ELSE array() END)"
    d = d.withColumn("at", F.when(F.col("sorted").isNotNull(), F.expr(f"sort_array(array_distinct(flatten({pairs})))"))).drop("sorted")
    gaps = "aggregate(zip_with(slice(at, 1, size(at) - 1), slice(at, 2, size(at) - 1), (a, b) -> least(b - a, {0})), {0}, (s, x) -> s + x)".replace("{0}", str(REPEAT_WINDOW))
    d = d.withColumn("n_repeat_words", F.when(F.coalesce(F.size("at"), F.lit(0)) > 0, F.expr(gaps)).otherwise(0).cast("long")).drop("at")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return d.withColumn("base_failed", failed)


def references(base: DataFrame, scratch: Scratch) -> DataFrame:
    """Of base_columns. A row per language: lang, ref_chars (shares by CLASSES), ref_words (the common words), ref_shares
    (theirs)."""
    d = base.filter("lang is not null")
    sums = d.groupBy("lang").agg(F.sum("n_chars").alias("n"), F.sum("n_words").alias("words"), *(F.sum(c).alias(c) for c in CLASSES))
    words = d.select("lang", F.explode("lw").alias("word"))
    path = scratch.write(sums, "sums")
    sums = scratch.spark.read.parquet(path)
    # most words may be of one language: its row goes to them, not they to it
    n = sums.select("lang", "words")
    common = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(n) if scratch.small(path) else n, "lang").filter(F.col("c") >= COMMON_SHARE * F.col("words"))
    top = common.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("c"), "word"))), 1, COMMON_WORDS).alias("top"))
    return sums.join(top, "lang", "left").select(
        "lang", F.array(*(F.col(c) / F.col("n") for c in CLASSES)).alias("ref_chars"),
        F.coalesce(F.col("top.word"), F.array().cast("array<string>")).alias("ref_words"),
        F.expr("transform(coalesce(top.c, array()), x -> -x / words)").alias("ref_shares"),
    )


def js_distance(p: str, q: str) -> Column:
    """Of two arrays of shares with equal sizes."""
    part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / (a + b)) ELSE 0D END"
    return F.expr(f"CASE WHEN {q} IS NOT NULL THEN sqrt(greatest(aggregate(zip_with({p}, {q}, (a, b) -> ({part('a')} + {part('b')}) / 2), 0D, (s, x) -> s + x), 0D)) END")


def quality(docs: DataFrame, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE, guard: int = GUARD_WORDS) -> DataFrame:
    """Returns a row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, char_distance, word_distance.

    kept is false if base_failed, or if a distance is over its bound and the text has ``guard`` words. Without a
    language (null) there is no reference, and distances are null. A null text is an empty one and fails the base.
    Repeated rows give a row each; an empty table gives an empty result. Other columns are ignored.
    """
    require(docs, "doc_id", "text", "lang")
    scratch = Scratch(docs.sparkSession, "quality")
    base = scratch.table(base_columns(docs), "base", "zstd")  # texts are gone over once
    path = scratch.write(references(base, scratch), "references")
    refs = docs.sparkSession.read.parquet(path)
    # a language's row has some 2 KB, and files are few; beyond a checked size it is a shuffled join
    refs = F.broadcast(refs) if scratch.small(path) else refs.hint("merge")
    d = base.join(refs, "lang", "left")
    d = d.withColumn("own", F.array(*(F.col(c) / F.greatest("n_chars", F.lit(1)) for c in CLASSES)))
    # common words by their number, so that counting goes over numbers
    d = d.withColumn("common", F.expr("array_remove(transform(lw, x -> array_position(ref_words, x)), 0L)")).drop("lw")
    d = d.withColumn("shares", F.expr("transform(ref_words, (r, i) -> (size(common) - size(array_remove(common, bigint(i + 1)))) / greatest(n_words, 1))")).drop("common")
    rest = lambda c: F.concat(F.col(c), F.array(F.greatest(F.lit(0.0), 1 - F.aggregate(c, F.lit(0.0), lambda s, x: s + x))))
    d = d.withColumns({"p": rest("shares"), "q": rest("ref_shares")})
    d = d.withColumns({"char_distance": F.round(js_distance("own", "ref_chars"), 6), "word_distance": F.round(js_distance("p", "q"), 6)})
    far = (F.col("n_words") >= guard) & ((F.col("char_distance") > max_char) | (F.col("word_distance") > max_word))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"), "char_distance", "word_distance")
