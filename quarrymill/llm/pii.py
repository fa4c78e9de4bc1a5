"""Personal data by patterns and bootstrapped contexts, in DataFrame operations only.

Base entities are found by regular expressions. As seeds, each as a whole, they induce lexical patterns of five kinds:
the two words before an identifier, the word before it, the word after it, both neighbours, and the shape of the
identifier itself. Patterns and instances (distinct values) are the two sides of a graph whose scores feed each other
for a few rounds; patterns of high confidence then discover identifiers that the expressions don't give, as they are
written in another way or run into a neighbour.

Positions come from marking: matches are put between two control characters, the text is split there, and lengths are
summed up. All of it happens within the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch, require

#: As the plain expressions, leftmost and non-overlapping, but a run of characters that fails once isn't tried again
#: from its middle, and repeated groups keep no way back: long runs take linear time.
KINDS = {
    "email": r"(?=[A-Za-z0-9._%+-])(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Seeds of secrets, which aren't personal data and so aren't in spans: long hexadecimal numbers.
SECRET = r"(?<![0-9A-Za-z])(?=[0-9]*+[A-Fa-f])(?=[A-Fa-f]*+[0-9])[0-9A-Fa-f]{32,128}+(?![0-9A-Za-z])"
SEEDS = KINDS | {"secret": SECRET}
#: Texts without this are skipped.
NEEDS = {"email": "@", "phone": "+"}
#: A group of digits goes on after a blank if the next token has nothing but digits, brackets, dots and hyphens, besides
#: punctuation at its end. A letter before the digits and a full stop end it.
TOKEN = (
    r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+(?:(?<!\p{L})[0-9][0-9().-]*+"
    r"(?:(?<!\.)\x20(?:-\x20)?\(*+[0-9][0-9().-]*+(?=[^\x20\x09-\x0D0-9@\p{L}]*+(?:[\x20\x09-\x0D]|$)))*+|[0-9@])[^\x20\x09-\x0D]*+"
)
SPLIT = r"[\x20\x09-\x0D]+"
EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
#: An identifier has so many groups between blanks at most; of a longer run of groups every part is a candidate.
GROUPS = 5
#: A candidate that isn't a base entity has this many characters at least.
MIN_CHARS = 6
ROUNDS = 3
MIN_SCORE = 0.8
#: Distinct seeds that a pattern needs.
MIN_SEEDS = 3
#: An instance that isn't a seed has this part of its best pattern's score.
TRUST = 0.5
#: Longer patterns and values are compared by their SHA-256.
LONG = 80
BLOCK = 256


def sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def starts_sql(n: str) -> str:
    """Sums of the lengths before each, of an array column; in blocks, so that long arrays aren't copied for each."""
    grow = "(a, v) -> concat(a, array(element_at(a, -1) + v))"
    blocks = f"transform(sequence(0, int(ceil(size({n}) / {BLOCK})) - 1), b -> slice({n}, b * {BLOCK} + 1, {BLOCK}))"
    offsets = f"slice(aggregate(transform({blocks}, x -> aggregate(x, 0L, (s, v) -> s + v)), array(0L), {grow}), 1, int(ceil(size({n}) / {BLOCK})))"
    return f"flatten(zip_with({blocks}, {offsets}, (x, o) -> slice(aggregate(x, array(o), {grow}), 1, size(x))))"


def valid_sql(kind: str, m: str) -> str:
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    luhn = f"aggregate(transform(split(reverse({digits}), ''), (c, i) -> IF(i % 2 = 1, IF(int(c) > 4, 2 * int(c) - 9, 2 * int(c)), int(c))), 0, (s, v) -> s + v) % 10 = 0"
    return {
        "ip": f"forall(transform(split({m}, '[.]'), p -> regexp_replace(p, '^0+', '')), p -> length(p) <= 3 AND coalesce(try_cast(p AS int), 0) <= 255)",
        "card": f"length({digits}) BETWEEN 13 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
    }.get(kind, "true")


def found(d: DataFrame, name: str, pattern: str, need: str | None, where: str = "true") -> DataFrame:
    """Adds to d (which has t) a column ``name``: array of (s, e, m, l2, l1, r1) for matches m that where allows.

    l2, l1 and r1 are the words around it, lower-case, without punctuation at their ends; where there is none up to
    another match or the text's end, # or ^ and $.
    """
    marked = f"split(regexp_replace(t, {sql(pattern)}, '\\u0001$0\\u0002'), '[\\u0001\\u0002]')"
    d = d.withColumn("_p", F.expr(f"CASE WHEN {f'contains(t, {sql(need)})' if need else 't rlike ' + sql('[0-9@]')} THEN {marked} END"))
    d = d.withColumn("_p", F.expr("CASE WHEN size(_p) > 1 THEN _p END"))
    d = d.withColumn("_n", F.expr("transform(_p, x -> bigint(char_length(x)))"))
    d = d.withColumn("_s", F.expr(f"CASE WHEN _n IS NOT NULL THEN {starts_sql('_n')} END"))
    bare = lambda words: f"array_remove(transform({words}, x -> regexp_replace(x, {sql(EDGES)}, '')), '')"
    # of what lies between matches, three words at each end are looked at
    d = d.withColumn("_w", F.expr(f"transform(_p, (p, i) -> IF(i % 2 = 0, array_remove(split(lower(p), {sql(SPLIT)}), ''), NULL))"))
    d = d.withColumn("_c", F.expr(f"transform(_w, w -> struct({bare('slice(w, greatest(size(w) - 2, 1), 3)')} AS l, {bare('slice(w, 1, 3)')} AS r))")).drop("_w")
    zipped = "arrays_zip(_p, _s, _n, slice(concat(array(element_at(_c, 1)), _c), 1, size(_c)), slice(_c, 2, size(_c)), transform(_c, (c, i) -> i + 2 < size(_c)))"
    word = lambda words, at, end: f"coalesce(try_element_at({words}, {at}), {end})"
    left, right = "IF(i = 1, '^', '#')", "IF(x.`5`, '#', '$')"
    odd = (
        f"filter(transform({zipped}, (x, i) -> IF(i % 2 = 1, struct(x.`_s` AS s, x.`_s` + x.`_n` AS e, x.`_p` AS m, {word('x.`3`.l', -2, left)} AS l2, {word('x.`3`.l', -1, left)} AS l1,"
        f" {word('x.`4`.r', 1, right)} AS r1), NULL)), x -> x IS NOT NULL)"
    )
    d = d.withColumn("_m", F.expr(f"CASE WHEN _s IS NOT NULL THEN {odd} END")).drop("_p", "_n", "_s", "_c")
    return d.withColumn(name, F.expr(f"coalesce(filter(_m, x -> {where}), array())")).drop("_m")


def base_spans(docs: DataFrame, hide: str = "false") -> DataFrame:
    """doc, row (a number of its own), base (array of (rank, kind, s, e, m, l2, l1, r1), secrets too) and candidates.
    hide: SQL over a seed's x.m; such seeds are left out, to see whether they are found again."""
    d = docs.select(F.col("doc_id").alias("doc"), F.expr("translate(coalesce(text, ''), '\\u0001\\u0002', '\\u0003\\u0003')").alias("t"))
    for kind, pattern in SEEDS.items():
        d = found(d, kind, pattern, NEEDS.get(kind), f"{valid_sql(kind, 'x.m')} AND NOT ({hide})")
    d = found(d, "candidates", TOKEN, None).drop("t")
    ranked = [f"transform({k}, x -> struct({i} AS rank, '{k}' AS kind, x.s AS s, x.e AS e, x.m AS m, x.l2 AS l2, x.l1 AS l1, x.r1 AS r1))" for i, k in enumerate(SEEDS)]
    return d.select("doc", F.monotonically_increasing_id().alias("row"), *(F.size(k).cast("long").alias(f"n_{k}") for k in SEEDS), F.expr(f"concat({', '.join(ranked)})").alias("base"), "candidates")


def parts(base: DataFrame) -> DataFrame:
    """row, run, s, e, val, l2, l1, r1 of every part of every candidate: up to GROUPS consecutive groups of its run of
    groups, without punctuation at the ends."""
    c = base.select("row", F.explode("candidates").alias("c")).select("row", F.col("c.s").alias("run"), "c.l2", "c.l1", "c.r1", F.split("c.m", " ").alias("g"))
    c = c.withColumn("o", F.expr(f"CASE WHEN size(g) = 1 THEN array(0L) ELSE {starts_sql('transform(g, x -> bigint(char_length(x) + 1))')} END"))
    each = f"transform(sequence(1, least({GROUPS}, size(z.g) - i)), k -> struct(get(z.o, i) AS o, array_join(slice(z.g, i + 1, k), ' ') AS m, i = 0 AS first, i + k = size(z.g) AS last))"
    c = c.withColumn("x", F.explode(F.expr(f"transform(array(struct(g, o)), z -> flatten(transform(sequence(0, size(z.g) - 1), i -> {each})))[0]"))).select("row", "run", "l2", "l1", "r1", "x.*")
    c = c.withColumn("v", F.regexp_replace("m", r"[^A-Za-z0-9)]+$", ""))
    many = lambda s: F.length("v") - F.length(F.replace("v", F.lit(s)))
    c = c.withColumn("v", F.when(many(")") > many("("), F.regexp_replace("v", "[)]$", "")).otherwise(F.col("v")))
    lead = F.when(many("(") > many(")"), F.regexp_extract("v", r"^([^A-Za-z0-9+(]*[(]?)", 1)).otherwise(F.regexp_extract("v", "^([^A-Za-z0-9+(]*)", 1))
    c = c.withColumn("lead", F.length(lead)).withColumn("val", F.expr("substring(v, lead + 1)")).filter(F.length("val") >= MIN_CHARS)
    s = F.col("run") + F.col("o") + F.col("lead")
    inner = lambda edge, c: F.when(F.col(edge), F.col(c)).otherwise(F.lit("#"))
    return c.select("row", "run", s.alias("s"), (s + F.length("val")).alias("e"), "val", inner("first", "l2").alias("l2"), inner("first", "l1").alias("l1"), inner("last", "r1").alias("r1"))


def short(c: Column) -> Column:
    return F.when(F.length(c) > LONG, F.sha2(c.cast("binary"), 256)).otherwise(c)


def patterns_of(val: Column) -> Column:
    """The lexical patterns of an instance with columns l2, l1 and r1."""
    exact = F.regexp_replace(F.regexp_replace(F.lower(val), r"\p{L}+", "a"), "[0-9]", "9")
    some = [
        F.concat(F.lit("two before: "), "l2", F.lit(" "), "l1"), F.concat(F.lit("before: "), "l1"), F.concat(F.lit("after: "), "r1"), F.concat(F.lit("around: "), "l1", F.lit(" _ "), "r1"),
        F.concat(F.lit("shape: "), exact), F.concat(F.lit("form: "), F.regexp_replace(exact, "9+", "9")),
    ]
    return F.array_distinct(F.array(*(short(c) for c in some)))


def fits(kind: Column, val: Column) -> Column:
    """Whether val may be of the kind: an email has @, the others have digits enough; and what the kind's expression
    describes as a whole must pass its check."""
    digits = F.length(F.regexp_replace(val, "[^0-9]", ""))
    whole = {"ip": r"^[0-9]+(\.[0-9]+){3}$", "card": r"^[0-9]([\x20-]?[0-9])+$", "phone": r"^\+[0-9][\x20().0-9-]+[0-9]$"}
    out = F.when(kind == "email", val.contains("@")).when(kind == "secret", (F.length(val) >= 16) & val.rlike("^[A-Za-z0-9_+/=-]*$") & val.rlike("[A-Za-z]"))
    for k, p in whole.items():
        out = out.when((kind == k) & val.rlike(p), F.expr(valid_sql(k, "val")))
    return out.otherwise(digits >= MIN_CHARS)


def instances(base: DataFrame) -> DataFrame:
    """row, run, s, e, val, kind and patterns: a row per seed, and (null kind) per part of a candidate that overlaps none."""
    seeds = base.select("row", F.explode("base").alias("b")).select("row", F.col("b.s").alias("run"), "b.s", "b.e", F.col("b.m").alias("val"), "b.l2", "b.l1", "b.r1", "b.kind")
    rows = seeds.unionByName(parts(base).withColumn("kind", F.lit(None).cast("string")))
    # of a row; its tokens are never more than its text
    by = Window.partitionBy("row")
    seed = F.col("kind").isNotNull()
    reach = F.max(F.when(seed, F.col("e"))).over(by.orderBy("s").rangeBetween(Window.unboundedPreceding, 0))
    next_ = F.min(F.when(seed, F.col("s"))).over(by.orderBy(F.desc("s")).rangeBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"reach": reach, "next": next_}).filter(seed | ((F.coalesce("reach", F.lit(0)) <= F.col("s")) & (F.coalesce("next", F.col("e")) >= F.col("e"))))
    return rows.select("row", "run", "s", "e", short(F.lower("val")).alias("id"), "val", "kind", patterns_of(F.col("val")).alias("patterns"))


def learned(rows: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """rows: of instances. Returns (kind, pattern, p) of patterns with a score p of MIN_SCORE and MIN_SEEDS distinct seeds.

    A pattern's score is its instances' mean score, a little less with few of them; an instance's is 1 for a seed, else
    a part (TRUST) of its best pattern's score. What a kind's own check rejects is none of its instances.
    """
    pairs = rows.select("id", "val", "kind", F.explode("patterns").alias("pattern")).groupBy("pattern", "id", "kind").agg(F.min("val").alias("val"))
    pairs = scratch.table(pairs, "pairs")
    support = pairs.filter("kind IS NOT NULL").groupBy("kind", "pattern").agg(F.count_distinct("id").alias("seeds")).filter(F.col("seeds") >= MIN_SEEDS)
    path = scratch.write(support, "support")
    kept = scratch.spark.read.parquet(path).withColumnRenamed("kind", "of")
    kept = F.broadcast(kept) if scratch.small(path) else kept.hint("merge")
    edges = pairs.join(kept, "pattern").select(F.col("of").alias("kind"), "pattern", "id", "val", F.coalesce(F.col("kind") == F.col("of"), F.lit(False)).alias("seed"))
    edges = edges.filter(F.col("seed") | fits(F.col("kind"), F.col("val"))).groupBy("kind", "pattern", "id").agg(F.max("seed").alias("seed"))
    now = scratch.table(edges.withColumn("score", F.when(F.col("seed"), 1.0).otherwise(0.0)), "edges")
    for n in range(rounds):
        patterns = now.groupBy("kind", "pattern").agg((F.sum("score") / (F.count(F.lit(1)) + 0.5)).alias("p"), F.count_if("seed").alias("seeds"))
        if n == rounds - 1:
            return patterns.filter((F.col("p") >= MIN_SCORE) & (F.col("seeds") >= MIN_SEEDS)).select("kind", "pattern", "p")
        scored = now.drop("score").join(patterns.select("kind", "pattern", "p"), ["kind", "pattern"])
        values = scored.groupBy("kind", "id").agg(F.when(F.max("seed"), 1.0).otherwise(TRUST * F.max("p")).alias("score"))
        now = scratch.table(scored.drop("p").join(values, ["kind", "id"]).select("kind", "pattern", "id", "seed", "score"), f"round{n}")
    raise ValueError("rounds is 1 at least")


def _joined(spans: str, secret: bool = False) -> str:
    """SQL: kind:start:end by kind as listed, then start, of an array of (rank, kind, s, e)."""
    return f"array_join(transform(sort_array(filter({spans}, x -> (x.kind = 'secret') = {str(secret).lower()})), x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"


def personal_data(docs: DataFrame, rounds: int = ROUNDS, hide: str = "false") -> DataFrame:
    """Returns a row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found, n_secret,
    secret_spans, n_private.

    Counts and base_sha256 are of base entities; spans has what patterns add too (n_found of them). Secrets are apart
    from personal data; n_private counts all spans of both. Positions are code points, ends exclusive. Found spans
    overlap neither base entities nor each other: of those that overlap, the leftmost and then the longest stays, with
    the kind of its best pattern (ties: as listed). A null text is empty. Repeated rows get the same spans; an empty
    table gives an empty result. Other columns are ignored.
    """
    require(docs, "doc_id", "text")
    scratch = Scratch(docs.sparkSession, "pii")
    base = scratch.table(base_spans(docs, hide), "base")
    rows = scratch.table(instances(base), "instances")
    path = scratch.write(learned(rows, scratch, rounds), "patterns")
    patterns = scratch.spark.read.parquet(path).withColumnRenamed("kind", "of")
    patterns = F.broadcast(patterns) if scratch.small(path) else patterns.hint("merge")
    rank = F.element_at(F.create_map(*(F.lit(x) for i, k in enumerate(SEEDS) for x in (k, i))), F.col("of"))
    new = rows.filter("kind IS NULL").select("row", "run", "s", "e", "val", F.explode("patterns").alias("pattern")).join(patterns, "pattern").filter(fits(F.col("of"), F.col("val")))
    new = new.groupBy("row", "run", "s", "e").agg(F.min(F.struct((-F.col("p")).alias("p"), rank.alias("rank"), F.col("of").alias("kind"))).alias("b"))
    new = new.groupBy("row", "run").agg(F.sort_array(F.collect_list(F.struct("s", (-F.col("e")).alias("e"), "b.rank", "b.kind"))).alias("xs"))  # of one run
    keep = "aggregate(xs, struct(-1L AS last, cast(array() AS array<struct<rank:int,kind:string,s:bigint,e:bigint>>) AS got), (a, x) -> IF(x.s < a.last, a, struct(-x.e AS last, concat(a.got, array(struct(x.rank AS rank, x.kind AS kind, x.s AS s, -x.e AS e))) AS got))).got"
    extra = new.groupBy("row").agg(F.flatten(F.collect_list(F.expr(keep))).alias("extra"))  # of one document
    done = base.drop("candidates").join(extra, "row", "left").withColumn("all", F.expr("concat(transform(base, x -> struct(x.rank AS rank, x.kind AS kind, x.s AS s, x.e AS e)), coalesce(extra, array()))"))
    base_only = "transform(base, x -> struct(x.rank AS rank, x.kind AS kind, x.s AS s, x.e AS e))"
    return done.select(
        F.col("doc").alias("doc_id"), *(f"n_{k}" for k in KINDS), F.sha2(F.expr(_joined(base_only)).cast("binary"), 256).alias("base_sha256"), F.expr(_joined("all")).alias("spans"),
        F.expr("bigint(size(filter(coalesce(extra, array()), x -> x.kind <> 'secret')))").alias("n_found"), F.expr("bigint(size(filter(all, x -> x.kind = 'secret')))").alias("n_secret"),
        F.expr(_joined("all", True)).alias("secret_spans"), F.size("all").cast("long").alias("n_private"),
    )
