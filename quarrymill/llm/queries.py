"""The queries of this subpackage: one per operator, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data

    return personal_data(_table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import suffix_dedup

    return suffix_dedup(_table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_dedup

    return near_dedup(_table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_decode

    return encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .superkmer import substring_dedup

    return substring_dedup(_table(spark, sf_dir, "documents"))


def op2_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(_table(spark, sf_dir, "documents"))


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    return archive_round_trip(_table(spark, sf_dir, "pages"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import language_id

    return language_id(_table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence_audit

    return divergence_audit(_table(spark, sf_dir, "documents"))


def op12_kdtree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kdtree import clustered

    return clustered(_table(spark, sf_dir, "embeddings"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .decontaminate import decontaminate

    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _oracles() -> dict[str, str]:
    from . import divergence, kdtree, mixing

    return {"op5_mixing": mixing.oracle(), "op11_source_divergence": divergence.oracle(), "op12_kdtree_clusters": kdtree.oracle()}


QUERIES = {f.__name__: f for f in (op1_superkmer_dedup, op2_divergence_rules, op3_warc_revisits, op4_exact_dedup, op5_mixing, op6_personal_data, op7_suffix_dedup, op8_simhash_near_dedup, op9_language_id, op10_bpe, op11_source_divergence, op12_kdtree_clusters, op13_decontamination)}

ORACLES = {
    "op1_superkmer_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 11, 1))) AS pos FROM w),
        k AS (SELECT doc_id, pos, md5(array_to_string(ws[pos:pos + 12], ' ')) AS win FROM p),
        d AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY win) < doc_id AS gone FROM k),
        g AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS pos FROM d WHERE gone),
        r AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS word FROM w),
        x AS (SELECT r.doc_id, r.pos, word, g.pos IS NOT NULL AS cut FROM r LEFT JOIN g USING (doc_id, pos)),
        s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (cut) AS c, string_agg(word, ' ' ORDER BY pos) FILTER (NOT cut) AS kept FROM x GROUP BY doc_id)
        SELECT w.doc_id, coalesce(n, 0) AS n_words, coalesce(c, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN s USING (doc_id)
    """,
    "op13_decontamination": r"""
        WITH b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
        w AS MATERIALIZED (SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[p:p + least(len(ws), 10) - 1], ' ') AS win FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS p FROM b WHERE len(ws) > 0)),
        d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        p AS (SELECT r, k, ws, unnest(range(1, len(ws) - k + 2)) AS pos FROM d, (SELECT DISTINCT k FROM w) WHERE len(ws) >= k),
        m AS MATERIALIZED (SELECT r, pos, p.k, item_id FROM p JOIN w ON p.k = w.k AND array_to_string(ws[pos:pos + p.k - 1], ' ') = win),
        h AS (SELECT r, count(DISTINCT i) AS n_hit FROM (SELECT r, unnest(range(pos, pos + k)) AS i FROM m) GROUP BY r),
        i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM m WHERE item_id IS NOT NULL) GROUP BY r)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)
    """,
    "op4_exact_dedup": r"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
        g AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
    """,
    "op3_warc_revisits": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS low FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND low <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND low <> page_id THEN low END AS refers_to FROM f
    """,
} | _oracles()
