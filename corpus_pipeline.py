"""A corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing to target weights, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrymill.llm import bpe, exact_dedup, langid, mixing, simhash
from quarrymill.llm.common import Scratch, own, whole_row


#: With its id, a row's key: a null id or one that repeats doesn't name a row.
SHA = "unhex(sha2(text, 256))"


def _kept(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, sha, row) of docs whose doc_id and SHA, nulls too, are a row's kept_id and kept_sha."""
    rows = docs.select(F.col("doc_id").alias("id"), F.expr(SHA).alias("sha"), whole_row(docs).alias("row"))
    return rows.join(keys, F.col("id").eqNullSafe(F.col("kept_id")) & F.col("sha").eqNullSafe(F.col("kept_sha")), "left_semi")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what language ID rejects. Decisions are made beside the whole row, so nothing is joined: ids may be null or
    repeat, and each row is judged by its own text. No rows, or none with a language, give none."""
    return langid.accepted(docs, langid.fit_documents(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly the rows that exact dedup keeps. Of rows with one id and one text it keeps one: the least by its other columns
    as JSON, which orders any type, maps too."""
    rows = docs.select(F.struct(F.col("doc_id").alias("id"), F.expr(SHA).alias("sha")).alias("key"), "text")
    keys = exact_dedup.exact_dedup(rows, "key").filter("kept").select(F.col("key.id").alias("kept_id"), F.col("key.sha").alias("kept_sha"))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = _kept(docs, keys).withColumn("rest", F.to_json(F.struct(*(F.col("row")[c].alias(f"c{i}") for i, c in enumerate(others)))) if others else F.lit(""))
    return rows.groupBy("id", "sha").agg(F.min_by("row", "rest").alias("row")).select(*own("row", docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document whose key names its component stays: the smallest id, null last, then the smallest SHA. Rows that
    repeat as a whole stay as often as they are; exact dedup, which comes before, leaves none."""
    rows = docs.select(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.expr(SHA).alias("sha")).alias("key"), "text")
    keys = simhash.near_dedup(rows, "key").filter(F.col("key").eqNullSafe(F.col("component_id"))).select(F.col("key.id").alias("kept_id"), F.col("key.sha").alias("kept_sha"))
    return _kept(docs, keys).select(*own("row", docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by their cell's probability. Repeated rows have one decision, null ids are told apart by texts."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per row: doc_id, n_tokens and digests. Null ids stay null."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing to target weights", mix_sources),
    ("byte-level BPE", tokenize),
]

#: Language ID, fingerprints and BPE aren't SQL; tests compare run() with a version by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        path = scratch.write(stage(spark, docs, sf_dir), f"stage{n}")
        docs = spark.read.parquet(path)
    return docs
