"""Language ID by nearest centroids.

Texts are lower-cased; hashed byte 2- and 3-grams are weighted by TF-IDF and normalised. Each language has several
centroids, clustered by cosine from a bounded sample of labelled documents; document frequencies are counted over
all training documents. A document goes to the language of its nearest centroid, and is rejected if that is too far.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import bound_arrow, named, require

DIMS = 8192
#: Bound of the labelled sample from which centroids are clustered, over all languages.
SAMPLE_DOCS = 1600
CENTROIDS = 4
#: Centroids of all languages together, if a language has more than one; and languages, beyond which fit() raises. They
#: bound what every task gets (DIMS * 4 bytes each).
MAX_CENTROIDS = 512
MAX_LANGUAGES = 4096
#: Of the sample, this part isn't clustered; its cosines to the nearest centroid set the bound of rejection.
HELD_BACK = 0.25
#: A document is rejected if the cosine to its nearest centroid is under SLACK times this quantile of them; under
#: MIN_COSINE it always is.
QUANTILE = 0.01
SLACK = 0.5
MIN_COSINE = 0.05
ROUNDS = 12
UNKNOWN = "und"

_FOLD = bytes(i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
_SHIFT = np.uint32(32 - DIMS.bit_length() + 1)


def has_letter(text: str) -> bool:
    return bool(re.search("[A-Za-z]", text)) or any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """Counts of hashed 2- and 3-grams of a whole text."""
    folded = b" " + b" ".join(text.lower().encode().translate(_FOLD).split()) + b" "
    out = np.zeros(DIMS, np.int64)
    whole = np.frombuffer(folded, np.uint8)
    for at in range(0, max(len(whole) - 1, 1), 1 << 18):  # by pieces that overlap, for bounded memory
        x = whole[at : at + (1 << 18) + 2].astype(np.uint32)
        pair = x[:-1] * _A + x[1:] * _B
        # the last piece has one 2-gram more than 3-grams; others leave it to the next piece
        last = at + (1 << 18) + 2 > len(whole)
        out += np.bincount((pair if last else pair[:-1]) >> _SHIFT, minlength=DIMS)
        if len(x) > 2:
            out += np.bincount((pair[:-1] + x[2:] * _C) * _A >> _SHIFT, minlength=DIMS)
    return out


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(tf, dtype=np.float32) * idf
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n == 0, 1, n)


def cluster(v: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from a farthest-first start; ties go to the lower row, so it is deterministic."""
    c = [v.mean(0)]
    for _ in range(min(k, len(v)) - 1):
        c.append(v[np.argmin((v @ np.stack(c).T).max(1))])
    c = np.stack(c)
    for _ in range(ROUNDS):
        own = (v @ c.T).argmax(1)
        c = np.stack([v[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.linalg.norm(c, axis=1, keepdims=True) + 1e-12
    return c.astype(np.float32)


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    """The language of each centroid."""
    centroids: np.ndarray
    idf: np.ndarray
    bound: float = MIN_COSINE
    """Documents whose cosine is lower are rejected."""

    def nearest(self, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.langs:
            return np.full(len(tf), -1), np.zeros(len(tf))
        s = vectors(tf, self.idf) @ self.centroids.T
        best = s.argmax(1)
        return best, np.clip(s[np.arange(len(s)), best], 0, 1).astype(float)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(DIMS, np.int64), 0
    for b in batches:
        for t in b.column(0):
            df += counts(t.as_py()) > 0
            n += 1
    if n:
        yield pa.record_batch([pa.array(np.r_[-1, np.arange(DIMS)].astype(np.int32)), pa.array(np.r_[n, df])], ["gram", "df"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            tf = counts(b.column(2)[i].as_py())
            at = np.flatnonzero(tf)
            yield pa.record_batch([b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([at.astype(np.int32)]), pa.array([tf[at].astype(np.int32)])], ["u", "lang", "at", "tf"])


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS, k: int = CENTROIDS) -> Model:
    """train: labelled rows; rows without text, letters or language don't count.

    The sample takes sample_docs / languages documents of each language (one at least), or all if it has fewer: those
    with the lowest hashes of key_col, ties by their texts. It is cut in Spark, so no more rows reach the driver, however
    many share a key; as sparse counts, at most DIMS each. Every language is learned; more than MAX_LANGUAGES raise.
    """
    bound_arrow(train.sparkSession)
    train = train.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.pmod(F.xxhash64(F.col(key_col).cast("string")), F.lit(1 << 40)).alias("u")).filter("text is not null and lang is not null and text rlike '\\\\p{L}'")
    by = {r.lang: (r.n, r.low) for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("low")).limit(MAX_LANGUAGES + 1).collect()}
    if len(by) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    sums = {r.gram: r.df for r in train.select("text").mapInArrow(_frequencies, "gram int, df long").groupBy("gram").agg(F.sum("df").alias("df")).collect()}
    n = sums.get(-1, 0)
    idf = np.log((1 + n) / (1 + np.array([sums.get(i, 0) for i in range(DIMS)]))).astype(np.float32) + np.float32(0.1)
    if not by:
        return Model((), np.zeros((0, DIMS), np.float32), idf)
    share = max(1, sample_docs // len(by))
    want = F.create_map(*(F.lit(x) for lang, (size, low) in sorted(by.items()) for x in (lang, max(low + 1, int((1 << 40) * min(1.0, 1.5 * share / size))))))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("u", F.xxhash64("text"), "text"))  # of the few that are left
    few = train.filter(F.col("u") < want[F.col("lang")]).withColumn("place", place).filter(F.col("place") <= share)
    picked = few.select("u", "lang", "text").mapInArrow(_sparse, "u long, lang string, at array<int>, tf array<int>").toArrow()
    rows: dict[str, list] = {}
    for i, (u, lang) in enumerate(zip(picked["u"].to_pylist(), picked["lang"].to_pylist(), strict=True)):
        rows.setdefault(lang, []).append((u, i))
    langs, parts, scores = [], [], []
    for lang in sorted(rows):
        some = sorted(rows[lang], key=lambda x: (x[0], picked["at"][x[1]].values.to_numpy().tobytes(), picked["tf"][x[1]].values.to_numpy().tobytes()))[:share]
        tf = np.zeros((len(some), DIMS), np.float32)
        for i, (_, at) in enumerate(some):
            tf[i, picked["at"][at].values.to_numpy()] = picked["tf"][at].values.to_numpy()
        v = vectors(tf, idf)
        back = int(len(v) * HELD_BACK)
        c = cluster(v[back:], max(1, min(k, MAX_CENTROIDS // len(rows))))
        scores += (v[:back] @ c.T).max(1).tolist()
        langs += [lang] * len(c)
        parts.append(c)
    bound = max(MIN_COSINE, SLACK * float(np.quantile(scores, QUANTILE))) if scores else MIN_COSINE
    return Model(tuple(langs), np.concatenate(parts), idf, bound)


def _judged(docs: DataFrame, model: Model, columns: list[str], text_col: str, min_cosine: float | None) -> DataFrame:
    """columns of docs as c0, c1, ..., and lang_pred, score, rejected."""
    spark = docs.sparkSession
    bound_arrow(spark)
    shared = spark.sparkContext.broadcast(model)  # DIMS * 4 bytes for each of MAX_LANGUAGES centroids at most
    bound = model.bound if min_cosine is None else min_cosine
    own = docs.select(*(named(c).alias(f"c{i}") for i, c in enumerate(columns)), F.col(text_col).alias("text"))
    names = [*own.columns[:-1], "lang_pred", "score", "rejected"]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own.schema.fields[:-1]) + "lang_pred string, score double, rejected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column(b.num_columns - 1)
            for at in range(0, b.num_rows, 128):
                part = [t.as_py() or "" for t in texts[at : at + 128]]
                known = np.array([has_letter(t) for t in part])
                best, score = m.nearest(np.stack([counts(t) if ok else np.zeros(DIMS, np.int64) for t, ok in zip(part, known, strict=True)]))
                known &= best >= 0
                score = np.where(known, score, 0.0)
                lang = [m.langs[i] if ok else UNKNOWN for i, ok in zip(best, known, strict=True)]
                rows = [b.column(i).slice(at, 128) for i in range(b.num_columns - 1)]
                yield pa.record_batch([*rows, pa.array(lang, pa.string()), pa.array(score), pa.array(~known | (score < bound))], names)

    return own.mapInArrow(run, schema)


def predict(docs: DataFrame, model: Model, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", min_cosine: float | None = None) -> DataFrame:
    """id_cols, lang_pred, score and rejected, a row per row of docs.

    lang_pred is the nearest centroid's language, `und` if the text is null or has no letter, or if no language was
    learned; score is the cosine, 0 for `und`. rejected: `und`, or a cosine under the model's bound (or min_cosine).
    Ties go to the first centroid of the first language in order.
    """
    require(docs, *id_cols, text_col)
    judged = _judged(docs, model, list(id_cols), text_col, min_cosine)
    return judged.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(id_cols)), "lang_pred", "score", "rejected")


def accepted(docs: DataFrame, model: Model, text_col: str = "text", min_cosine: float | None = None) -> DataFrame:
    """The rows of docs that aren't rejected, with their own columns, whatever their names. Rows travel whole, so nothing
    is joined and repeated or null ids don't matter."""
    names = docs.columns
    judged = _judged(docs, model, names, text_col, min_cosine)
    return judged.filter("NOT rejected").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))


def held_out(id_col: str = "doc_id") -> F.Column:
    """Documents that are never learned from; a null id is not held out, but isn't learned from either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_documents(docs: DataFrame, id_col: str = "doc_id") -> Model:
    return fit(docs.filter(F.col(id_col).isNotNull() & ~held_out(id_col)), key_col=id_col)


def language_id(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Fits on documents that aren't held out and predicts all: id_col, held_out, lang_pred, score, rejected."""
    require(docs, id_col, "text", "lang")
    return predict(docs, fit_documents(docs, id_col), (id_col,)).withColumn("held_out", held_out(id_col))
