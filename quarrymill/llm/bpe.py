"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bound_arrow, require

#: Texts are encoded in parts of about this many characters.
PART_CHARS = 1 << 16
#: A part may end between a printable ASCII character, letter or digit and a white space, or between a letter and a
#: digit: no match of the pattern spans such a place, and none looks ahead past it.
SAFE = r"(?<=[!-~\p{L}\p{N}])(?=[ \n\t\r])|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})"

_encoders: dict = {}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoder(path: str, pattern: str):
    """The encoding and its ids as decimal strings; one per Python worker."""
    if (path, pattern) not in _encoders:
        import tiktoken

        ranks = load_ranks(path)
        names = [""] * (max(ranks.values()) + 1)
        for i in ranks.values():
            names[i] = str(i)
        _encoders[path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), names
    return _encoders[path, pattern]


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """Splits a long text at safe boundaries; a single match longer than ``size`` stays whole."""
    if len(text) <= 2 * size:
        yield text
        return
    import regex

    safe, start = regex.compile(SAFE), 0
    while len(text) - start > 2 * size:
        cut = safe.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", emit: str = "digests") -> DataFrame:
    """Encodes every whole text, then decodes the ids to raw bytes.

    emit "ids": id_col, ids (array of int), decoded (binary). emit "digests": id_col, n_tokens, ids_sha256 (of the
    decimal ids joined by commas) and decoded_sha256. A null text is an empty text: no ids, no bytes. Special
    tokens' strings are ordinary text. Repeated rows and null ids give a row each; an empty table an empty result.
    A row never needs another one: there is no shuffle, and a lost task is run again.
    """
    require(docs, id_col, text_col)
    bound_arrow(docs.sparkSession)
    if emit not in ("ids", "digests"):
        raise ValueError("emit is ids or digests")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, names = encoder(ranks_path, pattern)
        for b in batches:
            n, a, d = [], [], []
            for text in b.column(1):
                ids_sha, raw_sha, count = hashlib.sha256(), hashlib.sha256(), 0
                for part in parts(text.as_py() or ""):
                    ids = enc.encode_ordinary(part)
                    if ids:
                        ids_sha.update((("," if count else "") + ",".join([names[i] for i in ids])).encode())
                        raw_sha.update(enc.decode_bytes(ids))
                        count += len(ids)
                n.append(count), a.append(ids_sha.hexdigest()), d.append(raw_sha.hexdigest())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _ = encoder(ranks_path, pattern)
        for b in batches:
            for i in range(b.num_rows):  # a row at a time: ids take more room than texts
                ids = [x for part in parts(b.column(1)[i].as_py() or "") for x in enc.encode_ordinary(part)]
                yield pa.record_batch([b.column(0).slice(i, 1), pa.array([ids], pa.list_(pa.int32())), pa.array([enc.decode_bytes(ids)], pa.binary())], [id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(id_col, text_col)
    if emit == "ids":
        return slim.mapInArrow(whole, f"`{id_col}` {kind}, ids array<int>, decoded binary")
    return slim.mapInArrow(digests, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
