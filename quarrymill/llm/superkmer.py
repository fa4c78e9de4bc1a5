"""Substring dedup by super-k-mer partitioning.

A window is 13 consecutive words. Its minimiser is its 3-word sequence with the least hash; consecutive windows with
the same minimiser travel as one packed string (a super-k-mer) to the minimiser's bucket, where windows are sorted
and counted exactly. Super-k-mers that a mapper has met already in a smaller document are decided there, so a passage
of a third of all documents arrives once per mapper's batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bound_arrow, require
from .spans import RANGES, ROWS, apply_ranges, bucket_count, counted, equal_groups, keyed, mapper, mixed, range_hashes, range_rows

WINDOW = 13
MER = 3
#: Bytes of text that a mapper works on at once, and of packed strings that it gathers for its buckets.
CHUNK = 2 << 20
PACK = 48 << 20
#: Windows that a bucket's task sorts at once; more are sorted in passes by their hash.
SORTED = 4 << 20
#: Windows that go at once.
BLOCK = 1 << 18
#: Bytes of text of a bucket on average.
BUCKET_BYTES = 4 << 20
#: Memory that counter() takes for a window and for a word of its strings: the most that was measured, on long
#: strings of one-letter words and on short ones.
PER_WINDOW, PER_WORD = 130, 45
#: A super-k-mer has so many windows at most.
LONGEST = 4096


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data: words that single bytes of space or newline part, newline last. Starts and stops of words."""
    stop = np.flatnonzero((data == 32) | (data == 10))
    return np.r_[0, stop[:-1] + 1], stop


def super_kmers(rows: list[tuple], window: int = WINDOW, mer: int = MER, longest: int = LONGEST):
    """rows: (doc, mark, text bytes). The chunk's normalised bytes and, for each super-k-mer, row, first word, number of
    windows, byte range and minimiser; and the window."""
    texts = [b" ".join(t.split()) for _, _, t in rows]
    have = [i for i, t in enumerate(texts) if t]
    data = b"\n".join([texts[i] for i in have] + [b""])
    empty = np.empty(0, np.int64)
    none = (data, empty, empty, empty, empty, empty, empty.astype(np.uint64), window)
    if not have:
        return none
    raw = np.frombuffer(data, np.uint8)
    start, stop = word_bounds(raw)
    last = np.flatnonzero(raw[stop] == 10)
    first = np.r_[0, last[:-1] + 1]
    row = np.repeat(np.array(have), last - first + 1)
    in_row = np.arange(len(start)) - np.repeat(first, last - first + 1)
    n = len(start) - window + 1
    if n <= 0:
        return none
    words = range_hashes(raw, start, stop)
    h = mer_hashes(words, mer)
    span, low = window - mer + 1, h
    width = 1
    while 2 * width <= span:  # minima of doubling width, then two that overlap
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[span - width : span - width + n]) if width < span else low[:n]
    ok = row[:n] == row[window - 1 : window - 1 + n]
    new = ok & np.r_[True, ~ok[:-1] | (row[1:n] != row[: n - 1]) | (low[1:] != low[:-1])]
    at = np.flatnonzero(new)
    if not len(at):
        return none
    # a run ends before the next one, or where its document's windows end
    size = np.add.reduceat(ok.astype(np.int64), at)
    if size.max() > longest:
        pieces = -(-size // longest)
        part = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at, size = np.repeat(at, pieces) + part * longest, np.minimum(np.repeat(size, pieces) - part * longest, longest)
    return data, row[at], in_row[at], size, start[at], stop[at + size + window - 2], low[at], window


def mer_hashes(words: np.ndarray, mer: int = MER) -> np.ndarray:
    m = len(words) - mer + 1
    h = words[:m].copy()
    for i in range(1, mer):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[i : m + i]
    return mixed(h)


def minimisers(strings: list[bytes], window: int = WINDOW, mer: int = MER) -> np.ndarray:
    """Of super-k-mers: the least hash in the first window, as all of their windows share it."""
    raw = np.frombuffer(b"\n".join([*strings, b""]), np.uint8)
    start, stop = word_bounds(raw)
    begin = np.r_[0, np.flatnonzero(raw[stop] == 10)[:-1] + 1]
    h = mer_hashes(range_hashes(raw, start, stop), mer)
    return np.minimum.reduce([h[begin + i] for i in range(window - mer + 1)])


def windows(strings: list[bytes], window: int = WINDOW):
    """The strings' bytes and, for each window, its string, place in it, and start and stop in the bytes; and the window."""
    data = b"\n".join([*strings, b""])
    raw = np.frombuffer(data, np.uint8)
    start, stop = word_bounds(raw)
    last = np.flatnonzero(raw[stop] == 10)
    begin = np.r_[0, last[:-1] + 1]
    left = np.repeat(last, last - begin + 1) - np.arange(len(start))  # words that follow in the string
    win = np.flatnonzero(left >= window - 1)
    del left
    string = np.searchsorted(last, win).astype(np.int32)
    return data, string, win - begin[string], start[win], stop[win + window - 1], window


def weights(strings: list[bytes], window: int = WINDOW) -> np.ndarray:
    """Of super-k-mers: the memory that counter() takes for each at most."""
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    words = np.fromiter((s.count(b" ") for s in strings), np.int64, len(strings)) + 1
    return 80 + 2 * size + PER_WORD * words + PER_WINDOW * (words - window + 1)


def later(doc: np.ndarray, mark: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    return doc > doc[first]


def counter(docs: np.ndarray, marks: np.ndarray, firsts: np.ndarray, strings: list[bytes], window: int = WINDOW, at_once: int = SORTED) -> Iterator[pa.RecordBatch]:
    """Super-k-mers of whole buckets, sorted by document: RANGES of words whose windows start in a smaller document too."""
    data, string, place, a, b, _ = windows(strings, window)
    place = place.astype(np.int32)  # of a string
    strings.clear()
    raw = np.frombuffer(data, np.uint8)
    h = range_hashes(raw, a, b)
    gone = np.zeros(len(string), bool)
    passes = max(1, -(-len(string) // at_once))
    for p in range(passes):  # each sorts the windows of its share of hashes
        own = np.flatnonzero(h % np.uint64(passes) == p) if passes > 1 else np.arange(len(string))
        d = docs[string[own]]
        gone[own] = d > d[equal_groups(data, a[own], b[own], h[own])]
    del h, a, b
    hits = np.flatnonzero(gone)
    for x in range(0, len(hits), BLOCK):
        hit = hits[x : x + BLOCK]
        s = string[hit]
        at = firsts[s] + place[hit]
        yield from range_rows(docs[s], marks[s], at, at + window)


def cut_words(text: bytes, ranges: np.ndarray) -> tuple[int, int, str]:
    words = text.split()
    if not len(ranges):
        return len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest()
    keep = np.ones(len(words), bool)
    for a, b in ranges.tolist():
        keep[a:b] = False
    return len(words), int((~keep).sum()), hashlib.sha256(b" ".join(compress(words, keep.tolist()))).hexdigest()


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, cut=cut_words, names=("n_words", "n_removed", "kept_sha256"), kinds=(pa.int64(), pa.int64(), pa.string()), schema="n_words long, n_removed long, kept_sha256 string") -> DataFrame:
    """Returns a row per row of docs: doc_id and what ``cut`` makes of the text and the ranges of words to remove.

    A word goes if a window of 13 words that covers it also starts in a document with a smaller id; windows are judged
    on the input. Windows repeated within a document only, or between rows of one id, stay. A null text has no words;
    a null id is larger than any other. Ids are integers under 2^63 - 1, which stands for null. An empty table gives an
    empty result. Other columns are ignored. A bucket may be of any size: what weighs more than
    spans.TASK_MEMORY goes through files.
    """
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    bound_arrow(spark)
    base = keyed(docs, id_col, text_col)
    n = bucket_count(base, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), BUCKET_BYTES)
    sent = base.mapInArrow(mapper(partial(super_kmers, window=window), n, CHUNK, PACK, False), ROWS)
    ranges = sent.repartition(n, "target").mapInArrow(counted(partial(counter, window=window, at_once=SORTED), partial(minimisers, window=window), partial(windows, window=window), partial(weights, window=window), later), RANGES)
    return apply_ranges(base, ranges, n, cut, list(names), list(kinds), schema)
