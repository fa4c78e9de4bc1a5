"""Suffix-array dedup of byte strings.

Shards: a document's 100-byte windows travel as super-k-mers (runs of windows with one 16-byte minimiser) to the
minimiser's shard, so equal windows meet. A shard first drops windows whose hash is unique in it (they can't repeat);
what is left is sorted by induced sorting: types, LMS substrings, ranks of the reduced string, and two induction
sweeps. The sweeps' priority queue has a bucket per byte; suffix tuples leave it in order and put their predecessors
in, so each bucket is a file of tuples in order, held in memory up to a bound and on disk beyond it. Suffixes that
share 100 bytes are neighbours then.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bound_arrow, require
from .spans import RANGES, ROWS, apply_ranges, bucket_count, counted, equal_groups, keyed, mapper, mixed, range_hashes, range_rows

WINDOW = 100
MER = 16
CHUNK = 1 << 20
PACK = 64 << 20
#: Pairs of suffixes that are compared at once.
BLOCK = 1 << 18
LONGEST = 4096
#: Bytes of text of a shard on average.
BUCKET_BYTES = 2 << 20
#: Memory that counter() takes for a window and for a string: the most that was measured, on periodic strings and on short
#: ones that repeat.
PER_WINDOW, PER_STRING = 55, 1700
#: Memory that a task may take for a shard: hot minimisers fill shards, and those that go through files cost twice the time.
TASK_MEMORY = 1200 << 20
#: Numbers that a priority queue holds in memory; tuples beyond it wait on disk.
QUEUE = 1 << 20


def super_kmers(rows: list[tuple], window: int = WINDOW, mer: int = MER, longest: int = LONGEST):
    """As superkmer.super_kmers, over bytes of raw texts."""
    sizes = np.array([len(t) for _, _, t in rows], np.int64)
    data = b"".join(t for _, _, t in rows)
    empty = np.empty(0, np.int64)
    n = len(data) - window + 1
    if n <= 0:
        return data, empty, empty, empty, empty, empty, empty.astype(np.uint64), window
    raw = np.frombuffer(data, np.uint8)
    h = mer_hashes(raw, mer)
    span, low, width = window - mer + 1, h, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[span - width : span - width + n])
    ends = np.cumsum(sizes)
    fits = np.zeros(n + 1, np.int8)  # +1 where a document's windows begin, -1 after them
    good = np.flatnonzero(sizes >= window)
    np.add.at(fits, ends[good] - sizes[good], 1)
    np.add.at(fits, np.minimum(ends[good] - window + 1, n), -1)
    ok = np.cumsum(fits[:n]).astype(bool)
    begin = np.zeros(n, bool)
    begin[(ends[good] - sizes[good])] = True
    at = np.flatnonzero(ok & (begin | np.r_[True, ~ok[:-1] | (low[1:] != low[:-1])]))
    if not len(at):
        return data, empty, empty, empty, empty, empty, empty.astype(np.uint64), window
    size = np.add.reduceat(ok.astype(np.int64), at)
    if size.max() > longest:
        pieces = -(-size // longest)
        part = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at, size = np.repeat(at, pieces) + part * longest, np.minimum(np.repeat(size, pieces) - part * longest, longest)
    row = np.searchsorted(ends, at, side="right")
    return data, row, at - (ends - sizes)[row], size, at, at + size + window - 1, low[at], window


class BucketQueue:
    """A priority queue of positions by byte, for input that comes in order: first in, first out in each bucket."""

    def __init__(self, limit: int):
        self.limit, self.held, self.n, self.file = limit, [[] for _ in range(256)], 0, None

    def put(self, byte: np.ndarray, position: np.ndarray) -> None:
        if not len(byte):
            return
        order = np.argsort(byte, kind="stable")
        b, p = byte[order], position[order]
        cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        for a, z in zip(cuts, [*cuts[1:], len(b)], strict=True):
            self.held[b[a]].append(p[a:z])
        self.n += len(p)
        if self.n > self.limit:
            self.spill()

    def spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()  # unlinked at once; only this task reads it
        self.file.seek(0, 2)
        for own in self.held:
            for i, x in enumerate(own):
                if isinstance(x, np.ndarray):
                    own[i] = (self.file.tell(), len(x), x.dtype)
                    self.file.write(x.tobytes())
        self.n = 0

    def take(self, byte: int) -> np.ndarray | None:
        """What a bucket holds, in order; it is empty then."""
        own, self.held[byte] = self.held[byte], []
        out = []
        for x in own:
            if isinstance(x, tuple):
                self.file.seek(x[0])
                x = np.frombuffer(self.file.read(x[1] * x[2].itemsize), x[2])
            else:
                self.n -= len(x)
            out.append(x)
        return np.concatenate(out) if out else None


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a:a+size] == data[b:b+size], eight bytes at a time; data has at least 8 bytes to spare."""
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    out, live, at = np.ones(len(a), bool), np.arange(len(a)), 0
    while len(live):
        live = live[size[live] > at]
        x = np.ascontiguousarray(words[a[live] + at]).view(np.uint64).ravel() ^ np.ascontiguousarray(words[b[live] + at]).view(np.uint64).ravel()
        rest = np.minimum(size[live] - at, 8).astype(np.uint64)
        same = x << (np.uint64(64) - np.uint64(8) * rest) == 0
        out[live[~same]] = False
        live, at = live[same], at + 8
    return out


def induce(text: np.ndarray, is_s: np.ndarray, lms: np.ndarray, limit: int) -> np.ndarray:
    """All suffixes, ordered as the order of ``lms`` induces: L types upwards, then S types downwards."""
    n = len(text)
    seeds = BucketQueue(limit)
    seeds.put(text[lms], lms)
    up, order_l = BucketQueue(limit), BucketQueue(limit)
    up.put(text[n - 1 :], np.array([n - 1], lms.dtype))  # the last suffix is L: a prefix sorts first
    for c in range(256):
        while (p := up.take(c)) is not None:
            order_l.put(text[p], p)
            prev = p[p > 0] - 1
            prev = prev[~is_s[prev]]
            if len(prev):
                up.put(text[prev], prev)
        if (p := seeds.take(c)) is not None:
            prev = p[p > 0] - 1
            prev = prev[~is_s[prev]]
            if len(prev):
                up.put(text[prev], prev)
    down, out = BucketQueue(limit), []
    for c in range(255, -1, -1):
        some = []
        while (p := down.take(c)) is not None:  # largest first
            some.append(p)
            prev = p[p > 0] - 1
            prev = prev[is_s[prev]]
            if len(prev):
                down.put(text[prev], prev)
        if (p := order_l.take(c)) is not None:
            p = p[::-1]
            some.append(p)
            prev = p[p > 0] - 1
            prev = prev[is_s[prev]]
            if len(prev):
                down.put(text[prev], prev)
        out += some
    return np.concatenate(out)[::-1]


def sort_suffixes(text: np.ndarray, depth: int, limit: int = QUEUE) -> np.ndarray:
    """Positions of text in the order of their suffixes' first ``depth`` bytes at least."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    kind = np.int32 if n < 1 << 31 else np.int64
    ends = np.flatnonzero(text[:-1] != text[1:])  # of runs of one byte, but for the last run, whose type is L
    is_s = np.zeros(n, bool)
    if len(ends):
        is_s[: ends[-1] + 1] = np.repeat(text[ends] < text[ends + 1], np.diff(ends, prepend=-1))
    del ends
    lms = (np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1).astype(kind)
    if len(lms) > 1:
        # LMS substrings in order: induce from any order, then pick the LMS suffixes
        flag = np.zeros(n, bool)
        flag[lms] = True
        got = induce(text, is_s, lms, limit)
        got = got[flag[got]]
        index = np.empty(n, kind)
        index[lms] = np.arange(len(lms))
        at = index[got]
        size = np.diff(np.r_[lms, n]) + 1  # up to the next LMS byte; the last one has no next
        size[-1] -= 1
        spare = np.r_[text, np.zeros(8, np.uint8)]
        same = (at[1:] != len(lms) - 1) & (at[:-1] != len(lms) - 1) & (size[at[1:]] == size[at[:-1]])
        pairs = np.flatnonzero(same)
        for a in range(0, len(pairs), BLOCK):
            some = pairs[a : a + BLOCK]
            same[some] = _equal(spare, got[some + 1], got[some], size[at[some + 1]])
        del pairs
        rank = np.empty(len(lms), np.int64)
        rank[at] = np.cumsum(np.r_[0, ~same])
        # the reduced string, by ranks of doubling length, as far as depth needs (a name spans 2 bytes at least)
        width = 1
        while width * 2 < depth + 2 and rank.max() < len(rank) - 1:
            key = rank * (len(rank) + 1)  # ranks of both halves in one number
            key[:-width] += rank[width:] + 1
            order = np.argsort(key)
            key = key[order]
            fresh = np.empty_like(rank)
            fresh[order] = np.cumsum(np.r_[False, key[1:] != key[:-1]])
            rank, width = fresh, width * 2
        lms = lms[np.argsort(rank, kind="stable")]
    return induce(text, is_s, lms, limit)


def repeats(data: np.ndarray, valid: np.ndarray, window: int, limit: int = QUEUE) -> np.ndarray:
    """For each place of ``valid`` (sorted), the lowest place of it with the same ``window`` bytes."""
    order = sort_suffixes(data, window, limit)
    flag = np.zeros(len(data), bool)
    flag[valid] = True
    order = order[flag[order]]
    del flag
    spare, new = np.r_[data, np.zeros(8, np.uint8)], np.ones(len(order), bool)
    for a in range(1, len(order), BLOCK):
        z = min(a + BLOCK, len(order))
        new[a:z] = ~_equal(spare, order[a:z], order[a - 1 : z - 1], np.full(z - a, window))
    at = np.flatnonzero(new)
    first = np.empty(len(data), order.dtype)
    first[order] = np.repeat(np.minimum.reduceat(order, at), np.diff(at, append=len(order)))
    return first[valid]


def mer_hashes(raw: np.ndarray, mer: int = MER) -> np.ndarray:
    h, width, scale = raw.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while width < mer:  # hashes of doubling width
        h = h[:-width] * np.uint64(scale) + h[width:]
        scale, width = scale * scale % (1 << 64), 2 * width
    return mixed(h)


def minimisers(strings: list[bytes], window: int = WINDOW, mer: int = MER) -> np.ndarray:
    """Of super-k-mers: the least hash in the first window, as all of their windows share it."""
    out = np.empty(len(strings), np.uint64)
    for at in range(0, len(strings), 4096):
        heads = mer_hashes(np.frombuffer(b"".join([s[:window] for s in strings[at : at + 4096]]), np.uint8), mer)
        begin = np.arange(min(4096, len(strings) - at)) * window
        out[at : at + 4096] = np.minimum.reduce([heads[begin + i] for i in range(window - mer + 1)])
    return out


def windows(strings: list[bytes], window: int = WINDOW):
    """As superkmer.windows, over bytes."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    begin, count = np.cumsum(sizes) - sizes, sizes - window + 1
    total = np.cumsum(count)
    kind = np.int32 if sizes.sum() < 1 << 31 else np.int64
    string = np.repeat(np.arange(len(sizes), dtype=np.int32), count)
    place = np.arange(total[-1] if len(total) else 0, dtype=kind)
    place -= np.repeat((total - count).astype(kind), count)
    start = place + begin.astype(kind)[string]
    return b"".join(strings), string, place, start, start + kind(window), window


def weights(strings: list[bytes], window: int = WINDOW) -> np.ndarray:
    """Of super-k-mers: the memory that counter() takes for each at most."""
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    return PER_STRING + 2 * size + PER_WINDOW * (size - window + 1)


def later(doc: np.ndarray, mark: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    return (first != np.arange(len(first))) & ~((doc == doc[first]) & (mark == mark[first]) & (at == at[first]))


def counter(docs: np.ndarray, marks: np.ndarray, firsts: np.ndarray, strings: list[bytes], window: int = WINDOW, limit: int = QUEUE) -> Iterator[pa.RecordBatch]:
    """Super-k-mers of whole shards in order of (document, start): RANGES of the windows that start earlier too."""
    data, string, place, start, stop, _ = windows(strings, window)
    raw, kind = np.frombuffer(data, np.uint8), start.dtype
    strings.clear()
    h = range_hashes(raw, start, stop)
    del stop
    ranked = np.sort(h)
    twins = ranked[1:][ranked[1:] == ranked[:-1]]  # hashes that occur again
    del ranked
    if not len(twins):
        return
    low = np.uint64((1 << 22) - 1)  # few windows of ordinary text have a twin: most are sent away by a small table
    some = np.zeros(1 << 22, bool)
    some[twins & low] = True
    win = np.flatnonzero(some[h & low])
    own = h[win]
    win = win[twins[np.minimum(np.searchsorted(twins, own), len(twins) - 1)] == own]
    del h, twins, own, some
    win = win.astype(kind)
    s, at, place = string[win], start[win], place[win]
    del string, start
    # runs of windows that may repeat become segments; equal segments are sorted once, by their first one
    cut = np.flatnonzero(np.r_[True, (np.diff(win) > 1) | (s[1:] != s[:-1])])
    n = np.diff(cut, append=len(win))
    del win
    a = at[cut].astype(np.int64)
    del at
    same = equal_groups(data, a, a + n + window - 1, range_hashes(raw, a, a + n + window - 1))
    is_own = same == np.arange(len(same))
    own = np.flatnonzero(is_own)
    length = n[own] + window - 1
    text = np.frombuffer(b"".join([data[x:y] for x, y in zip(a[own].tolist(), (a[own] + length).tolist(), strict=True)]), np.uint8)
    total = np.cumsum(n[own])
    valid = np.arange(total[-1], dtype=kind)  # windows' places in text
    valid += np.repeat((np.cumsum(length) - length - (total - n[own])).astype(kind), n[own])
    found = repeats(text, valid, window, limit)
    places = np.flatnonzero(np.repeat(is_own, n)).astype(kind)  # valid's windows among all
    found = places[np.searchsorted(valid, found)]  # the first equal window of each of valid's
    del valid, text, places
    base = np.empty(len(cut), np.int64)  # of a first segment's windows among valid
    base[own] = total - n[own]
    mine = np.arange(len(s), dtype=kind)  # a window's place in its segment, moved to its first equal segment
    mine += np.repeat((base[same] - cut).astype(kind), n)
    first = found[mine]
    del found, mine
    for x in range(0, len(s), BLOCK):
        f, i = first[x : x + BLOCK], np.arange(x, min(x + BLOCK, len(s)))
        i, f = i[f != i], f[f != i]
        d, m, at = docs[s[i]], marks[s[i]], place[i] + firsts[s[i]]
        # a repeated row has the same windows at the same places, which aren't earlier
        gone = np.flatnonzero((d != docs[s[f]]) | (m != marks[s[f]]) | (at != place[f] + firsts[s[f]]))
        yield from range_rows(d[gone], m[gone], at[gone], at[gone] + window)


def cut_bytes(text: bytes, ranges: np.ndarray) -> tuple[int, int, int, str]:
    digest, last = hashlib.sha256(), 0
    for a, b in ranges.tolist():
        digest.update(text[last:a])
        last = b
    digest.update(text[last:])
    return len(text), int((ranges[:, 1] - ranges[:, 0]).sum()), len(ranges), digest.hexdigest()


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, cut=cut_bytes, names=("n_bytes", "n_removed", "n_spans", "kept_sha256"), kinds=(pa.int64(), pa.int64(), pa.int64(), pa.string()), schema="n_bytes long, n_removed long, n_spans long, kept_sha256 string") -> DataFrame:
    """Returns a row per row of docs: doc_id and what ``cut`` makes of the text's bytes and the ranges to remove.

    A byte goes if a 100-byte string that covers it also starts earlier: in a document with a smaller id, or earlier in
    the same one; overlaps count, and strings are judged on the input. Rows with one id and one text are one document;
    rows with one id and different texts are in a fixed order, by a hash of the text. A null text has no bytes; a null
    id is larger than any other. Ids are integers under 2^63 - 1, which stands for null. An empty table gives an empty
    result. Other columns are ignored. A shard may be of any size: what weighs more than TASK_MEMORY goes through files,
    split by minimiser and sorted part by part; of a part that is still larger, windows are compared by shares of their
    hashes.
    """
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    bound_arrow(spark)
    base = keyed(docs, id_col, text_col)
    n = bucket_count(base, 6 * int(spark.conf.get("spark.sql.shuffle.partitions")), BUCKET_BYTES)
    sent = base.mapInArrow(mapper(partial(super_kmers, window=window), n, CHUNK, PACK, True), ROWS)
    ranges = sent.repartition(n, "target").mapInArrow(counted(partial(counter, window=window, limit=QUEUE), partial(minimisers, window=window), partial(windows, window=window), partial(weights, window=window), later, TASK_MEMORY), RANGES)
    return apply_ranges(base, ranges, n, cut, list(names), list(kinds), schema)
