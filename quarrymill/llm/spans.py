"""What the two substring dedups share: hashes of byte ranges, and applying found ranges to their documents."""

from __future__ import annotations

import itertools
import mmap
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Stands for a null id: larger than any other.
NULL_ID = (1 << 63) - 1

_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    name, base = ("inverse", INVERSE) if inverse else ("base", BASE)
    if len(_powers.get(name, ())) < n:
        p = np.full(n, base, np.uint64)
        p[0] = 1
        _powers[name] = np.multiply.accumulate(p)
    return _powers[name][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def range_hashes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of byte ranges, sorted by start, of one buffer, a block at a time for bounded memory. Equal ranges
    have equal hashes; equality is checked elsewhere."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        base = int(start[i])
        j = int(np.searchsorted(start, base + block))
        part = raw[base : int(stop[i:j].max(initial=base))]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part + np.uint64(1)) * powers(len(part)), out=sums[1:])
        a, b = start[i:j] - base, stop[i:j] - base
        out[i:j] = mixed((sums[b] - sums[a]) * powers(len(part) + 1, True)[a] + (b - a).astype(np.uint64))
        i = j
    return out


def first_of_equal(h: np.ndarray) -> np.ndarray:
    """For each number, the lowest index that has it."""
    order = np.argsort(h)
    at = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
    out = np.empty(len(h), np.int64)
    out[order] = np.repeat(np.minimum.reduceat(order, at), np.diff(np.r_[at, len(h)]))
    return out


def equal_groups(data: bytes, start: np.ndarray, stop: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each range, the lowest index of a range with the same bytes. Hashes only bring candidates together."""
    if not len(h):
        return np.empty(0, np.int64)
    out = first_of_equal(h)
    dup = np.flatnonzero(out != np.arange(len(h)))
    same = np.empty(len(dup), bool)
    for x in range(0, len(dup), 1 << 16):  # as Python's numbers take room
        own = dup[x : x + (1 << 16)]
        f = out[own]
        same[x : x + len(own)] = [data[a:b] == data[c:d] for a, b, c, d in zip(start[own].tolist(), stop[own].tolist(), start[f].tolist(), stop[f].tolist(), strict=True)]
    seen: dict[bytes, int] = {}
    for i in dup[~same].tolist():  # equal hashes of different bytes
        out[i] = seen.setdefault(data[start[i] : stop[i]], i)
    return out


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges as sorted ranges that neither meet nor overlap."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.r_[True, start[1:] > stop[:-1]]
    at = np.flatnonzero(new)
    return start[at], stop[np.r_[at[1:] - 1, len(stop) - 1]]


RANGES = "doc long, mark long, ranges binary"


def range_rows(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Ranges by document, merged, as rows of RANGES (pairs of 64-bit numbers)."""
    if not len(doc):
        return
    order = np.lexsort((start, mark, doc))
    doc, mark, start, stop = doc[order], mark[order], start[order], stop[order]
    cut = np.r_[True, (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])]
    cuts = np.flatnonzero(cut)
    # documents are laid one after the other, with a gap, and merged at once
    shift = (np.cumsum(cut) - 1) * (int(stop.max()) + 2)
    start, stop = merged(start + shift, stop + shift)
    shift = shift[cuts]
    own = np.searchsorted(start, shift, side="left")
    pairs = np.stack([start, stop], 1) - np.repeat(shift, np.diff(np.r_[own, len(start)]))[:, None]
    for at in range(0, len(cuts), 4096):
        ends = np.r_[own[at : at + 4097], len(start)][: min(4096, len(cuts) - at) + 1]
        offsets = (16 * (ends - ends[0])).astype(np.int32)
        data = pairs[ends[0] : ends[-1]].astype(np.int64).tobytes()
        blobs = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
        yield pa.record_batch([pa.array(doc[cuts[at : at + 4096]]), pa.array(mark[cuts[at : at + 4096]]), blobs], ["doc", "mark", "ranges"])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, mark, text): mark tells rows with the same id apart, unless their texts are equal too."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))


def packed(docs, marks, firsts, strings: list[bytes]) -> bytes:
    """Strings with their document, mark and first place, compressed."""
    import zstandard

    own, inverse = np.unique(np.stack([docs, marks], 1), axis=0, return_inverse=True)
    head = np.array([len(own), len(strings)], np.int64).tobytes()
    sizes = np.fromiter(map(len, strings), np.uint32, len(strings))
    body = b"".join([head, own.tobytes(), np.asarray(firsts, np.int64).tobytes(), inverse.astype(np.uint32).tobytes(), sizes.tobytes(), *strings])
    return zstandard.ZstdCompressor(level=3).compress(body)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m = np.frombuffer(raw, np.int64, 2).tolist()
    own = np.frombuffer(raw, np.int64, 2 * n, 16).reshape(-1, 2)
    at = 16 + 16 * n
    firsts = np.frombuffer(raw, np.int64, m, at)
    of = own[np.frombuffer(raw, np.uint32, m, at + 8 * m)]
    ends = np.cumsum(np.frombuffer(raw, np.uint32, m, at + 12 * m), dtype=np.int64) + at + 16 * m
    return of[:, 0], of[:, 1], firsts, [raw[a:b] for a, b in zip([at + 16 * m, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class Packer:
    """Gathers strings by target and gives packed rows (target, doc, mark, data) once there are enough."""

    names = ["target", "doc", "mark", "data"]

    def __init__(self, size: int):
        self.size, self.held, self.n = size, {}, 0

    def add(self, target: int, docs, marks, firsts, strings: list[bytes]) -> None:
        self.held.setdefault(target, []).append((docs, marks, firsts, strings))
        self.n += sum(map(len, strings)) + 80 * len(strings)

    def full(self) -> bool:
        return self.n >= self.size

    def flush(self) -> Iterator[pa.RecordBatch]:
        for k in sorted(self.held):
            parts = self.held.pop(k)
            blob = packed(*(np.concatenate([p[i] for p in parts]) for i in range(3)), [s for p in parts for s in p[3]])
            yield pa.record_batch([pa.array([k], pa.int64()), pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([blob], pa.binary())], self.names)
        self.n = 0


ROWS = "target long, doc long, mark long, data binary"
#: Bytes that a packer gathers.
PACK = 32 << 20


def mapper(chunker, buckets: int, chunk: int, pack: int, twice: bool):
    """Documents come in; rows of ROWS go out: packed super-k-mers by bucket, and (target under 0) ranges that are
    decided already, as a smaller document has the same string in the same chunk (twice: or the same one earlier)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Packer(pack)
        for rows in batched(batches, chunk):
            rows.sort(key=lambda r: r[:2])  # so that the first of equal strings is the one that stays
            rows = [r for r, before in zip(rows, [None, *rows], strict=False) if before is None or r[:2] != before[:2]]
            data, row, first, n, start, stop, low, span = chunker(rows)
            if not len(row):
                continue
            doc, mark = np.array([r[0] for r in rows], np.int64)[row], np.array([r[1] for r in rows], np.int64)[row]
            same = equal_groups(data, start, stop, range_hashes(np.frombuffer(data, np.uint8), start, stop))
            known = same != np.arange(len(same)) if twice else doc > doc[same]
            for b in range_rows(doc[known], mark[known], first[known], (first + n)[known] + span - 1):
                yield pa.record_batch([pa.array(-1 - (b.column(0).to_numpy() % 4096 + 4096) % 4096), *b.columns], Packer.names)
            send = np.flatnonzero(~known)
            bucket = (low[send] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            send, bucket = send[order], bucket[order]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(send)], strict=True):
                own = send[a:b]
                out.add(int(bucket[a]), doc[own], mark[own], first[own], [data[x:y] for x, y in zip(start[own].tolist(), stop[own].tolist(), strict=True)])
            if out.full():
                yield from out.flush()
        yield from out.flush()

    return run


MAX_BUCKETS = 50_000
#: Files that a task splits an oversized bucket to.
SPLITS = 32
#: Memory that a task may take for what it works on at once. How much that is goes by windows, not by bytes: the same
#: bytes are few windows or many.
TASK_MEMORY = 480 << 20
#: Parts of TASK_MEMORY that one piece of a file may take.
PIECES = 8


def bucket_count(docs: DataFrame, least: int, size: int) -> int:
    """docs: of keyed(). A bucket gets ``size`` bytes of text on average, so their number follows the input, up to MAX_BUCKETS."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(least, min(MAX_BUCKETS, -(-total // size)))


class Oversized:
    """A bucket that doesn't fit the memory of its task: split by minimiser to files of this task, worked on one by one.

    What is still too large, as one minimiser has most of it, is worked on by the share of its windows' hashes: equal
    windows fall into one share, and their bytes are compared in the file. So nothing bounds the size of a bucket or of
    a minimiser's group but the disk.
    """

    def __init__(self, minimisers, windows, weights, limit: int):
        self.minimisers, self.windows, self.weights, self.limit = minimisers, windows, weights, limit
        self.files = [tempfile.TemporaryFile() for _ in range(SPLITS)]  # unlinked at once; only this task reads them
        self.sizes = [0] * SPLITS

    def add(self, docs: np.ndarray, marks: np.ndarray, firsts: np.ndarray, strings: list[bytes]) -> None:
        weight = self.weights(strings)
        for piece in np.split(np.arange(len(strings)), np.flatnonzero(np.diff(np.cumsum(weight) * PIECES // self.limit)) + 1):
            split = (mixed(self.minimisers([strings[i] for i in piece.tolist()])) % np.uint64(SPLITS)).astype(np.int64)
            for k in np.unique(split).tolist():
                own = piece[split == k]
                blob = packed(docs[own], marks[own], firsts[own], [strings[i] for i in own.tolist()])
                self.files[k].write(len(blob).to_bytes(8, "little") + blob)
                self.sizes[k] += int(weight[own].sum())

    def parts(self, k: int) -> Iterator[tuple]:
        f = self.files[k]
        f.seek(0)
        while head := f.read(8):
            yield unpacked(f.read(int.from_bytes(head, "little")))

    def run(self, whole, later) -> Iterator[pa.RecordBatch]:
        for k in range(SPLITS):
            if self.sizes[k] > self.limit:
                yield from self.by_hash(k, later)
            elif self.sizes[k]:
                yield from whole(list(self.parts(k)))
            self.files[k].close()

    def by_hash(self, k: int, later) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryFile() as f:
            n = 0
            for *_, strings in self.parts(k):
                data, string, *_ = self.windows(strings)
                f.write(data)
                n += len(string)
            f.flush()
            if not n:
                return
            with mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as disk:
                shares = -(-self.sizes[k] // self.limit)
                for share in range(shares):
                    rows, base = [], 0
                    for docs, marks, firsts, strings in self.parts(k):
                        data, string, place, start, stop, width = self.windows(strings)
                        h = range_hashes(np.frombuffer(data, np.uint8), start, stop)
                        own = np.flatnonzero(h % np.uint64(shares) == share)
                        at = string[own]
                        rows.append((docs[at], marks[at], firsts[at] + place[own], start[own] + base, stop[own] + base, h[own]))
                        base += len(data)
                    doc, mark, first, start, stop, h = (np.concatenate(c) for c in zip(*rows, strict=True))
                    order = np.lexsort((first, mark, doc))
                    doc, mark, first = doc[order], mark[order], first[order]
                    gone = later(doc, mark, first, equal_groups(disk, start[order], stop[order], h[order]))
                    yield from range_rows(doc[gone], mark[gone], first[gone], first[gone] + width)


def counted(count, minimisers, windows, weights, later, limit: int | None = None):
    """count: of (docs, marks, firsts, strings) of whole buckets, gives batches of RANGES. Decided ranges pass through.

    weights: of strings, the memory in bytes that count takes for each at most; a bucket that weighs more than ``limit``, or
    TASK_MEMORY, is Oversized. minimisers: of strings. windows: of strings, gives the bytes, and by window its string, place in it, start
    and stop in the bytes; and the window. later: of windows' documents, marks, places and first equal ones, which go.
    """

    limit = limit or TASK_MEMORY

    def whole(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        docs, marks, firsts = (np.concatenate([p[i] for p in parts]) for i in range(3))
        strings = [s for p in parts for s in p[3]]
        parts.clear()
        order = np.lexsort((firsts, marks, docs))
        yield from count(docs[order], marks[order], firsts[order], [strings[i] for i in order.tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, over = [], 0, None
        for b in batches:
            known = np.flatnonzero(b.column(0).to_numpy() < 0)
            if len(known):
                yield pa.record_batch(b.take(pa.array(known)).columns[1:], ["doc", "mark", "ranges"])
            for target, blob in zip(b.column(0), b.column(3), strict=True):
                if target.as_py() < 0:
                    continue
                part = unpacked(blob.as_py())
                size += int(weights(part[3]).sum())
                parts.append(part)
                if size > limit:
                    over = over or Oversized(minimisers, windows, weights, limit)
                    for p in parts:
                        over.add(*p)
                    parts.clear()
        if over:
            yield from over.run(whole, later)
        elif parts:
            yield from whole(parts)

    return run


def apply_ranges(docs: DataFrame, ranges: DataFrame, partitions: int, cut: Callable[[str, np.ndarray], tuple], names: list[str], kinds: list, schema: str) -> DataFrame:
    """docs: of keyed(). Brings each document's ranges to it, in one shuffle, and gives doc_id and what cut returns.

    Texts travel compressed in packs. A partition is sorted by target, ranges first, and runs as a stream.
    """
    target = F.pmod(F.xxhash64("doc", "mark"), F.lit(partitions))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Packer(PACK)
        for b in batches:
            for doc, mark, text, to in zip(*(b.column(i) for i in range(4)), strict=True):
                out.add(to.as_py(), [doc.as_py()], [mark.as_py()], [0], [(text.as_py() or "").encode()])
                if out.full():
                    yield from out.flush()
        yield from out.flush()

    texts = docs.withColumn("target", target).mapInArrow(pack, ROWS).withColumn("kind", F.lit(1))
    found = ranges.select(target.alias("target"), "doc", "mark", F.col("ranges").alias("data"), F.lit(0).alias("kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, {}
        for b in batches:
            for to, doc, mark, data, kind in zip(*(b.column(i) for i in range(5)), strict=True):
                if to != now:
                    now, own = to, {}
                if kind.as_py() == 0:
                    own.setdefault((doc.as_py(), mark.as_py()), []).append(np.frombuffer(data.as_py(), np.int64).reshape(-1, 2))
                    continue
                ids, out = [], []
                for d, m, _, text in zip(*unpacked(data.as_py()), strict=True):
                    mine = own.get((int(d), int(m)))
                    out.append(cut(text, np.stack(merged(*np.concatenate(mine).T), 1) if mine else np.empty((0, 2), np.int64)))
                    ids.append(None if d == NULL_ID else int(d))
                yield pa.record_batch([pa.array(ids, pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], ["doc_id", *names])

    both = texts.unionByName(found)
    return both.repartition(partitions, "target").sortWithinPartitions("target", "kind").mapInArrow(run, "doc_id long, " + schema)


def batched(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[tuple]]:
    """Rows in lists of about ``size`` bytes of text (third column)."""
    rows, n = [], 0
    for r in itertools.chain.from_iterable(zip(*(b.column(i) for i in range(3)), strict=True) for b in batches):
        text = r[2].as_py()
        rows.append((r[0].as_py(), r[1].as_py(), (text or "").encode()))
        n += len(rows[-1][2]) + 64
        if n >= size:
            yield rows
            rows, n = [], 0
    if rows:
        yield rows
