"""SimHash near-dedup: an index of byte positions with count filtering.

Two 64-bit fingerprints with at most 4 differing bits share at least 4 of their 8 positional bytes, the guaranteed
minimum of the count filter. Lists of single bytes would hold 1/256 of all fingerprints each, and pairs to tally would
grow with the square of the input; so the index has a posting list for each set of 4 byte positions with their values.
A pair meets in a list exactly if its tally reaches the minimum: the filter is applied by the index, before any pair is
formed. What meets is verified by its differing bits. Only fingerprints, each once, are indexed: exact copies and near
copies with equal fingerprints never form pairs. A list gives a spanning forest of its links, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, bound_arrow, require
from .components import connected_components

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
MIN_BYTES = 8 - MAX_BITS
#: Lists of more fingerprints are dealt out as pairs of blocks of this size at most on average.
LIST_LIMIT = 200_000
#: Up to this size a list's pairs are compared all at once with those of other small lists.
SMALL_LIST = 8
POSITIONS = list(combinations(range(8), MIN_BYTES))


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    stops = ends[k - 1 :].tolist()
    starts = [0, *(ends[: len(words) - k] + 1).tolist()]
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 15):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 15)], stops[at : at + (1 << 15)], strict=True)], np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint's bits as a signed long."""
    bound_arrow(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


def near(x: np.ndarray) -> np.ndarray:
    """Of XORs of fingerprints that share MIN_BYTES positional bytes: whether few enough bits differ."""
    return np.bitwise_count(x) <= MAX_BITS


def link_list(fps: np.ndarray) -> list[np.ndarray]:
    """Links of one posting list as spanning trees: a fingerprint is compared with those not yet reached only."""
    out, rest = [], fps
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        todo = [root]
        while todo and len(rest):
            hit = near(rest ^ (one := todo.pop()))
            if hit.any():
                new, rest = rest[hit], rest[~hit]
                out.append(np.stack([np.full(len(new), one), new], 1))
                todo.extend(new)
    return out


def link_lists(keys: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """keys are sorted. Returns linked pairs (n, 2)."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    out = []
    small = np.repeat((sizes >= 2) & (sizes <= SMALL_LIST), sizes)
    k, f = keys[small], fps[small]
    for d in range(1, SMALL_LIST):
        same = np.flatnonzero(k[d:] == k[:-d]) if len(k) > d else []
        if not len(same):
            break
        a, b = f[same], f[same + d]
        ok = near(a ^ b)
        out.append(np.stack([a[ok], b[ok]], 1))
    for i in np.flatnonzero(sizes > SMALL_LIST):
        out += link_list(fps[starts[i] : starts[i] + sizes[i]])
    return np.concatenate(out) if out else np.empty((0, 2), np.uint64)


def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(fp), 4096):
            part = fp[at : at + 4096]
            octets = part.view(np.uint8).reshape(-1, 8)
            for n, pos in enumerate(POSITIONS):
                key = np.full(len(part), n, np.int64)
                for p in pos:
                    key = key << 8 | octets[:, p]
                yield pa.record_batch([pa.array(key), pa.array(np.zeros(len(part), np.int32)), pa.array(part.view(np.int64))], ["key", "part", "fp"])


def lists(limit: int):
    """Rows sorted by (key, part) come in; links (kind 0: a, b) go out, and the rows of lists over limit (kind 1: key, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(kind: int, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(a), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.record_batch([pa.array(np.full(len(a[part]), kind, np.int32)), pa.array(a[part].view(np.int64)), pa.array(b[part].view(np.int64))], ["kind", "a", "b"])

        names = {}

        def number(b: pa.RecordBatch) -> np.ndarray:
            """Consecutive lists get increasing numbers."""
            key, part = b.column(0).to_numpy(), b.column(1).to_numpy()
            new = np.r_[names.get("last") != (key[0], part[0]), (key[1:] != key[:-1]) | (part[1:] != part[:-1])]
            n = names.get("n", 0) + np.cumsum(new)
            names["last"], names["n"] = (key[-1], part[-1]), n[-1]
            return n

        held_n, held_k, held_f, spill = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), None
        for b in batches:
            if not b.num_rows:
                continue
            n, k, f = number(b), b.column(0).to_numpy(), b.column(2).to_numpy().view(np.uint64)
            if spill is not None:
                over = n == spill
                yield from rows(1, k[over], f[over])
                n, k, f = n[~over], k[~over], f[~over]
                if not len(n):
                    continue
                spill = None
            n, k, f = np.r_[held_n, n], np.r_[held_k, k], np.r_[held_f, f]
            cut = np.searchsorted(n, n[-1])
            if cut:
                links = link_lists(n[:cut], f[:cut])
                yield from rows(0, links[:, 0], links[:, 1])
            held_n, held_k, held_f = n[cut:], k[cut:], f[cut:]
            if limit and len(held_n) > limit:
                yield from rows(1, held_k, held_f)
                spill = held_n[0]
                held_n, held_k, held_f = held_n[:0], held_k[:0], held_f[:0]
        if len(held_n):
            links = link_lists(held_n, held_f)
            yield from rows(0, links[:, 0], links[:, 1])

    return run


def links(fps: DataFrame, scratch: Scratch, limit: int = LIST_LIMIT) -> DataFrame:
    """fps: (fp) distinct. Returns links (a, b): enough to join all fingerprints that the relation joins."""
    bound_arrow(fps.sparkSession)
    n = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    schema = "kind int, a long, b long"
    dealt = fps.select("fp").mapInArrow(postings, "key long, part int, fp long").repartition(n, "key").sortWithinPartitions("key")
    found = scratch.table(dealt.mapInArrow(lists(limit), schema), "links")
    out, over = found.filter("kind = 0").select("a", "b"), found.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    if not over.isEmpty():
        # lists over the limit: every pair of blocks is one list, so nothing is left out and no task gets it all
        counts = over.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / limit).cast("int").alias("blocks"))
        blocks = over.join(counts, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        pairs = blocks.select("key", F.explode(F.expr("transform(sequence(0, blocks - 1), i -> least(own, i) * blocks + greatest(own, i))")).alias("part"), "fp").select("key", F.col("part").cast("int"), "fp")
        more = pairs.repartition(n, "key", "part").sortWithinPartitions("key", "part").mapInArrow(lists(0), schema)
        out = out.union(scratch.table(more, "more").select("a", "b"))
    return out


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIST_LIMIT) -> DataFrame:
    """Returns a row per row of docs: id_col, fingerprint (16 hexadecimal digits), component_id.

    A-Z become lower case; words are runs without ASCII white space; shingles have 4 words, repeats count; a text of
    fewer words is one shingle; a text without words (null, empty) has fingerprint zero and links like any other.
    component_id is the smallest id that links reach, over fingerprints with at most 4 differing bits. Null ids
    never become a component_id unless a component has no other. An empty table gives an empty result.
    """
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    base = scratch.table(fingerprints(docs, id_col, text_col), "fingerprints")
    least = scratch.table(base.groupBy("fp").agg(F.min("id").alias("low")), "distinct")
    groups = connected_components(links(least, scratch, limit), scratch)
    joined = least.join(groups, least.fp == groups.node, "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))
    joined = scratch.table(joined, "labels")
    lows = joined.groupBy("label").agg(F.min("low").alias("component_id"))
    names = scratch.table(joined.join(lows, "label").select("fp", "component_id"), "names")
    return base.join(names, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
