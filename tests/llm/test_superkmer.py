import hashlib
import random
import re
from functools import partial

import pyarrow as pa
import pytest

from quarrymill.llm import spans, superkmer

from .fixtures import LONG, ROWS, SCHEMA, prose, table


def brute(rows, window=13):
    """Windows by document; the smallest id of each."""
    low, out = {}, []
    top = 1 << 63
    words = [(top if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            low[key] = min(low.get(key, top), i)
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if low[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((None if i == top else i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_with_passages():
    r = random.Random(7)
    passages = [prose(100 + i, 30) for i in range(5)]
    out = list(ROWS)
    for i in range(20, 160):
        parts = [prose(i, r.randrange(0, 30))]
        for _ in range(r.randrange(3)):
            parts += [r.choice(passages), "\n\t " * r.randrange(2), prose(1000 + i, r.randrange(20))]
        out.append((i, " ".join(parts)))
    out += [(200, "the " * 9000), (201, "the " * 13), (202, "a b " * 5000), (203, LONG[500:90_000]), (204, passages[0] + " " + passages[0])]
    out += [(5, passages[1]), (5, passages[2] + " tail"), (5, passages[2] + " tail"), (None, passages[1])]
    return out


@pytest.mark.parametrize("chunk,pack,task,splits", [(4 << 20, 48 << 20, 480 << 20, 32), (3000, 5000, 120_000, 5), (3000, 5000, 30_000, 2)])
def test_brute(spark, monkeypatch, chunk, pack, task, splits):
    rows = rows_with_passages()
    docs = table(spark, rows).repartition(3)
    monkeypatch.setattr(superkmer, "CHUNK", chunk)
    monkeypatch.setattr(spans, "TASK_MEMORY", task)
    monkeypatch.setattr(spans, "SPLITS", splits)
    monkeypatch.setattr(superkmer, "PACK", pack)
    monkeypatch.setattr(superkmer, "SORTED", pack)
    if chunk < 9999:
        monkeypatch.setattr(superkmer, "super_kmers", partial(superkmer.super_kmers, longest=7))
    got = superkmer.substring_dedup(docs).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_empty_and_texts(spark):
    assert not superkmer.substring_dedup(spark.createDataFrame([], SCHEMA)).collect()
    p = prose(5, 20)
    own = lambda text, ranges: (len(ranges), text[:5].decode())
    got = superkmer.substring_dedup(table(spark, [(1, p), (2, p)]), cut=own, names=["k", "t"], kinds=[pa.int64(), pa.string()], schema="k long, t string")
    assert sorted(map(tuple, got.collect())) == [(1, 0, p[:5]), (2, 1, p[:5])]
