import hashlib
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from quarrymill.llm import spans, suffixes, superkmer

from .fixtures import SCHEMA, table
from .test_superkmer import rows_with_passages


def brute(rows, window=100):
    top, seen, out = 1 << 63, {}, []
    texts = [(top if i is None else i, n, (t or "").encode()) for n, (i, t) in enumerate(rows)]
    for i, n, t in sorted(texts, key=lambda x: x[0]):
        for k in range(len(t) - window + 1):
            seen.setdefault(t[k : k + window], (i, k))
    for i, _, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - window + 1):
            if seen[t[k : k + window]] < (i, k):
                gone[k : k + window] = b"\1" * window
        spans = len([1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1])])
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((None if i == top else i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk,queue,task,splits", [(1 << 20, 8 << 20, 480 << 20, 32), (5000, 500, 1_500_000, 5), (5000, 500, 300_000, 2)])
def test_brute(spark, monkeypatch, chunk, queue, task, splits):
    rows = [r for r in rows_with_passages() if r[0] != 5 and r[0] is not None]
    rows += [(300, "z" * 250), (301, "z" * 99), (302, "\0" * 150 + "\x01" * 150), (303, "ab" * 300), (304, "é" * 60 + "x" + "é" * 60), (None, rows[-1][1]), (6, "a  b")]
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    monkeypatch.setattr(suffixes, "TASK_MEMORY", task)
    monkeypatch.setattr(spans, "SPLITS", splits)
    monkeypatch.setattr(suffixes, "QUEUE", queue)
    got = suffixes.suffix_dedup(table(spark, rows).repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def peak_of(count, strings):
    """Bytes that count takes beyond its input, at most."""
    ids, firsts = np.arange(len(strings), dtype=np.int64), np.zeros(len(strings), np.int64)
    tracemalloc.start()
    try:
        for _ in count(ids, ids, firsts, strings):
            pass
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("kind", ["half repeat", "long", "periodic", "short", "all repeat"])
def test_weights_bound_memory(kind):
    """Buckets of many windows and of few: what they weigh is no less than what sorting them takes."""
    r = np.random.default_rng(4)
    text = lambda n: r.integers(97, 123, n).astype(np.uint8).tobytes()
    made = {
        "half repeat": lambda: [text(184) for _ in range(9000)] * 2, "long": lambda: [text(4096) for _ in range(500)], "periodic": lambda: [(text(60) * 80)[:4096] for _ in range(400)],
        "short": lambda: [text(100) for _ in range(14_000)] * 2, "all repeat": lambda: [b"abc " * 300] * 1500,
    }
    strings, fixed = made[kind](), 24 << 20  # what hashing a block of bytes takes
    weight = int(suffixes.weights(strings).sum())
    assert peak_of(suffixes.counter, strings) < weight + fixed
    words = lambda n, size: b" ".join(text(size) for _ in range(n))
    made = {
        "half repeat": lambda: [words(30, 5) for _ in range(9000)] * 2, "long": lambda: [words(4000, 1) for _ in range(70)], "periodic": lambda: [b" ".join([words(20, 3)] * 100) for _ in range(200)],
        "short": lambda: [words(13, 6) for _ in range(20_000)] * 2, "all repeat": lambda: [b" ".join([b"1 2"] * 2000)] * 100,
    }
    strings = made[kind]()
    weight = int(superkmer.weights(strings).sum())
    assert peak_of(superkmer.counter, strings) < weight + fixed


def test_empty(spark):
    assert not suffixes.suffix_dedup(spark.createDataFrame([], SCHEMA)).collect()


@settings(deadline=None, max_examples=150)
@given(st.lists(st.integers(0, 3), max_size=80), st.sampled_from([3, 1 << 20]))
def test_sorts(values, limit):
    t = np.array(values, np.uint8)
    raw = t.tobytes()
    assert suffixes.sort_suffixes(t, 200, limit).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
