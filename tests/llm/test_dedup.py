import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from quarrymill.llm import simhash
from quarrymill.llm.exact_dedup import exact_dedup

from .fixtures import ROWS, SCHEMA, prose, table


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is not None, i or 0))
    out = []
    for norm, g in groups.items():
        g.sort()
        keep = g[0][2] if g[0][1] else None
        for n, (_, has, i) in enumerate(g):
            out.append((i if has else None, keep, len(g), n == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("first,widen", [(32, 64), (1, 2)])
def test_exact(spark, first, widen):
    rows = ROWS if first > 1 else [r for r in ROWS if len(r[1] or "") < 1000]
    got = exact_dedup(table(spark, rows), first_bytes=first, widen=widen).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_exact(rows)


def test_exact_empty(spark):
    got = exact_dedup(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and not got.collect()


def brute_fp(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    k = min(4, len(words))
    hs = [xxhash.xxh64(" ".join(words[i : i + k]).encode(), seed=42).intdigest() for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    """fps: list of (id, fp). By comparing all."""
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 4:
                label[find(i)] = find(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(fps):
        low[find(i)].append(d)
    return sorted((d, f"{f:016x}", min((x for x in low[find(i)] if x is not None), default=None)) for i, (d, f) in enumerate(fps) if d is not None)


def test_simhash_texts(spark):
    got = simhash.near_dedup(table(spark, ROWS)).collect()
    want = brute_components([(i, brute_fp(t)) for i, t in ROWS])
    assert sorted(tuple(r) for r in got if r[0] is not None) == want and len(got) == len(ROWS)
    assert not simhash.near_dedup(spark.createDataFrame([], SCHEMA)).collect()


@pytest.mark.parametrize("limit", [200_000, 20])
def test_links(spark, limit):
    """Dense clusters, chains and lone fingerprints, with lists over and under the limit."""
    rng = np.random.default_rng(3)
    fps = []
    for _ in range(6):
        base = int(rng.integers(0, 2**63))
        for _ in range(60):
            x = base
            for b in rng.choice(64, rng.integers(0, 5), replace=False):
                x ^= 1 << int(b)
            fps.append(x)
    x = 5
    for b in range(0, 60, 4):  # a chain, each link of exactly 4 bits
        fps.append(x)
        x ^= 15 << b
    fps += [int(v) for v in rng.integers(0, 2**63, 200)]
    fps = sorted(set(fps))
    signed = lambda v: v if v < 2**63 else v - 2**64
    df = spark.createDataFrame([(signed(v),) for v in fps], "fp long")
    scratch = simhash.Scratch(spark, "t")
    edges = [tuple(r) for r in simhash.links(df, scratch, limit).collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in edges)
    groups = {r.node: r.label for r in simhash.connected_components(simhash.links(df, scratch, limit), scratch).collect()}
    want = {d: c for d, _, c in brute_components([(signed(v), v) for v in fps])}
    assert {signed(v): groups.get(signed(v), signed(v)) for v in fps} == want


def test_prose_differs():
    assert prose(2, 60) != prose(3, 60)
