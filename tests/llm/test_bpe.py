import hashlib

import public_tokenizers as P
import pytest
import tiktoken

from quarrymill.llm import bpe

from .fixtures import LONG, ROWS, SCHEMA, table

PATH = P.path("byte_bpe_multi_50k.tiktoken")
HARD = ["a" * 3000, "1" * 3000, "<|endoftext|> x", "it's we'll 'S", "　  \n\n x\x1c\x1dy", "naïve Ünï 12ab34\U0001f600\U0001f600", "日本語 テキスト\n" * 9, ("word12 " * 9 + "!!!\t\n") * 3000]


def plain():
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def test_digests(spark):
    rows = [*ROWS, *((100 + i, t) for i, t in enumerate(HARD))]
    got = bpe.encode_decode(table(spark, rows), PATH, P.PATTERN).collect()
    enc, want = plain(), []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert not bpe.encode_decode(spark.createDataFrame([], SCHEMA), PATH, P.PATTERN).collect()


def test_ids_round_trip(spark):
    got = bpe.encode_decode(table(spark, ROWS), PATH, P.PATTERN, emit="ids").collect()
    assert sorted((bytes(r.decoded).decode() for r in got)) == sorted(t or "" for _, t in ROWS)


@pytest.mark.parametrize("size", [1, 7, 100])
def test_parts_are_safe(size):
    enc = plain()
    for t in [*HARD, LONG[:20_000]]:
        cut = list(bpe.parts(t, size))
        assert "".join(cut) == t
        assert [x for p in cut for x in enc.encode_ordinary(p)] == enc.encode_ordinary(t)
