import hashlib
import re

import pytest

from .fixtures import prose, table
from .test_dedup import brute_components, brute_fp

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_against_brute_force(spark, tmp_path):
    base = [(i, prose(i, 80), "en" if i % 3 else "de", f"s{i % 4}") for i in range(60)]
    rows = [*base, (100, base[0][1] + " ", "en", "s0"), (101, base[1][1], "de", "s1"), (102, base[2][1] + " extra", "en", "s2"), (103, "123 456", "en", "s0"), (104, None, "en", "s0"), (105, "", None, None)]
    df = table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    read = spark.read.parquet
    docs = read(str(tmp_path / "documents.parquet"))
    seen = []
    for n, (_, stage) in enumerate(pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{n}"))
        docs = read(str(tmp_path / f"stage{n}"))
        if n < 4:
            assert docs.columns == df.columns
        seen.append((before, {r.doc_id: r for r in docs.collect()}))
        assert docs.count() == len(seen[-1][1])
    assert set(seen[0][1]) == set(seen[0][0]) - {103, 104, 105}
    groups = {}
    for i, r in sorted(seen[1][0].items(), key=lambda x: (-len(x[1].text), x[0])):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text), i)
    assert set(seen[1][1]) == set(groups.values())
    assert set(seen[2][1]) == {c for _, _, c in brute_components([(i, brute_fp(r.text)) for i, r in seen[2][0].items()])}
    assert set(seen[3][1]) <= set(seen[3][0]) and len(seen[3][1]) > 0.4 * len(seen[3][0])
    for i, r in seen[4][1].items():
        assert r.decoded_sha256 == hashlib.sha256(seen[4][0][i].text.encode()).hexdigest()
    assert pipeline.run(spark, str(tmp_path)).count() == len(seen[4][1])


def test_null_and_repeated_ids(spark):
    a, b, c, d, e, f = (prose(900 + i, 80) for i in range(6))
    rows = [(None, a), (None, b), (None, b + " "), (7, c), (7, d), (7, d), (3, e), (5, e + " "), (3, f), (None, c + "  "), (8, f + "\n"), (None, f)]
    docs = table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").cache()
    exact = pipeline.drop_exact_copies(spark, docs, "")
    assert exact.columns == docs.columns
    # of equal texts the longest stays, then the smallest id
    exact = exact.cache()
    have = [(r.doc_id, r.text) for r in exact.collect()]
    assert sorted(have, key=repr) == sorted([(None, a), (None, b + " "), (None, c + "  "), (7, d), (5, e + " "), (8, f + "\n")], key=repr)
    # one row of a component stays, though its id is null, repeats or belongs to other texts too
    rows = [(None, a), (None, a.upper()), (None, b), (7, c), (7, c.upper()), (7, d), (2, d.upper()), (None, e), (4, e.upper())]
    near = pipeline.drop_near_copies(spark, table(spark, rows), "")
    have = [(r.doc_id, r.text.lower()) for r in near.collect()]
    assert sorted(have, key=repr) == sorted([(None, a), (None, b), (7, c), (2, d), (4, e)], key=repr)


CLASHES = "score double, rejected boolean, lang_pred string, mix_u int, c0 string, id int, sha string, row int, key int, label int, fp long, keep_id long"


def test_names_clash(spark):
    """Columns named like those that stages use inside: rows and columns stay as they are."""
    rows = [(i, prose(i, 80), "en", "s", 5) for i in range(12)] + [(20, prose(1, 80) + " ", "en", "s", 5), (21, prose(2, 80).upper(), "en", "s", 5), (None, "", None, None, None)]
    docs = spark.createDataFrame([(*r, 0.5, True, "x", 9, "c", 1, "s", 2, 3, 4, 5, 6) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + CLASHES).cache()
    sizes = []
    for _, stage in pipeline.STAGES[:4]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns
        back = got.collect()
        assert {tuple(r) for r in back} <= {tuple(r) for r in docs.collect()}
        sizes.append(len(back))
    assert sizes[:3] == [14, 14, 13]
    assert pipeline.STAGES[4][1](spark, docs, "").count() == 15


def test_dots_backticks_and_maps(spark):
    rows = [(i, prose(i, 80), "en", "s", 5, {"k": i}, 1, "q", [{"a": 1}]) for i in range(12)] + [(3, prose(3, 80), "en", "s", 5, {"k": 0}, 2, "p", None), (20, prose(2, 80).upper(), "en", "s", 5, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a map` map<string,int>, `a.b` int, `c``d` string, maps array<map<string,int>>").cache()
    sizes = []
    for _, stage in pipeline.STAGES[:4]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns
        back = got.collect()
        assert all(r in docs.collect() for r in back)
        sizes.append(len(back))
    assert sizes[:3] == [14, 13, 13]
    assert pipeline.STAGES[4][1](spark, docs, "").count() == 14


def test_empty_table(spark):
    docs = table(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in pipeline.STAGES:
        assert not stage(spark, docs, "").collect()
