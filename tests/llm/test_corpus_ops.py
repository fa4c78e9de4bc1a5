import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.llm import langid, mixing, warc
from quarrymill.llm.common import Scratch

from .fixtures import ROWS, SCHEMA, table

PAGES = "page_id long, url string, html string, n long, to string, record_id string, payload string"
BIG = "<p>" + "é" * 200 + "\r\n\r\nWARC/1.1\r\n</p>"


def test_warc(spark):
    rows = [(5, "http://a/\r\nX: y", BIG), (3, None, BIG), (9, "u", BIG), (7, "u", "short"), (8, "u", "short"), (1, "u", None), (2, "u", ""), (10, "u", "x" * 99), (11, "u", "x" * 99), (12, "u", "x" * 100), (13, "u", "x" * 100), (14, "u", "y" * 70_000), (14, "u", "y" * 70_000), (None, "u", BIG)]
    df = spark.createDataFrame([(*r, 1, "t", "r", "p") for r in rows], PAGES)
    got = warc.archive_round_trip(df.repartition(3)).collect()
    want = []
    for i, _, h in rows:
        same = [p for p, _, x in rows if x == h and p is not None]
        raw = (h or "").encode()
        low = min(same)
        twin = i == 14 and any(w[0] == 14 for w in want)
        rev = len(raw) >= 100 and (i != low or twin)
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if rev else "response", low if rev else None))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert not warc.archive_round_trip(spark.createDataFrame([], PAGES)).collect()


def test_warc_headers(spark, monkeypatch):
    scratch = Scratch(spark, "t")
    a, b = scratch.path("a"), scratch.path("b")
    warc.pages_to_archive(spark.createDataFrame([(1, "http://x", BIG), (2, "http://y", BIG)], "page_id long, url string, html string"), a)
    before = {r.page_id: r for r in warc.read_archive(spark, a).collect()}
    monkeypatch.setattr(warc, "_now", lambda: "2030-01-02T03:04:05Z")
    warc.deduplicate_archive(spark, a, b, scratch)
    rows = {r.page_id: r for r in warc.read_archive(spark, b, payloads=True).collect()}
    assert rows[1].record_type == "response" and rows[1].payload == BIG and rows[1].uri == "http://x"
    assert rows[2].record_type == "revisit" and rows[2].refers_to_id == rows[1].record_id and rows[2].payload == ""
    assert all(rows[i].record_id != before[i].record_id and rows[i].warc_date == "2030-01-02T03:04:05Z" != before[i].warc_date for i in (1, 2))


def test_warc_files_are_bounded(spark):
    import gzip
    from pathlib import Path

    path = Scratch(spark, "t").path("bounded")
    sizes = [100] * 50 + [5000] + [10] * 20
    warc.write_archive(spark.createDataFrame([("r" * n,) for n in sizes], "v string").coalesce(1), path, file_bytes=1000)
    held = [[len(x) for x in gzip.decompress(f.read_bytes()).split(b"\r\n\r\n") if x] for f in sorted(Path(path.removeprefix("file:")).rglob("*.gz"))]
    assert sorted(n for f in held for n in f) == sorted(sizes) and [5000] in held
    assert all(sum(f) <= 1000 or len(f) == 1 for f in held) and len(held) < 10


def mixing_rows():
    r = random.Random(1)
    out = [(i, "w " * r.randrange(1, 40) + r.choice(["", "license", "a | b", "12345"]), r.choice(["en", "en", "en", "de", None]), r.choice(["hot", "hot", "hot", "b", "c", None])) for i in range(600)]
    return [*out, (700, None, "en", "hot"), (701, "", "xx", "only"), (702, " \t", "en", "hot"), (5, "w w", "en", "b"), (5, "w w", "en", "b"), (None, "w w w", "en", "b")]


def brute_targets(tokens, share, total):
    """By bisection on the level of min(level * share, FULL * tokens)."""
    low, high = 0.0, 1e12
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if np.minimum(mid * share, mixing.FULL * tokens).sum() < total else (low, mid)
    return np.minimum(high * share, mixing.FULL * tokens)


def test_mixing_hits_targets(spark):
    df = table(spark, mixing_rows())
    got = mixing.mix(df).toPandas()
    assert len(got) == df.count() and got.probability.between(0, 1).all()
    assert not got[got.doc_id == 701].kept.any()
    total = got.n_tokens.sum() * mixing.RATE
    worst = 0
    for dim in mixing.DIMS:
        seen = got.groupby(dim).n_tokens.sum().astype(float)
        want = brute_targets(seen.values, np.where(seen > 0, seen**mixing.TEMPER, 0), total)
        mass = (got.n_tokens * got.probability).groupby(got[dim]).sum().values
        on = want > 0
        assert (mass[~on] == 0).all()
        worst = max(worst, (abs(mass - want)[on] / want[on]).max())
    assert worst < 0.01 and abs(worst - got.residual.max()) < 1e-5
    kept = got[got.kept]
    assert abs(kept.n_tokens.sum() - total) < 0.12 * total
    again = mixing.mixed_documents(df)
    assert again.columns == df.columns and again.count() == len(kept)


def test_mixing_targets_given(spark):
    t = spark.createDataFrame([("en", 0.5), ("de", 0.5)], "lang string, target double")
    rows = [(i, "w " * 10, "en" if i % 4 else "de", "s") for i in range(4000)]
    got = mixing.mix(table(spark, rows), rate=0.4, targets={"lang": t}).toPandas().query("kept").groupby("lang").size()
    assert abs(got["de"] / got.sum() - 0.5) < 0.03
    assert not mixing.mix(spark.createDataFrame([], SCHEMA)).collect()


def test_mixing_says_what_cannot_be_met(spark):
    """Source decides language here, so half of the one can't go with a tenth of the other."""
    rows = [(i, "w " * 10, "en" if i % 2 else "de", "a" if i % 2 else "b") for i in range(100)]
    by = {"lang": spark.createDataFrame([("en", 0.5), ("de", 0.5)], "v string, t double"), "source": spark.createDataFrame([("a", 0.1), ("b", 0.9)], "v string, t double")}
    assert mixing.mix(table(spark, rows), rate=0.2, targets=by, max_sweeps=4).agg(F.max("residual")).first()[0] > 0.1
    with pytest.warns(UserWarning, match="misses"):
        mixing.mixed_documents(table(spark, rows), rate=0.2, targets=by, max_sweeps=4)


def test_mixing_names_clash(spark):
    df = table(spark, mixing_rows()[:60]).withColumns({"mix_u": F.lit(2), "topic": F.when(F.col("doc_id") % 2 == 0, "x"), "tokens": F.lit("t"), "u": F.lit(0.0), "probability": F.lit(9), "row": F.lit(1)})
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns and 0 < got.count() < 60 and {r.topic for r in got.collect()} == {None, "x"}
    assert {r.topic for r in mixing.mix(df).collect()} == {"(none)", "x"}


def test_counts_in_pieces():
    text = "The quick brown fox. " * 40_000
    folded = " " + " ".join("the quick brown fox".split() * 40_000) + " "
    assert langid.counts(text).sum() == len(folded) - 1 + len(folded) - 2
    assert langid.counts("").sum() == langid.counts("1 2").sum()


def test_langid(spark):
    parts = {"xx": "ba be bi bo bu lala".split(), "yy": "kro kra kri stru strei gno".split(), "zz": "ßa ßo üb äl ön".split()}
    r = random.Random(4)
    rows = [(i, " ".join("".join(r.choice(parts[lang]) for _ in range(3)) for _ in range(40)), lang, "s") for i in range(300) for lang in [r.choice(list(parts))]]
    extra = [(1000, None, "xx", "s"), (1001, "", "xx", "s"), (1002, "12 34 !?²", None, "s"), (1003, "BABEBI BOBULALA " * 20_000, None, "s"), (1004, "日本語", None, "s"), (None, rows[0][1], "xx", "s"), (1, rows[0][1], "xx", "s")]
    got = langid.language_id(table(spark, [*rows, *extra])).toPandas()
    assert len(got) == 307 and got.score.between(0, 1).all()
    byid = got.groupby("doc_id").first()
    truth = {i: lang for i, _, lang, _ in rows}
    held = byid[byid.held_out & byid.index.isin(truth)]
    assert len(held) > 30 and np.mean([truth[i] == p for i, p in held.lang_pred.items()]) == 1
    assert (byid.loc[[1000, 1001, 1002], "lang_pred"] == "und").all() and byid.loc[[1000, 1001, 1002, 1004], "rejected"].all()
    assert byid.loc[1003, "lang_pred"] == "xx" and not byid.loc[1003, "rejected"]
    none = langid.language_id(spark.createDataFrame([], SCHEMA))
    assert not none.collect()
    same = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"), F.lit(None).cast("string").alias("lang"))
    assert {r.lang_pred for r in langid.language_id(same).collect()} == {"und"}


def brute_counts(text):
    """2- and 3-grams one by one, with integers of any size."""
    folded = b" " + b" ".join(bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in text.lower().encode()).split()) + b" "
    out, m = [0] * langid.DIMS, (1 << 32) - 1
    for i in range(len(folded) - 1):
        pair = (folded[i] * 0x9E3779B1 + folded[i + 1] * 0x85EBCA6B) & m
        out[pair >> 19] += 1
        if i + 2 < len(folded):
            out[((pair + folded[i + 2] * 0xC2B2AE35) * 0x9E3779B1 & m) >> 19] += 1
    return out


def test_langid_against_brute_force(spark):
    """Document frequencies, scores and predictions; centroids are the fitted ones."""
    parts = {"xx": "ba be bi bo bu lala".split(), "yy": "kro kra kri stru strei gno".split()}
    r = random.Random(9)
    rows = [(i, " ".join("".join(r.choice(parts[lang]) for _ in range(3)) for _ in range(r.randrange(1, 30))), lang, "s") for i in range(80) for lang in [r.choice(list(parts))]]
    rows += [(100, None, "xx", "s"), (101, "??", "xx", "s"), (102, "kro kra", None, "s")]
    df = table(spark, rows)
    model = langid.fit(df)
    train = [brute_counts(t) for _, t, lang, _ in rows if t and lang and any(map(str.isalpha, t))]
    idf = [np.log((1 + len(train)) / (1 + sum(c[g] > 0 for c in train))) + 0.1 for g in range(langid.DIMS)]
    assert np.allclose(model.idf, idf, atol=1e-4) and model.bound >= langid.MIN_COSINE
    got = {x.doc_id: x for x in langid.predict(df, model).collect()}
    for i, t, *_ in rows:
        if not t or not any(map(str.isalpha, t)):
            assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
            continue
        v = [c**0.5 * w for c, w in zip(brute_counts(t), idf, strict=True)]
        n = sum(x * x for x in v) ** 0.5
        cos = [sum(a * b for a, b in zip(v, c, strict=True)) / n for c in model.centroids.astype(float).tolist()]
        assert abs(got[i].score - max(cos)) < 1e-4 and got[i].rejected == (got[i].score < model.bound)
        assert cos[model.langs.index(got[i].lang_pred)] > 0 and max(c for c, lang in zip(cos, model.langs, strict=True) if lang == got[i].lang_pred) > max(cos) - 1e-4


def test_langid_learns_every_language(spark, monkeypatch):
    letters = [f"{a}{b}{a}" for a in "bcdfghjklm" for b in "aeiou"]
    rows = [(10 * i + j, " ".join([w] * 5), f"l{i:02}", "s") for i, w in enumerate(letters) for j in range(4)]
    monkeypatch.setattr(langid, "MAX_CENTROIDS", 20)
    got = langid.predict(table(spark, rows), langid.fit(table(spark, rows))).collect()
    assert {r.lang_pred for r in got} == {f"l{i:02}" for i in range(len(letters))}
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 20)
    with pytest.raises(ValueError, match="20 languages"):
        langid.fit(table(spark, rows))


def test_langid_sample_is_bounded(spark, monkeypatch):
    """Rows that share an id are cut to the sample in Spark."""
    taken, sparse = [], langid.cluster
    monkeypatch.setattr(langid, "cluster", lambda v, k: taken.append(len(v)) or sparse(v, k))
    words = "ba be bi bo bu kro kra kri stru".split()
    df = spark.range(3000).select(F.lit(7).alias("doc_id"), F.concat_ws(" ", *(F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.hash("id", F.lit(i)), F.lit(9)) + 1).cast("int")) for i in range(6))).alias("text"), F.when(F.col("id") % 2 == 0, "xx").otherwise("yy").alias("lang"))
    model = langid.fit(df, sample_docs=100)
    assert set(model.langs) == {"xx", "yy"} and all(0 < n <= 50 for n in taken)


@pytest.mark.parametrize("text", [r[1] for r in ROWS[:12]])
def test_counts_handle(text):
    assert langid.counts(text or "").min() >= 0
