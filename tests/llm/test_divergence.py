import random
import re
from collections import Counter, defaultdict

from quarrymill.llm.divergence import divergence_audit

from .fixtures import ROWS, SCHEMA, WORDS, table

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_docs=10, top=10):
    groups, df, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        groups[lang, source].update(terms)
        df[lang].update(set(terms))
        langs[lang].update(terms)
    kept = {lang: [t for t, n in c.items() if n >= min_docs] for lang, c in df.items()}

    def p(counts, terms):
        total = sum(counts[t] for t in terms)
        return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(terms)) for t in terms}

    def f(a, b):
        return (a - b) ** 2 // (a + b)

    ps, qs, out = {g: p(c, kept[g[0]]) for g, c in groups.items()}, {lang: p(c, kept[lang]) for lang, c in langs.items()}, []
    for lang, source in groups:
        own = ps[lang, source]
        pairs = [(sum(f(own[t], other[t]) for t in own), s) for (la, s), other in ps.items() if la == lang and s != source]
        terms = [(f(own[t], qs[lang][t]), t) for t in own if groups[lang, source][t] and own[t] > qs[lang][t]]
        for part, items in (("pair", pairs), ("term", terms)):
            ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, v, i + 1) for i, (v, item) in enumerate(ranked) if part == "pair" or i < top]
    return sorted(out)


def corpus(sources, docs, seed):
    r = random.Random(seed)
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 3 else "s") for i, t in ROWS if i]
    for i in range(docs):
        s = r.randrange(sources)
        own = [r.choice(WORDS)] * r.randrange(4) + [f"{r.choice(WORDS)}{'é' if s % 2 else ''}x{'ab'[s % 2] * (s % 7)}" for _ in range(6)] + r.sample(WORDS, 5)
        rows.append((100 + i, " ".join(own).title() if i % 4 else ", ".join(own), "en" if i % 3 else "fr", f"src{s}"))
    return [*rows, (1, "only here", "xx", "alone"), (2, None, "yy", "a"), (3, "1 2 3", "yy", "b"), (4, "", "yy", "c")]


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_by_brute_force(spark):
    rows = corpus(12, 500, 1)
    want = brute(rows)
    assert {r[2] for r in want} == {"pair", "term"} and ("yy", "a", "pair", "b", 0, 1) in want
    assert got(divergence_audit(table(spark, rows))) == want


def test_all_light_or_all_heavy_and_several_blocks(spark):
    rows = corpus(280, 900, 2)
    want = brute(rows, min_docs=3, top=4)
    assert got(divergence_audit(table(spark, rows), min_docs=3, top=4)) == want
    few = corpus(9, 200, 3)
    for light in (0, 10**6):
        assert got(divergence_audit(table(spark, few), min_docs=2, light=light)) == brute(few, min_docs=2)


def test_empty(spark):
    assert got(divergence_audit(spark.createDataFrame([], SCHEMA))) == []
