import re

from quarrymill.llm.decontaminate import decontaminate

from .fixtures import LONG, ROWS, SCHEMA, prose, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TESTS = [
    (1, prose(2, 25)), (2, prose(3, 12)), (2, "second text of item two"), (3, "short item"), (4, None), (5, " .,! "), (None, "nameless item here"), (6, "Short\nITEM"), (7, "É clair"), (8, "ab"),
    (10, " ".join(LONG.split()[500:511])), (11, "x y " * 8),
]
DOCS = [
    *ROWS, (20, "a SHORT—item"), (21, "a Short, (item); and short item. Shortitem"), (22, prose(2, 9)), (23, "\U0001f600 " + prose(2, 12).upper().replace(" ", " -\n")), (24, "é clair É CLAIR"), (24, "é clair É CLAIR"),
    (25, "x y x y x y x y x y x y x"), (26, "a nameless ITEM here twice: nameless item here"), (27, prose(3, 12) + " " + prose(2, 25)), (None, "short item"), (None, "short item"),
]


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def brute(docs, tests, k=10):
    wins = {}
    for item, text in tests:
        ws = WORD.findall(lowered(text))
        for i in range(max(len(ws) - k + 1, min(1, len(ws)))):
            wins.setdefault(tuple(ws[i : i + k]), set()).add(item)
    out = []
    for doc, text in docs:
        found = list(WORD.finditer(lowered(text)))
        ws, hit, items = [m.group() for m in found], set(), set()
        for size in {len(w) for w in wins}:
            for i in range(len(ws) - size + 1):
                if (own := wins.get(tuple(ws[i : i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    items |= own
        spans, at = [], sorted(hit)
        for i in at:
            if i - 1 not in hit:
                spans.append([found[i].start(), 0])
            spans[-1][1] = found[i].end()
        out.append((doc, len(ws), len(hit), sorted(str(x) for x in items if x is not None), [tuple(s) for s in spans]))
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), [tuple(s) for s in r.spans]) for r in df.collect()), key=repr)


def benchmark_table(spark, tests=TESTS):
    return spark.createDataFrame([(i, t, "x") for i, t in tests], "item_id long, text string, window string")


def test_by_brute_force(spark):
    want = brute(DOCS, TESTS)
    assert sum(w[2] > 0 for w in want) > 10
    assert rows(decontaminate(table(spark, DOCS), benchmark_table(spark))) == want


def test_several_automata(spark):
    assert rows(decontaminate(table(spark, DOCS).repartition(2), benchmark_table(spark), letters=70)) == brute(DOCS, TESTS)


def test_questions_and_answers_and_empty_tables(spark):
    both = spark.createDataFrame([(1, "alpha beta", "gamma"), (2, None, "delta")], "item_id int, question string, answer string")
    docs = [(1, "beta gamma alpha"), (2, "Alpha; beta - delta")]
    got = rows(decontaminate(table(spark, docs), both, text_cols=("question", "answer")))
    assert got == brute(docs, [(1, "alpha beta"), (1, "gamma"), (2, "delta")])
    assert all(r[2] == 0 and r[3] == [] for r in rows(decontaminate(table(spark, DOCS), benchmark_table(spark, []))))
    assert not decontaminate(spark.createDataFrame([], SCHEMA), benchmark_table(spark)).collect()
