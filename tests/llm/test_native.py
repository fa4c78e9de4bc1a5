import hashlib
import math
import re
import unicodedata
from collections import Counter, defaultdict

import regex

from quarrymill.llm import pii, quality

from .fixtures import LONG, ROWS, SCHEMA, prose, table

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 * (v > 9)
    return s % 10 == 0


def brute_pii(t):
    out: dict[str, list] = {k: [] for k in pii.KINDS}
    for k, p in zip(out, (EMAIL, IP, CARD, PHONE), strict=True):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if k == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[k]
            if ok:
                out[k].append(f"{k}:{m.start()}:{m.end()}")
    return out


TEXTS = [
    "a@b.c_d@e.f a@b.c._x@y.z @x.y a@b a@b. x+y%z@q-r.s-t.u, é.é@é.é 日a@b.c",
    "1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.2.003 1..2.3.4 1.2.3 9.9.9.9",
    "4111 1111 1111 1111 4111-1111-1111-1111-5 4111  1111 5500005555555559 12 3-4 0 0",
    "+1 (771) 555-1655. +49.30.123456 +1 +123 ((((( +999999999999999999 ++1 234 567 890",
    "x\x01a@b.c\x02 \x01\x02 1.2.3.4 \x03", "😀 bob@ex.org 😀 10.0.0.1", "7" * 30_000, "a" * 30_000, "a.b@" * 9000, "+" + "(" * 20_000, "5 " * 15_000, "m@x.yz, " * 700, "1.2.3.4 " * 600,
]


def test_pii_base(spark):
    rows = [*ROWS, *((100 + i, t) for i, t in enumerate(TEXTS))]
    got = {(r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.personal_data(table(spark, rows)).collect()}
    want = set()
    for i, t in rows:
        b = brute_pii(t or "")
        want.add((i, hashlib.sha256(",".join(x for k in b for x in b[k]).encode()).hexdigest(), *(len(b[k]) for k in b)))
    assert got == want
    assert not pii.personal_data(spark.createDataFrame([], SCHEMA)).collect()


def around(t, spans):
    """(start, end, l2, l1, r1) of each span: the words between it and the next spans."""
    out = []
    for n, (a, b) in enumerate(spans):
        lo, hi = spans[n - 1][1] if n else 0, spans[n + 1][0] if n + 1 < len(spans) else len(t)
        bare = lambda ws: [x for x in (regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", w) for w in ws) if x]
        words = lambda x: [w for w in re.split(r"[\x20\x09-\x0D]+", x.lower()) if w]
        left, right = bare(words(t[lo:a])[-3:]), bare(words(t[b:hi])[:3])
        edge = "#" if n else "^"
        out.append((a, b, left[-2] if len(left) > 1 else edge, left[-1] if left else edge, right[0] if right else "#" if n + 1 < len(spans) else "$"))
    return out


def brute_fits(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "email":
        return "@" in v
    if kind == "secret":
        return len(v) >= 16 and bool(re.fullmatch("[A-Za-z0-9_+/=-]*", v)) and bool(re.search("[A-Za-z]", v))
    if re.fullmatch({"ip": IP, "card": CARD, "phone": PHONE}[kind], v):
        return {"ip": all(int(x) <= 255 for x in v.split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
    return len(d) >= 6


def brute_patterns(v, l2, l1, r1):
    shape = re.sub("[0-9]", "9", regex.sub(r"\p{L}+", "a", v.lower()))
    return {("2", l2, l1), ("l", l1), ("r", r1), ("b", l1, r1), ("s", shape), ("f", re.sub("9+", "9", shape))}


def brute_spans(texts):
    """By text, personal and secret spans: everything over dictionaries, one thing after the other."""
    kinds = list(pii.SEEDS)
    seeds, cands = [], []
    for n, t in enumerate(texts):
        base = brute_pii(t) | {"secret": [f"secret:{m.start()}:{m.end()}" for m in re.finditer("(?<![0-9A-Za-z])[0-9A-Fa-f]{32,128}(?![0-9A-Za-z])", t) if re.search("[0-9]", m[0]) and re.search("[A-Fa-f]", m[0])]}
        own = []
        for k in kinds:
            every = [m.span() for m in re.finditer({"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "secret": pii.SECRET}[k], t)]
            for a, b, *ctx in around(t, every):
                if f"{k}:{a}:{b}" in base[k]:
                    own.append((a, b))
                    seeds.append((n, k, a, b, t[a:b], ctx))
        tokens = [m.span() for m in regex.finditer(pii.TOKEN, t)]
        for a, b, l2, l1, r1 in around(t, tokens):
            g = t[a:b].split(" ")
            for i in range(len(g)):
                for j in range(i + 1, min(i + 5, len(g)) + 1):
                    s = a + sum(len(x) + 1 for x in g[:i])
                    v = re.sub(r"[^A-Za-z0-9)]+$", "", " ".join(g[i:j]))
                    if v.endswith(")") and v.count(")") > v.count("("):
                        v = v[:-1]
                    cut = re.match(r"[^A-Za-z0-9+(]*[(]?" if v.count("(") > v.count(")") else r"[^A-Za-z0-9+(]*", v).end()
                    s, v = s + cut, v[cut:]
                    if len(v) >= 6 and not any(x < s + len(v) and s < y for x, y in own):
                        cands.append((n, a, s, s + len(v), v, (l2 if i == 0 else "#", l1 if i == 0 else "#", r1 if j == len(g) else "#")))
    has = defaultdict(dict)  # by kind and pattern: whether each value is a seed
    for _, k, _, _, v, ctx in seeds:
        for p in brute_patterns(v, *ctx):
            has[k, p][v.lower()] = True
    has = {k: v for k, v in has.items() if len(v) >= 3}
    for _, k0, _, _, v, ctx in [*seeds, *((n, None, s, e, v, ctx) for n, _, s, e, v, ctx in cands)]:
        for p in brute_patterns(v, *ctx):
            for k in kinds:
                if (k, p) in has and k != k0 and brute_fits(k, v):
                    has[k, p].setdefault(v.lower(), False)
    score = {(k, v): float(seed) for (k, _), vs in has.items() for v, seed in vs.items()}
    for n in range(3):
        p = {key: sum(score[key[0], v] for v in vs) / (len(vs) + 0.5) for key, vs in has.items()}
        for k, v in {(k, v) for (k, _), vs in has.items() for v in vs}:
            mine = [key for key in has if key[0] == k and v in has[key]]
            score[k, v] = 1.0 if any(has[key][v] for key in mine) else 0.5 * max(p[key] for key in mine)
    good = {key: x for key, x in p.items() if x >= 0.8}
    out = [[(kinds.index(k), a, b) for n2, k, a, b, _, _ in seeds if n2 == n] for n in range(len(texts))]
    runs = defaultdict(list)
    for n, run, s, e, v, ctx in cands:
        mine = [(-good[k, p], kinds.index(k)) for p in brute_patterns(v, *ctx) for k in kinds if (k, p) in good and brute_fits(k, v)]
        if mine:
            runs[n, run].append((s, -e, min(mine)[1]))
    for (n, _), xs in runs.items():
        last = -1
        for s, e, k in sorted(xs):
            if s >= last:
                out[n].append((k, s, -e))
                last = -e
    text = lambda own, secret: ",".join(f"{kinds[k]}:{a}:{b}" for k, a, b in sorted(own) if (kinds[k] == "secret") == secret)
    return [(text(own, False), text(own, True)) for own in out]


def phone(i):
    return f"+1 ({300 + i}) 555-{1000 + 7 * i}"


def card(i):
    return next(c for c in (f"4111 1111 {1000 + i} {n}" for n in range(1000, 1100)) if luhn(c.replace(" ", "")))


def found_of(spark, rows):
    texts = dict(rows)
    got = {r.doc_id: r for r in pii.personal_data(table(spark, rows)).collect()}
    return {i: [f"{k}:{texts[i][int(s) : int(e)]}" for k, s, e in (x.split(":") for x in r.spans.split(",") if x)] for i, r in got.items()}, got


def test_pii_finds(spark):
    """What is written in another way or runs into a neighbour; all of it as by brute force."""
    rows = [(i, f"{prose(i, 8)} please email bob{i}@mail.example.org {prose(i + 500, 5)}") for i in range(8)]
    rows += [(i, f"{prose(i, 8)} please call {phone(i)} {prose(i + 500, 5)}") for i in range(200, 250)]
    rows += [(20 + i, f"{prose(i, 8)} card number {card(i)}, {prose(i + 500, 5)}") for i in range(8)]
    rows += [(60 + i, f'{prose(i, 8)} token = "{hashlib.sha1(bytes([i])).hexdigest()}" {prose(i + 500, 5)}') for i in range(12)]
    rows += [(40 + i, f"{prose(i, 8)} host 10.20.{i}.7 {prose(i + 500, 5)}") for i in range(4)]
    good, far = card(90), "5" * 20
    cases = [
        ("hello there please email carol99@localhost now", ["email:carol99@localhost"]), ("some words dave77@localhost now", []),
        (f"xx {phone(50)} 10.20.9.7 yy", [f"phone:{phone(50)}", "ip:10.20.9.7"]), (f"xx {phone(51)} {good} yy", [f"card:{good}", f"phone:{phone(51)}"]),
        ("please call (974) 555-3436 today", ["phone:(974) 555-3436"]), ("please call 974 - 555 - 3436", ["phone:974 - 555 - 3436"]), ("please call 0044 20 7946 and 17 others", ["phone:0044 20 7946"]),
        (f"card number 4111 1111 1000 1001 {far}", []), ("please call 12 30 7", []), ("some words (974) 555-3436", []), ("please call x1 555 3436 99", []), ("host 10.20.300.7 it is", []),
        ("please call 5551234 10.0.0.1 x", ["ip:10.0.0.1", "phone:5551234"]), ("please call (555123) (+1 (771) 555-1655)", ["phone:(555123)", "phone:+1 (771) 555-1655"]), ('token = "abcDEF0123456789zz"', []),
    ]
    rows += [(100 + i, t) for i, (t, _) in enumerate(cases)]
    have, got = found_of(spark, rows)
    want = brute_spans([t for _, t in rows])
    assert [(got[i].spans, got[i].secret_spans) for i, _ in rows] == want
    for i, (_, x) in enumerate(cases):
        assert sorted(have[100 + i]) == sorted(x)
    assert got[114].n_secret == 1 and got[114].secret_spans == "secret:9:27"
    assert all(r.n_private == len(have[i]) + r.n_secret for i, r in got.items())


def test_pii_finds_hidden_ones(spark):
    """Seeds that are left out are found again by patterns of the others."""
    rows = [(i, f"{prose(i, 8)} {phone(i)} {prose(i + 500, 5)}") for i in range(40)] + [(50, None), (51, ""), (None, phone(3))]
    full = {r.doc_id: r.spans for r in pii.personal_data(table(spark, rows)).collect()}
    part = {r.doc_id: r for r in pii.personal_data(table(spark, rows), hide="pmod(xxhash64(x.m), 5) = 0").collect()}
    assert {i: r.spans for i, r in part.items()} == full and 2 < sum(r.n_found for r in part.values()) < 20


def test_pii_any_text(spark):
    rows = [*ROWS, *((100 + i, t) for i, t in enumerate(TEXTS) if len(t) < 9000)]
    got = sorted((r.spans, r.secret_spans) for r in pii.personal_data(table(spark, rows)).collect())
    assert got == sorted(brute_spans([(t or "").replace("\x01", "\x03").replace("\x02", "\x03") for _, t in rows]))


def brute_base(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    g = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(g)


def test_quality(spark):
    rows = [*ROWS, (100, "a b c d e " * 40), (101, "x\n\n y\nx\n x\n\ty\n y"), (102, "p q r s t u p q r s t"), (103, "# * $ | <b> a&b " * 30), (104, prose(9, 200)), (105, " ".join(f"§{i}§" for i in range(200)))]
    rows = [(i, t, None if i == 104 else "en", "s") for i, t in rows]
    got = quality.quality(table(spark, rows)).collect()
    assert len(got) == len(rows)
    have = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    want = Counter((i, *(b := brute_base(t or "")), b[0] < 10 or 100 * b[4] > 20 * b[0]) for i, t, _, _ in rows)
    assert have == want
    by = {r.doc_id: r for r in got}
    assert by[104].kept and by[104].char_distance is None
    assert not by[105].kept and not by[105].base_failed and by[14].kept and by[8].kept
    assert not quality.quality(spark.createDataFrame([], SCHEMA)).collect()
    assert len(LONG) > 100_000


def brute_quality(rows):
    """Distances and verdicts, from counts of everything."""
    def classes(t):
        kind = lambda c: "white" if c in " \t\n\x0b\x0c\r" else "symbol" if c in "#*$%&|<>" else {"Ll": "lower", "Lu": "upper", "Nd": "digit"}.get(unicodedata.category(c), "other")
        n = Counter(map(kind, t))
        return [n[k] for k in quality.CLASSES]

    def distance(p, q):
        s = sum((x * math.log2(2 * x / (x + y)) if x else 0) + (y * math.log2(2 * y / (x + y)) if y else 0) for x, y in zip(p, q, strict=True)) / 2
        return max(s, 0) ** 0.5

    words = lambda t: [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    refs = {}
    for lang in {x for _, _, x, _ in rows if x}:
        texts = [t or "" for _, t, x, _ in rows if x == lang]
        chars, all_words = [sum(c) for c in zip(*map(classes, texts), strict=True)], [w for t in texts for w in words(t)]
        common = sorted((-n, w) for w, n in Counter(all_words).items() if n >= 0.002 * len(all_words))[:24]
        refs[lang] = ([c / sum(chars) for c in chars] if sum(chars) else None, [w for _, w in common], [-n / len(all_words) for n, _ in common])
    out = []
    for i, t, lang, _ in rows:
        b, own, w = brute_base(t or ""), classes(t or ""), words(t)
        failed, dc, dw = b[0] < 10 or 100 * b[4] > 20 * b[0], None, None
        if lang:
            chars, common, shares = refs[lang]
            mine = [w.count(x) / max(len(w), 1) for x in common]
            dc = round(distance([c / max(sum(own), 1) for c in own], chars), 6)
            dw = round(distance([*mine, max(0, 1 - sum(mine))], [*shares, max(0, 1 - sum(shares))]), 6)
        out.append((i, failed, not failed and not (b[0] >= 30 and lang is not None and (dc > 0.3 or dw > 0.42)), dc, dw))
    return out


def test_quality_by_brute_force(spark):
    """Two languages, words of all lengths, ties among common words (all of a rare language's), texts of any kind."""
    long = ["considerably", "Nevertheless", "the", "a", "extraordinarily", "of"]
    rows = [(i, " ".join(long[(i + j) % 6] + ("" if j % 3 else str(j % 7)) for j in range(20 + i)), "en", "s") for i in range(30)]
    rows += [(100 + i, prose(i, 45), "de", "s") for i in range(6)] + [(200, "Solo Una Vez 1 2 3", "es", "s"), (201, "$$ ## " * 40, "en", "s"), (202, "zzz yyy xxx " * 3 + prose(3, 40), "en", "s"), (203, prose(8, 50), None, "s"), (204, None, "en", "s"), (205, "", "en", "s"), (206, prose(9, 40).upper(), "de", "s"), (206, prose(9, 40).upper(), "de", "s")]
    rows += [(300 + i, prose(700 + i, 40).replace("a", "4"), "de", "s") for i in range(2)]
    got = [(r.doc_id, r.base_failed, r.kept, r.char_distance, r.word_distance) for r in quality.quality(table(spark, rows)).collect()]
    want = brute_quality(rows)
    close = lambda a, b: a == b or None not in (a, b) and abs(a - b) < 3e-6
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=repr), sorted(want, key=repr), strict=True):
        assert g[:3] == w[:3] and close(g[3], w[3]) and close(g[4], w[4]), (g, w)
    assert {k for _, _, k, _, _ in got} == {True, False} and any(not f and not k for _, f, k, _, _ in got)
