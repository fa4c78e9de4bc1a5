"""Small tables with the awkward cases: nulls, empties, ties, repeated rows, long texts, clashing column names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n long, fp string, grp int, digit string, kept string"


def table(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s")), len(r[1] or ""), "x", 7, "y", 1, "z", "k") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


LONG = prose(1, 30_000)
ROWS = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "a b"), (5, "ab"), (6, "a  b"), (6, "a  b"), (7, " ab"), (8, LONG), (9, LONG + " "), (10, LONG + "x"),
    (None, "ab"), (11, "é" * 40), (12, "é" * 40), (13, "\U0001f600 ok"), (14, prose(2, 60)), (15, prose(2, 60)), (16, prose(2, 59) + " changed"), (17, prose(3, 60)),
]
