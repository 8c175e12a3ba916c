"""Small tables with what operators have to stand: nulls, empty and long texts, ties, repeats, extra columns."""

import random

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = ("ka", "lo", "mi", "ren", "tu", "sel", "vo", "da", "ni", "par", "é", "ß")


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n))


def texts() -> list:
    base, passage = prose(1, 300), prose(2, 120)
    near = base.split()
    near[100] = "other"
    return [
        (1, base), (2, base), (3, " ".join(near)), (4, prose(4, 200) + " " + passage + " " + prose(5, 90)), (5, passage + "\n" + prose(6, 50)),
        (6, None), (7, ""), (8, "word"), (9, " \t\n"), (10, "same line here\n" * 60), (11, prose(7, 9000)), (12, "x" * 5000), (13, "a b " * 400),
        (15, prose(8, 80).upper()), (None, prose(9, 120)), (16, "one two"), (17, "One  TWO")]


def documents(spark, rows=None, repeated=True):
    """The texts above, one row twice, and columns whose names operators might use themselves."""
    rows = texts() if rows is None else rows
    rows = rows + [rows[3]] if repeated and len(rows) > 3 else rows
    frame = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCUMENT)
    from pyspark.sql import functions as F

    return frame.withColumns({name: F.lit(7) for name in ("th", "id", "score", "tokens", "spans", "rep", "path", "bucket", "component", "ids", "words", "start")})


def empty(spark):
    return documents(spark, [])


def as_bytes(rows):
    return [(d, (t or "").encode()) for d, t in rows]
