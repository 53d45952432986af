"""Small tables for the tests, and plain versions of what the operators compute."""

import random
import re

ASCII_LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate(ASCII_LOW))


def sentence(seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice("the of and river stone light under green house walks seldom over bright iron paper "
                             "window garden motion yellow quiet".split()) + str(r.randrange(40)) for _ in range(n))


def documents(spark, rows, extra="id long, n int, key string, root string, `filter` string, a int, b int"):
    """(doc_id, text) rows with further columns whose names the operators use themselves."""
    names = re.findall(r"`?(\w+)`? \w+", extra)
    return spark.createDataFrame([(i, t, *([None] * len(names))) for i, t in rows], f"doc_id long, text string, {extra}")


def edge_rows():
    """Null, empty, blank, long, repeated and tied rows."""
    base = sentence(1)
    near = base.replace("the", "a", 1) + " tail"
    long = sentence(2, 30_000)
    return [(1, base), (2, base), (3, near), (4, None), (5, ""), (6, " \n\t "), (7, long), (8, long + " more"),
            (9, "two words"), (10, "Two  WORDS"), (11, sentence(3)), (11, sentence(3)), (None, base), (None, None),
            (12, "x" * 5000), (13, "é È 日本 😀")]
