import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, th string, key int, size string, score double"


def make_docs(spark, rows):
    """rows: (doc_id, text, source); with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en" if i is None or i % 2 else None, s, None if t is None else len(t), "x", 1, "big", None) for i, t, s in rows], DOCS)


@pytest.fixture(scope="session")
def corpus():
    """Invented texts: ordinary, empty, null, one word, white space, long, copies and ties."""
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abdeiklmnorstuéß") for _ in range(rnd.randint(1, 9))) for _ in range(900)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice((3, 30, 120, 400)))), f"s{i % 4}") for i in range(60)]
    rows += [(100, "", "s0"), (101, None, None), (102, "word", "s1"), (103, " \n\t ", ""), (104, " ".join(rnd.choice(words) for _ in range(40_000)), "s0")]
    rows += [(200 + i, rows[1][1], "s0") for i in range(40)] + [rows[2], rows[2], (None, rows[3][1], None), (105, "x" * 5000, "s1"), (106, "日本語テキスト😀" * 30, "s2")]
    return rows
