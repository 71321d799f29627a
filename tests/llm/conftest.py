import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=None):
    words = words or ["".join(rng.choice("aeioustrnlm") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


def corpus(seed=1):
    """Prose with copies, near copies, shared passages, repeats inside a text, non-ASCII, empty, null and repeated rows."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioustrnlmé") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows = [(i, prose(rng, rng.randint(1, 120), words)) for i in range(60)]
    passage, long = prose(rng, 40, words), prose(rng, 3000, words)
    rows += [(100, rows[3][1]), (101, rows[3][1]), (50000, rows[4][1] + "."), (102, f"{rows[5][1]} {passage} {rows[6][1]}"), (103, f"X {passage} Y"), (104, passage)]
    rows += [(105, passage + " " + passage), (106, "ab" * 300), (107, "ab" * 40), (108, "z" * 500), (109, ""), (110, None), (None, passage), (None, "few"), (111, "   \n\t "), (112, long), (113, long[500:9000]), (114, long.replace("a", "o", 3))]
    rows += [(112, long), (113, "other text for a used id " + passage), (115, "汉字" * 90), (116, "汉字" * 90 + "！"), (-7, passage[:99]), (-8, passage[:100]), (117, "é" * 70)]
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", None]), None if t is None else len(t)) for i, t in rows]


@pytest.fixture(scope="session")
def docs_rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, docs_rows):
    return spark.createDataFrame(docs_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
