import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, kid string, label int, h string, ids string, n_dropped int, seed string, part int"


def words(rng, n, pool=None):
    letters = "abcdefghilmnoprstu"
    return " ".join(rng.choice(pool) if pool else "".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, "s", None if text is None else len(text), "k", "kid", 1, "h", "ids", 2, "seed", 3)


@pytest.fixture(scope="session")
def corpus():
    """Documents with copies, near copies, repeated lines, and every odd case."""
    rng = random.Random(1)
    rows = [row(k, "\n".join(words(rng, rng.randint(8, 30)) for _ in range(rng.randint(1, 4)))) for k in range(40)]
    for k in range(40, 60):  # near copies: one word in twenty changed
        text = rows[k - 40][1].split(" ")
        rows.append(row(k, " ".join(words(rng, 1) if rng.random() < 0.05 else w for w in text)))
    rows += [row(60, rows[3][1]), row(61, rows[3][1]), row(62, rows[3][1])]
    rows += [row(70, None), row(71, ""), row(72, "   \n \n"), row(73, "!!! ???"), row(None, "text without an id here at all"), row(None, None), row(74, "one"), row(75, "one"), row(76, None, None)]
    rows += [rows[5], rows[5], row(6, "another text of the same id as before it was")]
    rows.append(row(80, " ".join([words(rng, 400)] * 30)))
    return rows


@pytest.fixture
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)
