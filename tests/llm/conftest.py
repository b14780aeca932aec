import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, letters="abcdefghij"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n)]


def corpus(seed=7, n=60):
    """Rows (doc_id, text, lang, source, n_chars): plain texts, exact and near copies, nulls, empties, a long text."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = " ".join(words(rng, rng.randint(1, 120)))
        if i % 10 == 3:
            text = rows[i - 3][1].upper() if rows[i - 3][1] else "X"
        if i % 10 == 7:
            parts = (rows[i - 1][1] or "x").split()
            parts[len(parts) // 2] = "changed"
            text = " ".join(parts)
        rows.append((i, text, "en" if i % 3 else None, ["a", "b", None, "hot"][min(3, i % 8)], len(text)))
    rows.append((n, None, None, "a", None))
    rows.append((n + 1, "", "en", None, 0))
    rows.append((n + 2, " ".join(words(rng, 9000)), "de", "b", 1))
    rows.append((n + 3, "é ß\nname=Ünïcode 𝒳 token: 'abcDEF123456'", "fr", "hot", 1))
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Repeated rows, null ids, and extra columns whose names the operators use themselves."""
    rows = [(1, "Same Text here", "en", "a", 1, 9), (1, "Same Text here", "en", "a", 1, 9), (2, "same text HERE", None, None, 2, 9), (None, None, None, None, None, None), (5, "", "en", "a", 0, 9), (6, "same text here", "en", "b", 0, 9)]
    return spark.createDataFrame(rows, SCHEMA.replace("n_chars long", "_id long, keep_id long"))
