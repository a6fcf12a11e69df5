import random

import pytest

SF = "/root/testdata/sf0.001"
WORDS = [f"w{k}" for k in range(60)] + ["The", "of", "Straße", "é", "漢字", "don't", "1,000"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ",", ".\n"]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Copies, near copies, shared passages, and the odd cases: null, empty, blank, very long, tiny."""
    rng = random.Random(3)
    base = [prose(rng, rng.randint(5, 300)) for _ in range(40)]
    shared = prose(rng, 90)
    near = [" ".join(w if rng.random() > 0.02 else "x" for w in base[k % 5].split(" ")) for k in range(40)]
    passages = [prose(rng, 60) + shared + prose(rng, 40) for _ in range(6)]
    odd = [None, "", " ", "\n\n", "a", "a b c", "A  B\tc", "ab" * 900, "ab" * 900, "z" * 1500, prose(rng, 9_000), shared, "  x" * 200]
    return base + base[:7] + near + passages + odd


@pytest.fixture
def documents(spark, texts):
    """The texts as a table, one row twice, with columns whose names clash with those of results."""
    rows = [(k, t, "en", "src", len(t or ""), 1, "row") for k, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words int, row string"
    return spark.createDataFrame([*rows, rows[3], rows[3]], schema).repartition(5)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
