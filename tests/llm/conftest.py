import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=4):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, size + 3))) for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    """Rows (doc_id, text) as a table like `documents`."""

    def made(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)

    return made


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty texts, ties, copies, a very long text, a null id and a repeated one."""
    rng = random.Random(5)
    long = "\n".join(words(rng, 40) for _ in range(500))
    plain = words(rng, 60)
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, "word"), (5, plain), (6, plain), (7, long), (8, "Ünïcødé 漢字 … “x”\n" * 3),
        (9, "a a a a a a a a"), (9, "a a a a a a a a"), (None, "null id text"), (10, plain + " tail"), (11, "\x1cseparators\x1d only\x85here"),
    ]
