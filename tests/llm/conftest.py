import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A documents table from (doc_id, text) or (doc_id, text, lang, source) rows."""

    def make(rows, parts=3):
        full = [(*r, *(None,) * (4 - len(r)))[:4] for r in rows]
        full = [(*r, len(r[1]) if r[1] is not None else None) for r in full]
        return spark.createDataFrame(full, COLUMNS).repartition(parts)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty and blank texts, a null id, repeated rows, ties, accents and a long text."""
    long_text = "\n".join(f"line {i} of a very long text with word{i % 97} and word{i % 89}" for i in range(4000))
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (6, "one two three"),
        (7, "é à ü ñ ß 漢字 words and é à ü"), (7, "é à ü ñ ß 漢字 words and é à ü"),
        (None, "a row without an id has words of its own here"), (8, long_text), (9, long_text + "\nlast"),
        (10, "tie tie tie tie"), (11, "a\x00b\x85c d e f"),
    ]


@pytest.fixture(scope="session")
def prose():
    """Random prose over one vocabulary."""
    letters = random.Random(0)
    vocabulary = ["".join(letters.choices("abcdefgimnoprstu", k=letters.randrange(2, 9))) for _ in range(400)]

    def make(seed, words):
        return " ".join(random.Random(seed).choices(vocabulary, k=words))

    return make
