import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def rng():
    return random.Random(11)


@pytest.fixture
def docs_of(spark):
    """A documents table of some texts, with a column that clashes with operators' own names."""

    def make(texts, first=0):
        rows = [(first + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCUMENTS)

    return make


def words(rng, n, size=300):
    return [f"w{rng.randrange(size)}" for _ in range(n)]
