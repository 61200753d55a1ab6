import pytest

SCHEMA = "note string, doc_id long, text string, source string, lang string, h string, n int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names clash with internal ones."""

    def make(rows):
        return spark.createDataFrame([("x", i, t, s, "en", "clash", 1) for i, t, s in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """NULLs, empties, repeats, ties, and a very long text."""
    words = [f"w{i * 7919 % 4001}" for i in range(30_000)]
    return [(1, None, "a"), (2, "", "b"), (3, " \t\n ", None), (4, "one two", "a"), (5, "one two", "a"), (5, "one two", "a"),
            (None, "no id here at all", "b"), (6, " ".join(words), "a"), (7, " ".join(words[:25_000]), "c"), (8, "été 中文 \U0001f600", None)]
