import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """A few rows of each awkward kind: null in every column, empty, blank, repeated, very long."""

    def make(rows=None):
        if rows is None:
            words = " ".join(f"word{i % 977}" for i in range(30_000))
            rows = [
                (1, "The quick brown fox. " * 30, "en", "a", 5),
                (1, "The quick brown fox. " * 30, "en", "a", 5),
                (2, None, "en", "a", None),
                (3, "", "en", None, 0),
                (4, "  \n\t ", None, "b", 3),
                (None, "no id here but text", "en", "b", 3),
                (5, words, "en", "b", len(words)),
                (6, "x" * 100_000, "en", "c", 100_000),
                (7, "1 " * 20_000, "en", "c", 40_000),
                (8, None, None, None, None),
            ]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
