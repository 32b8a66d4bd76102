import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, score string, size string"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, blanks, one very long text, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"word{i % 977} 10.0.0.{i % 300}" if i % 50 == 0 else f"word{i * 7 % 1013}" for i in range(60_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 9, "n", "s", "z"), (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 9, "n", "s", "z"),
        (2, "the quick brown fox jumps over the lazy dog again and again", None, None, None, None, None, None), (3, None, None, "a", None, "n", "s", "z"), (4, "", "en", "a", 0, "n", "s", "z"),
        (5, " \n\t ", "de", "a", 4, "n", "s", "z"), (6, long, "en", "a", len(long), "n", "s", "z"), (None, "der schnelle braune fuchs springt", "de", None, None, None, None, None),
        (8, "12345 67890 !!!", "de", "a", 1, "n", "s", "z"), (9, "one", "en", "a", 3, "n", "s", "z"), (10, "éàü ñ 語 \U0001f600", "fr", "a", 3, "n", "s", "z"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
