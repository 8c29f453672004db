import pytest

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, node string, size double, _hash int, text_crc32 string"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, ties, repeated rows, a long text, clashing column names."""
    long = "word alpha beta. " * 20000
    rows = [
        (1, None, "en", "a", 0, None, None, None, None),
        (2, "", None, None, None, "x", 1.0, 1, "y"),
        (3, " \t\n \x0b", "en", "a", 4, "x", 1.0, 1, "y"),
        (4, "One two three.", "en", "b", 14, "x", 1.0, 1, "y"),
        (5, "one TWO three.", "en", "b", 14, "x", 1.0, 1, "y"),
        (6, long, "en", "c", len(long), "x", 1.0, 1, "y"),
        (7, long + "more words at the end of it", "en", "c", 0, "x", 1.0, 1, "y"),
        (None, "One two three.", "en", None, 14, "x", 1.0, 1, "y"),
        (None, None, None, None, None, None, None, None, None),
        (8, "Ça va, très bien… #$%& 12 | 13 | 14 | 15", "fr", "a", 40, "x", 1.0, 1, "y"),
        (8, "Ça va, très bien… #$%& 12 | 13 | 14 | 15", "fr", "a", 40, "x", 1.0, 1, "y"),
        (9, "single", "en", "", 6, "x", 1.0, 1, "y"),
        (9, "another text under the same id, with some more words.", "en", "b", 52, "x", 1.0, 1, "y"),
    ]
    return spark.createDataFrame(rows, DOC)
