import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, copies string, kept string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, columns with output names."""
    prose = " ".join(f"wort{i % 97} the of" for i in range(60))
    rows = [
        (1, prose, "en", "a", 5, "x", "y", "z"), (2, prose, "en", "a", 5, "x", "y", "z"),
        (2, prose, "en", "a", 5, "x", "y", "z"), (3, "", "de", "b", 0, None, None, None),
        (4, None, None, None, None, None, None, None), (None, prose + " end", "fr", None, 1, "x", "y", "z"),
        (5, "one two", None, "b", 7, "x", "y", "z"), (6, " ".join(f"long{i * i % 10007}" for i in range(30_000)), "en", "c", 1, "", "", ""),
        (7, "\n\t \r\n", "en", "c", 1, "", "", ""), (8, "ünïcödé 漢字 🙂 " * 12, "es", "", 1, "", "", ""),
        (None, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
