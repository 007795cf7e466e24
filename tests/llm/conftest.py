import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """A handful of documents with nulls, empty and long texts, ties and repeated rows."""
    rows = [
        (1, "one two three", "en", "a", 13, "x"),
        (2, None, "en", "a", None, "x"),
        (3, "", None, "b", 0, None),
        (4, "one two three", "en", None, 13, "x"),
        (4, "one two three", "en", None, 13, "x"),
        (None, "no id here", "fr", "b", 10, "x"),
        (5, "word " * 5000, "de", "c", 25000, "x"),
        (6, "  \t\n ", "de", "c", 5, "x"),
        (7, "Ünïcödé \x00 and   more \U0001f600", "de", "c", 25, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string")
