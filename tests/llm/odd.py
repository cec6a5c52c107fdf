"""Small tables with the cases that every operator has to meet."""

from __future__ import annotations

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, size int"


def documents(spark, more=()):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    long = "lorem ipsum dolor sit amet " * 6000
    rows = [
        (1, None, "en", "a", 0, "x", 1), (2, "", "en", "a", 0, "x", 1), (3, " \t\n\r ", None, "b", 5, None, None),
        (4, long, "en", "a", len(long), "y", 2), (5, "one two three four", None, None, 1, None, None),
        (6, "One two THREE four", "fr", None, 1, None, 3), (7, "same text again " * 9, "de", "b", 1, "", 0),
        (7, "same text again " * 9, "de", "b", 1, "", 0), (None, "a row without an id " * 5, "en", "a", 1, "z", 9),
        (8, "Été à Zürich, 東京 и 123 #$%", "fr", "b", 3, None, None), (9, "12 34 !! ##", "en", "é", 3, None, None),
    ]
    return spark.createDataFrame(rows + list(more), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
