import pytest

COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long, __doc long, __text_key string, __row int, score int, ids string, bitmap int, "
    "n_lines string, component_id string, __fp int, held_out string, block int"
)


def rows_of(*pairs):
    """Rows (doc_id, text, lang, null source, null n_chars, clashing columns)."""
    return [(i, t, lang, None, None, 7, "k", 1, 2, "x", 3, "n", "c", 4, "h", 5) for i, t, lang in pairs]


LONG = "The quick brown fox jumps over the lazy dog near the river bank today. " * 4000


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing column names."""
    long = LONG + "one more closing remark"
    pairs = [
        (1, None, "en"), (2, "", None), (3, long, "en"), (4, long, "en"), (4, long, "en"), (5, "same line of text here\nshort\nsame line of text here", "en"),
        (6, "  SAME line of text here \nanother line of words", "en"), (None, "same line of text here\nonly a null id", "en"), (None, None, None),
        (7, "1234 5678 !!!", "en"), (8, "é" * 9 + "\n" + "é" * 9, "fr"), (9, "é" * 10, "fr"), (10, "é" * 10, "fr"), (4, "another text under a repeated id", "en"),
    ]
    return spark.createDataFrame(rows_of(*pairs), COLUMNS).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
