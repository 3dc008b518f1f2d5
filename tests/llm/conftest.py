import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, batch int, lang_pred string, n long"


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra
    columns whose names clash with those that operators add."""
    prose = "the quick brown fox jumps over the lazy dog and runs away from it into the deep dark wood"
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(40_000))
    rows = [
        (1, prose, "en", "a", 1), (2, prose, "en", "a", 1), (3, prose + " again", "en", "b", 1), (3, prose + " again", "en", "b", 1), (4, None, "en", "b", None),
        (5, "", None, None, 0), (6, " \t\n ", "de", "c", 3), (7, long, None, None, None), (8, long + " end", "fr", "c", 1), (None, "no id here", "en", "a", 1),
        (None, None, None, None, None), (9, "ÄÖ é́ 漢字 𝄞 \x00 \x1c|", "de", "c", 1), (10, "same line\n  Same Line\t\n\nother", "en", "a", 2), (11, "12 34 !!", "xx", "d", 1),
        (12, "a b c", "en", "a", 1), (13, "A B C", "en", "a", 1), (14, "a b c d", "en", "a", 1),
    ]
    return spark.createDataFrame([(*r, 0.5, "x", 1, "y", 2) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"

