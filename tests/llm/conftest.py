import public_tokenizers
import pytest


@pytest.fixture(scope="session")
def vocabulary():
    return public_tokenizers.path


@pytest.fixture(scope="session")
def odd_rows(spark):
    """Nulls, empty, repeated, tied and very long texts, and a column whose name clashes."""
    long = " ".join(f"w{i % 977} the of" for i in range(40_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", 1),
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", 1),
        (2, None, None, 2),
        (3, "", "en", 3),
        (None, "no id here", None, 4),
        (None, None, None, 5),
        (4, "a b", "en", 6),
        (4, "another text of the same id", "en", 7),
        (5, long, "en", 8),
        (6, "  \n\t ", "en", 9),
        (7, "x" * 3000, "en", 10),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")


@pytest.fixture(scope="session")
def no_rows(odd_rows):
    return odd_rows.filter("false")
