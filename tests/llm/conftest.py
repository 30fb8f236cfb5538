import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows and clashing column names."""
    long = "alpha beta gamma delta epsilon " * 60_000
    rows = [
        (1, None, None, "a", 0), (2, "", "s1", None, 0), (3, "  \n\t ", "s1", "x", 1), (4, "One two three four five six", "s1", "y", 1),
        (5, "one TWO three four five six", "s1", "z", 2), (5, "one TWO three four five six", "s1", "z", 2), (6, "Ünï cödé ÄB äb  x\n\ny", "s2", "", 3),
        (7, long, "s2", "l", 4), (8, "one two three four five six seven\nAll rights reserved.", None, "m", 5), (None, "no id here at all", "s2", "n", 6),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score string, fp int")
