import pytest

LONG = "lorem ipsum dolor " * 30_000
LINE = "This very line is longer than forty characters."


@pytest.fixture(scope="session")
def odd(spark):
    """Null and empty texts, a null id, a repeated row, a very long text, ties, and
    columns whose names clash with results."""
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi."),
        (2, "alpha BETA gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi."),
        (3, None),
        (4, ""),
        (5, " \n\t "),
        (6, LONG),
        (7, "one"),
        (7, "one"),
        (None, "one"),
        (8, "12345 %%% é 𝄞"),
        (9, "\n".join([LINE, "short", f"  {LINE.upper()}\r", ""])),
    ]
    return spark.createDataFrame([(i, t, "x", 1.5, "y") for i, t in rows], "doc_id long, text string, n_words string, score double, component_id string")


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)
