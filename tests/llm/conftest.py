import pytest

ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu.\nReleased under the MIT License.", "en"),
    (2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu.\nReleased under the MIT License.", "en"),
    (2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu.\nReleased under the MIT License.", "en"),
    (2, "another text under the same id " * 30, None),
    (3, None, "de"),
    (4, "", None),
    (None, "a row without an id, alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "fr"),
    (5, " \t\n\r ", "fr"),
    (6, "ÉLÉGANT, naïve – 日本語 ÀÉ it's 3.14\x1c\x85 x" + "y" * 3000, "fr"),
    (7, " ".join(f"w{i % 977}" for i in range(60_000)), "en"),
    (8, "stupid worthless text, you are a pathetic loser", "en"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    from pyspark.sql import functions as F

    extra = ["fingerprint", "component_id", "ids", "code", "own", "start", "__own", "words", "__words", "pos", "line", "score", "id", "kept", "tokens", "grams"]
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    return docs.withColumns({name: F.lit("x") for name in extra})


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def marks(spark):
    rows = [(i, i % 2, int(i == 8)) for i in range(1, 9)] + [(2, 0, 1), (None, 1, 1), (5, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def items(spark):
    rows = [("a", "alpha beta gamma delta epsilon zeta eta theta iota kappa"), ("b", "pathetic LOSER"), ("c", None), (None, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), ("a", "")]
    return spark.createDataFrame(rows, "item_id string, text string")
