import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and long texts, repeated rows, and columns of unlucky names."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    rows = [
        (1, base, "en", "a", 10), (2, base, "en", "a", 10), (2, base, "en", "a", 10), (3, None, "en", "a", None), (4, "", None, "b", 0), (5, " \t\n", "de", "b", 3),
        (None, base + " phi", "en", None, 5), (6, "one", "en", None, 3), (7, "word " * 30000, "en", "c", 150000), (8, base.upper(), None, None, None), (9, "é ü " + base[::-1], "fr", "c", 9),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("mine") for c in ("size", "target", "fp", "keep", "n", "k", "s", "paths", "kind", "value", "n_entities", "evidence", "feature")})


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
