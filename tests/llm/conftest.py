import pytest
from odd_rows import ODD


@pytest.fixture()
def odd(spark):
    """The rows above, with columns whose names clash with those that operators make."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "length(text) AS n_chars", "1 AS salt", "2 AS h", "'x' AS kept", "3 AS removed", "4 AS size", "5 AS fp", "6 AS ids", "7 AS block", "8 AS data", "9 AS score", "10 AS copies", "11 AS _copy").repartition(3)


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
