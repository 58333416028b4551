import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, clashing extra columns."""
    long = " ".join(f"word{i % 977} thing{i % 31}" for i in range(30000))
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 3), (4, long, "en", "b", len(long)),
        (5, "The cat sat on the mat and looked at the dog.\nThen it slept.", "en", None, 60), (5, "The cat sat on the mat and looked at the dog.\nThen it slept.", "en", None, 60),
        (6, "Le chat était là où le soleil brille, près de la fenêtre.", "fr", "a", 57), (None, "no id here", "en", "a", 10),
        (7, "12345 67890 !!!", None, "b", None), (8, "é" * 700 + " \U0001f600 end", "fr", "c", 705),
    ]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({"bucket": F.lit("x"), "okey": F.lit(1.5), "fingerprint": F.lit(None).cast("string"), "key": F.lit(0), "score": F.lit(9)})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
