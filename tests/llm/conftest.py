import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
#: nulls in every column, empty and very long texts, ties, repeated rows
ODD = [(1, "one two three four five six", "en", "a", 27), (1, "one two three four five six", "en", "a", 27),
       (2, None, "en", "a", None), (3, "", None, None, 0), (None, "one two three", "en", None, 13),
       (4, "   \n\t ", "de", "a", 6), (5, LONG, "en", "b", len(LONG)), (6, LONG, None, "b", 1),
       (7, "Under the MIT License; licensed under CC BY-NC 4.0.", "en", "b", 1),
       (8, "naïve café ☃ 日本 ▁x", "fr", "b", 1)]


@pytest.fixture
def odd_docs(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def clash():
    """Add columns whose names the operators use for their own."""
    from pyspark.sql import functions as F

    def add(df):
        for name in ("score", "predicted", "copy_no", "mix_key", "ids", "n_tokens", "kept", "n_words",
                     "labels", "places", "base_failed", "rate", "weight", "content", "node", "block"):
            df = df.withColumn(name, F.lit("x"))
        return df
    return add
