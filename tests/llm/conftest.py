import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture
def documents(spark):
    """A frame with the columns of documents from (doc_id, text[, lang]) rows."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def odd_rows():
    """Nulls, empty and long texts, a row that is repeated and an id with two texts."""
    long_text = " ".join(f"word{k % 977} and{k % 13}," for k in range(30_000))
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, long_text), (5, "one two three"), (5, "one two three"), (6, "éß 中文 \U0001f600 x"), (6, "another text of id six here"),
        (None, "a row without an id but with words"), (7, "!!! 123 ..."), (8, "a" * 5000),
    ]
