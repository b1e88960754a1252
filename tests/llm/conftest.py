import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text) as a table of documents, with extra columns of clashing names."""

    def make(rows, parts=3):
        full = [(i, t, "en", "src", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(full, DOCUMENTS).repartition(parts)
        clashing = "piece start length ids part rank k n_tokens shard size words component_id before key".split()
        return df.selectExpr("*", *(f"'x' AS {name}" for name in clashing))

    return make


ODD = [
    (1, "some words and more words"),
    (2, None),
    (3, ""),
    (4, "long " * 5000),
    (5, "same text"),
    (6, "same text"),
    (6, "same text"),
    (None, "a row without an id"),
    (7, " \n\t "),
    (8, "<|endoftext|> inside 漢字 text ! !"),
    (-9, "x" * 3000),
]


@pytest.fixture(scope="session")
def odd():
    return ODD
