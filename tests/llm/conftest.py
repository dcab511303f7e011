import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])

#: Odd rows for every operator: null, empty, blank, one sign, long, repeated, null id.
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, "7", None, "a", 1), (5, "a", "fr", "b", 1),
    (6, "word " * 30_000, "en", "b", 150_000), (7, "x" * 200_000, "en", "b", 200_000),
    (8, "same text here", "en", "b", 14), (8, "same text here", "en", "b", 14), (9, "same\ttext  here", "en", "c", 15),
    (10, "same text here", "en", "c", 14), (11, "Ünïcödé \U0001d4d0 文字 ​퟿ é", "de", "c", 9),
    (None, "no identifier", "en", "c", 13), (None, None, None, None, None), (8, "another text of eight", "en", "b", 21),
]


@pytest.fixture()
def docs(spark):
    def make(rows=ODD):
        rows = [r if len(r) == 5 else (*r, *(None,) * (5 - len(r))) for r in rows]
        return spark.createDataFrame(rows, SCHEMA)
    return make


@pytest.fixture()
def sf():
    return "/root/testdata/sf0.001"
