import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
NASTY = [
    None, "", " ", "\n\n\t", "a", "a\x00b", "É é ß ﬁ 中文 😀 ́x", "word " * 3000, "x" * 20000, "\r\n" * 50, "don't WE'LL 'tis ''s x's", "a　b c d e\x85f\x1cg",
    "AKIA" + "B" * 20, 'token="abcdefgh12345678"', "same text here twice for all", "same text here twice for all", "same text here twice for all", "0" * 64, "1 2 3 4 5 6 7 8 9 10", "###$$$%%%&&&***|||<<<>>>",
]


@pytest.fixture(scope="session")
def nasty(spark):
    rows = [(i, t, None if i % 3 else "en", None if i % 4 == 0 else f"src{i % 2}", None if t is None else len(t)) for i, t in enumerate(NASTY)]
    rows += [(None, "nameless", "en", "s", 8), (None, None, None, None, None), (3, NASTY[3], None, "src1", 4), (3, NASTY[3], None, "src1", 4)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)

