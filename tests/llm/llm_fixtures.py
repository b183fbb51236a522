import pytest  # fixtures are imported by the test modules; a second conftest would hide the first
from pyspark.sql import types as T

#: documents with the columns that operators must ignore or keep, and names they might use themselves
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("id", T.StringType()),
    T.StructField("kept", T.StringType()), T.StructField("score", T.LongType()), T.StructField("label", T.StringType()),
    T.StructField("n_words", T.StringType())])

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 9_000


def odd_rows():
    """Null, empty, blank, very long, repeated and non-ASCII texts, a null id, equal texts."""
    plain = "The quick brown fox jumps over the lazy dog while seven green birds sing near a quiet river bank today"
    texts = [None, "", " \n\t ", "one", "two words", plain, plain, plain.upper(), LONG, "Ünïcode straße 漢字 😀 tail", "a\x00b c\x1cd", "<|end|> & </turn> \\"]
    rows = [(i, t, "x", "y", i, None, "z") for i, t in enumerate(texts)]
    return rows + [(5, plain, "x", "y", 5, None, "z"), (None, plain, "x", None, None, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
