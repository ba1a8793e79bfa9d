import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside, as a table may have them
    T.StructField("size", T.StringType()), T.StructField("_id", T.StringType()), T.StructField("key", T.StringType()),
])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text) or (id, text, lang, source) rows, with clashing extra columns."""

    def make(rows):
        full = [(r[0], r[1], *(r[2:] or ("en", "a")), None if r[1] is None else len(r[1]), "x", "y", "z") for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make
