"""Documents for all tests of this folder."""

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("low", T.IntegerType()), T.StructField("digest", T.StringType())])


@pytest.fixture(scope="session")
def frame(spark):
    """Makes a table of documents with two extra columns whose names the operators use inside."""
    from girder.llm.common import on_workers

    on_workers(spark)

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], DOCS)

    return make
