import pytest

from samples import CLASHING, DOCS, awkward_docs


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(awkward_docs(), DOCS)


@pytest.fixture(scope="session")
def clashing(spark, docs):
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
