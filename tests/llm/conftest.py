import pytest

from tests.llm.cases import SCHEMA, table


@pytest.fixture(scope="session")
def awkward(spark):
    return table(spark).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
