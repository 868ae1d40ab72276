import pytest

from tests.llm.edges import EDGE_ROWS, EDGE_SCHEMA


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE_ROWS, EDGE_SCHEMA)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)
