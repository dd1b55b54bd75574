import pytest


@pytest.fixture(scope="session")
def rows_of(spark):
    """A DataFrame from rows and a schema, in several partitions."""

    def build(rows, schema, parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts)

    return build


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
