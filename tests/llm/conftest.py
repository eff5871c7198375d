import pytest

from tests.llm.helpers import SCHEMA, odd_rows


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and
    extra columns whose names the operators use themselves."""
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    from tests.llm.helpers import SF
    return spark.read.parquet(f"{SF}/documents.parquet")
