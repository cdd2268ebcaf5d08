import pytest


@pytest.fixture
def table(spark):
    """Build a DataFrame of (doc_id, text) rows with extra columns of clashing names."""

    def build(rows, extra=True):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return df.selectExpr("*", "1 as n", "'x' as row", "2L as place", "'y' as entity") if extra else df

    return build
