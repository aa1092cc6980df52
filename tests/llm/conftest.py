import pytest


@pytest.fixture
def table(spark):
    """A DataFrame of rows; documents get extra columns whose names clash with those that operators use inside."""

    def make(rows, schema, clash=True):
        df = spark.createDataFrame(rows, schema)
        return df.selectExpr("*", "1 as node", "'x' as hash", "2 as size", "3 as `part`", "'y' as `a.b`") if clash else df

    return make


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
