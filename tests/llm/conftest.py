import pytest


@pytest.fixture(scope="session")
def table(spark):
    """Documents from (id, text) pairs, with columns whose names operators also use inside."""

    def make(rows, extra=True):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return df.selectExpr("doc_id", "text", "'x' as n_words", "1 as chunk", "2 as quality", "3 as sid", "4 as id", "'en' as lang") if extra else df

    return make
