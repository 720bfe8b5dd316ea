import duckdb
import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (id, text) pairs, or from (id, text, lang)."""

    def make(rows, **extra):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None if r[1] is None else len(
            r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        for name, value in extra.items():
            df = df.withColumn(name, value)
        return df

    return make


@pytest.fixture(scope="session")
def sf_rows():
    """All documents of the smallest table, read without Spark."""
    return duckdb.sql(
        "SELECT doc_id, text, lang FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
