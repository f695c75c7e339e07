import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, first=0):
        """Texts, or (doc_id, text) pairs, as a table of documents."""
        rows = [t if isinstance(t, tuple) else (first + i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", "src0", len(t) if t is not None else None) for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
