import sys

import pytest

import oracle

sys.setrecursionlimit(10_000)

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small_duck(small_dir):
    return oracle.connect(small_dir)


@pytest.fixture(scope="session")
def small_docs(spark, small_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}


@pytest.fixture
def frame(spark):
    """Documents of ``(id, text)`` rows with columns whose names clash with what operators use inside."""

    def make(rows):
        schema = "doc_id BIGINT, text STRING, id STRING, uid INT, row STRING, h STRING, score STRING, name STRING"
        return spark.createDataFrame([(i, t, "x", 1, None, "h", "s", "n") for i, t in rows], schema)

    return make
