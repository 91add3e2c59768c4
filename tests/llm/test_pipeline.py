"""The stages of the pipeline and the whole of it."""

import hashlib

import corpus_pipeline
from gridloom.llm import decontam


def test_pipeline(spark, small_dir, small_docs):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, small_dir).cache()
        assert docs.columns == before.columns and docs.dtypes == before.dtypes
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in before.select("doc_id").collect()}
        seen.append(len(ids))
    assert sorted(seen, reverse=True) == seen and 0.3 * len(small_docs) < seen[-1] < len(small_docs)
    items = [decontam.normal(r.text) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    left = {r.doc_id: r.text for r in docs.collect()}
    assert not [i for i, text in left.items() if any(x in decontam.normal(text) for x in items)]
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, small_dir).collect()}
    assert rows.keys() == left.keys()
    assert all(rows[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() for i, text in left.items())


def test_stages_take_empty_and_odd_tables(spark, small_dir):
    odd = spark.createDataFrame(
        [(1, None, "en", "s", None, 1), (2, "", None, None, 0, 2), (2, "", None, None, 0, 2), (None, "a few plain words", "en", "s", 17, 3)],
        "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, score INT",
    )
    for table in (odd, odd.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, small_dir)
            assert out.count() <= table.count()
            if name != "byte_bpe":
                assert out.columns == table.columns
