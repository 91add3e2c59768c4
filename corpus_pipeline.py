"""The corpus pipeline: stages over ``documents``, each written and read again by the next.

All stages but the last return the columns of ``documents``. Documents that the quality classifier rejects
go; repeated passages of lines go, and with them documents of which no word is left; of each group of near
copies the smallest id stays; documents that hold a benchmark item go; the rest is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bytebpe, decontam, jaccard, linerepeats, subword
from gridloom.llm.queries import RANKS
from gridloom.llm.registry import table
from gridloom.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return subword.keep_good(docs, subword.fit_quality(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = linerepeats.delete_repeats(docs).where("not emptied").select("row.*")
    if "n_chars" not in docs.columns:
        return rows
    return rows.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bytebpe.digests(docs, RANKS)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: The classifier, the edit matching and the encoder can't be said in SQL; the tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
