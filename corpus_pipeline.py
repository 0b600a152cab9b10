"""Training corpus from raw documents: judge, deduplicate, decontaminate, redact, pack.

Each stage takes (spark, documents, table folder) and works on all rows its predecessor kept. ``run`` writes every
stage's result as Parquet to the shared folder and reads it again, so a lost executor never repeats earlier stages.
All stages but the last return the columns of ``documents``; rows they do not reject stay as they are, apart from
redacted texts. An empty table passes through; see the operators for nulls, repeats and ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seekwell.llm import decontamination, packing_genetic, quality_classifier, secrets, simhash
from seekwell.llm.common import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.accepted(docs, quality_classifier.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing_genetic.packed_pieces(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", secret_scans),
    ("best-fit packing", packing),
]
# The classifier, the fingerprints, the automata and the packing have no SQL form; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), "pipeline")
    return docs
