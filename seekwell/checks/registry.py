"""Registered queries and the SQL each of them must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from seekwell.scale import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Test tables by name, and the derived inputs several queries share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def documents(self) -> DataFrame:
        return spread(self.spark.read.parquet(f"{self.folder}/documents.parquet"))

    @property
    def corpus(self) -> DataFrame:
        return self.documents.select(F.col("doc_id").alias("docid"), "text")

    @property
    def topics(self) -> DataFrame:
        return self.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("query"))

    @property
    def vec_queries(self) -> DataFrame:
        return self.embeddings.select(F.col("vec_id").alias("qid"), "embedding")

    @property
    def vec_corpus(self) -> DataFrame:
        return self.embeddings.select(F.col("vec_id").alias("docid"), "embedding")


def register(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return fn

    return add
