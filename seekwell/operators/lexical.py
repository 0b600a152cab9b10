"""Inverted index, BM25 and sparse-weight retrieval.

All term-based searches are one operator, :func:`seekwell.operators.blocks.search_blocks`: the
score is the sum of weight products over shared terms, documents lie in blocks of postings
with bounds, and a task skips the blocks that cannot reach a query's best ``k``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seekwell.functions.text import token_counts, tokens
from seekwell.operators.blocks import blocks_of_postings, blocks_of_texts, corpus_counts, cut_blocks, postings_of, search_blocks, term_counts, write_blocks
from seekwell.scale import BROADCAST_BYTES, BROADCAST_TERM_ROWS


@dataclass
class LexicalIndex:
    """Postings ``(docid, token, tf, dl)`` and one row of corpus statistics, as views.

    A new index keeps the token lists ``docs`` ``(docid, toks)``, which a search cuts into
    blocks of the query's tokens; a saved one has ``blocks`` of all tokens and ``terms``
    ``(token, df)``. An index of postings alone is brought together by document first.
    """

    postings: DataFrame
    stats: DataFrame
    terms: DataFrame | None = None
    docs: DataFrame | None = None
    stop: list[str] | None = None
    blocks: DataFrame | None = None

    def save(self, path: str) -> None:
        """Blocks of postings, and the document frequencies sorted by token, so that a search prunes their row groups."""
        saved = write_blocks(self.blocks if self.blocks is not None else _made_blocks(self, None), f"{path}/blocks")
        term_counts(saved).repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{path}/terms")
        corpus_counts(saved).write.mode("overwrite").parquet(f"{path}/stats")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "LexicalIndex":
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        return LexicalIndex.of_blocks(read("blocks"), read("stats"), read("terms"))

    @staticmethod
    def of_blocks(blocks: DataFrame, stats: DataFrame | None = None, terms: DataFrame | None = None) -> "LexicalIndex":
        return LexicalIndex(postings_of(blocks), corpus_counts(blocks) if stats is None else stats, terms, blocks=blocks)


def term_stats(postings: DataFrame) -> DataFrame:
    """Documents per token. Postings hold a (document, token) pair once."""
    return postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def build_index(corpus: DataFrame, tokenizer="whitespace", stop: list[str] | None = None) -> LexicalIndex:
    """Index ``(docid, text)``. Stop tokens get no postings but count in the length.

    Term counts are made inside the row, so building postings needs no shuffle.
    """
    toks = corpus.select("docid", tokens("text", tokenizer).alias("_t"))
    lengths = toks.select("docid", F.size("_t").alias("dl"))
    kept = F.filter("_t", lambda t: ~t.isin(list(stop))) if stop else F.col("_t")
    postings = (
        toks.select("docid", F.size("_t").alias("dl"), F.inline(token_counts(kept)))
        .select("docid", "token", F.col("n").alias("tf"), "dl")
    )
    stats = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("dl").alias("n_tokens"))
    return LexicalIndex(postings, stats, docs=toks.select("docid", F.col("_t").alias("toks")), stop=list(stop) if stop else None)


def query_terms(queries: DataFrame, tokenizer="whitespace", stop: list[str] | None = None) -> DataFrame:
    """``(qid, token, qtf)``; a repeated query token counts again."""
    t = tokens("query", tokenizer)
    if stop:
        t = F.filter(t, lambda x: ~x.isin(list(stop)))
    return queries.select("qid", F.inline(token_counts(t))).select("qid", "token", F.col("n").alias("qtf"))


def bounded_parts(rows: DataFrame, max_rows: int | None = None) -> list[DataFrame]:
    """``rows`` of queries in parts that may reach every task, whole queries each: one part if the measured rows and
    bytes stay below the bounds, else as many as needed, dealt by a hash of the query."""
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("token") + 24), F.lit(0)).alias("bytes")).first()
    n = max(1, math.ceil(size["n"] / (max_rows or BROADCAST_TERM_ROWS)), math.ceil(size["bytes"] / BROADCAST_BYTES))
    return [rows] if n == 1 else [rows.filter(F.pmod(F.xxhash64("qid"), F.lit(n)) == i) for i in range(n)]


def bm25_search(index: LexicalIndex, queries: DataFrame, k: int, k1: float = 0.9, b: float = 0.4,
                length_norm: bool = False, tokenizer="whitespace") -> DataFrame:
    """BM25 run ``(qid, docid, score, rank)``.

    ``length_norm=False`` uses the raw document length, ``True`` the length relative to
    the corpus average. Documents without a shared token are not returned. The corpus is
    tokenised once per part of the queries; a saved index is not tokenised at all.
    """
    q = query_terms(queries, tokenizer)
    parts = bounded_parts(q)
    qid_type = queries.schema["qid"].dataType
    blocks = index.blocks
    if blocks is None and len(parts) > 1:
        blocks = cut_blocks(_made_blocks(index, None))
    runs = []
    for part in parts:
        asked = part.toPandas()
        vocabulary = sorted(set(asked["token"]))
        mine = blocks if blocks is not None else cut_blocks(_made_blocks(index, vocabulary))
        stats = _stats(index, mine)
        known = index.terms if index.terms is not None else term_counts(mine)
        names = mine.sparkSession.createDataFrame([(t,) for t in vocabulary], "token string")
        df = known.join(F.broadcast(names), "token").toPandas()  # at most one row per token of the part
        n, avg = float(stats["n_docs"]), max(stats["n_tokens"], 1) / max(stats["n_docs"], 1)
        idf = np.log((n - df["df"].astype(float) + 0.5) / (df["df"].astype(float) + 0.5) + 1)
        weights = asked.merge(pd.DataFrame({"token": df["token"], "w": idf}), on="token")
        weights["w"] *= weights["qtf"] * (k1 + 1)
        runs.append(search_blocks(mine, stats["n_blocks"], weights, qid_type, _saturation(k1, b, avg if length_norm else 1.0), k))
    return reduce(DataFrame.unionAll, runs)


def _saturation(k1: float, b: float, unit: float):
    return lambda tf, dl: tf / (tf + k1 * ((1 - b) + b * (dl / unit)))


def _made_blocks(index: LexicalIndex, vocabulary: list[str] | None) -> DataFrame:
    if index.docs is not None:
        return blocks_of_texts(index.docs, vocabulary, index.stop)
    rows = index.postings.withColumnRenamed("tf", "weight")
    if vocabulary is not None:
        rows = rows.join(F.broadcast(rows.sparkSession.createDataFrame([(t,) for t in vocabulary], "token string")), "token", "left_semi")
    return blocks_of_postings(rows)


def _stats(index: LexicalIndex, blocks: DataFrame) -> dict:
    if index.docs is not None or "n_blocks" in index.stats.columns:
        return (corpus_counts(blocks) if index.docs is not None else index.stats).first().asDict()
    # blocks of postings know only the documents that have one
    return index.stats.first().asDict() | {"n_blocks": blocks.count()}


def lexical_vector(weights: DataFrame, special: list[str] | None = None) -> DataFrame:
    """``(id, token, w)`` to the largest positive weight per token, without special tokens."""
    rows = weights.filter(F.col("w") > 0)
    if special:
        rows = rows.filter(~F.col("token").isin(list(special)))
    return rows.groupBy("id", "token").agg(F.max("w").alias("w"))


def quantize(weights: DataFrame) -> DataFrame:
    """Integer impacts ``ceil(100 * w)``."""
    return weights.withColumn("w", F.ceil(F.col("w") * 100).cast("int"))


def as_map(weights: DataFrame) -> DataFrame:
    """One ``MAP<token, weight>`` per id. The map is as large as the text it describes."""
    return weights.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "w")))).alias("vector"))


def impact_topic(vector: Column) -> Column:
    """Query text that repeats each token as often as its integer weight; ``0`` if empty."""
    repeated = F.flatten(F.transform(F.map_entries(vector), lambda e: F.array_repeat(e["key"], e["value"])))
    return F.when(F.size(repeated) == 0, F.lit("0")).otherwise(F.array_join(repeated, " "))


def impact_index(d_weights: DataFrame) -> LexicalIndex:
    """An index of ``(docid, token, w)`` rows, brought together by document once."""
    blocks = cut_blocks(blocks_of_postings(d_weights.select("docid", "token", F.col("w").alias("weight"), F.lit(1).alias("dl"))), "impacts")
    return LexicalIndex.of_blocks(blocks)


def impact_search(q_weights: DataFrame, d_weights: DataFrame | LexicalIndex, k: int = 1000) -> DataFrame:
    """Sum over shared tokens of query weight times document weight.

    ``q_weights`` is ``(qid, token, w)``, ``d_weights`` is ``(docid, token, w)`` or an
    :func:`impact_index`, whose search moves no postings.
    """
    q = q_weights.select("qid", "token", F.col("w").cast("double").alias("w"))
    runs = []
    for part in bounded_parts(q):
        terms = part.toPandas()
        if isinstance(d_weights, LexicalIndex):
            index = d_weights
        else:
            names = d_weights.sparkSession.createDataFrame([(t,) for t in sorted(set(terms["token"]))], "token string")
            index = impact_index(d_weights.join(F.broadcast(names), "token", "left_semi"))
        runs.append(search_blocks(index.blocks, index.stats.first()["n_blocks"], terms, q.schema["qid"].dataType, lambda w, dl: w, k))
    return reduce(DataFrame.unionAll, runs)
