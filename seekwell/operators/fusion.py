"""Score fusion and reranking of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seekwell.functions.text import words
from seekwell.functions.vectors import colbert_score, sparse_dot, vec_dot
from seekwell.operators.ranking import top_k
from seekwell.scale import stack


def hybrid_search(dense: DataFrame, sparse: DataFrame, alpha: float, k: int) -> DataFrame:
    """``alpha * sparse + dense``; a document missing from one run takes that run's lowest
    score for the query.

    The runs are stacked, so one aggregate pairs the scores of a document and a second,
    small one finds the lowest score per run and query.
    """
    stacked = stack(dense.select("qid", "docid", F.col("score").alias("d"), F.lit(None).cast("double").alias("s")),
                    sparse.select("qid", "docid", F.lit(None).cast("double").alias("d"), F.col("score").alias("s")))
    floor = stacked.groupBy("qid").agg(F.min("d").alias("min_d"), F.min("s").alias("min_s"))
    pairs = stacked.groupBy("qid", "docid").agg(F.max("d").alias("d"), F.max("s").alias("s"))
    zero = F.lit(0.0)
    score = (F.lit(float(alpha)) * F.coalesce("s", "min_s", zero)) + F.coalesce("d", "min_d", zero)
    scored = pairs.join(floor, "qid").select("qid", "docid", F.round(score, 8).alias("score"))
    return top_k(scored, "qid", "score", k)


def fuse_runs(runs: dict[str, tuple[DataFrame, float, float]], k: int = 1000) -> DataFrame:
    """Weighted sum ``weight * score / scale`` over runs; a missing document counts zero."""
    parts = [df.select("qid", "docid", (F.col("score") / F.lit(float(scale)) * F.lit(float(weight))).alias("part"))
             for df, weight, scale in runs.values()]
    stacked = stack(*parts)
    scored = stacked.groupBy("qid", "docid").agg(F.round(F.sum("part"), 6).alias("score"))
    return top_k(scored, "qid", "score", k)


def multi_mode_score(pairs: DataFrame, weights=(1.0, 1.0, 1.0)) -> DataFrame:
    """Dense, sparse and late-interaction scores of pairs, and their weighted means.

    Columns ``q_dense, d_dense, q_sparse, d_sparse, q_multi, d_multi``; weights in the
    order dense, sparse, colbert.
    """
    wd, ws, wc = [float(w) for w in weights]
    scored = (pairs.withColumn("dense", vec_dot("q_dense", "d_dense"))
              .withColumn("sparse", sparse_dot("q_sparse", "d_sparse"))
              .withColumn("colbert", colbert_score("q_multi", "d_multi")))
    both = (F.col("sparse") * ws + F.col("dense") * wd) / F.lit(ws + wd)
    every = (F.col("colbert") * wc + F.col("sparse") * ws + F.col("dense") * wd) / F.lit(wd + ws + wc)
    return scored.withColumn("sparse_dense", both).withColumn("all_modes", every)


def rerank(run: DataFrame, scores: DataFrame, by: str, k: int | None = None) -> DataFrame:
    """Order the hits of a run by another score column."""
    joined = run.select("qid", "docid").join(scores.select("qid", "docid", F.col(by).alias("score")), ["qid", "docid"])
    return top_k(joined, "qid", "score", k)


def dense_rerank(queries: DataFrame, candidates: DataFrame, docs: DataFrame, k: int | None = None, digits: int = 3) -> DataFrame:
    """Score candidates by the dot product of query and document vectors."""
    rows = (candidates.select("qid", "docid")
            .join(docs.select("docid", F.col("embedding").alias("d")), "docid")
            .join(queries.select("qid", F.col("embedding").alias("q")), "qid"))
    scored = rows.select("qid", "docid", F.round(vec_dot("q", "d"), digits).alias("score"))
    return top_k(scored, "qid", "score", k)


def overlap_score(query: Column, passage: Column) -> Column:
    """Share of distinct query words found in the passage; a scorer that needs no model."""
    q, p = F.array_distinct(words(F.lower(query))), F.array_distinct(words(F.lower(passage)))
    return F.round(F.size(F.array_intersect(q, p)) / F.greatest(F.size(q), F.lit(1)), 6)


def pair_rerank(candidates: DataFrame, scorer=overlap_score, k: int | None = None) -> DataFrame:
    """Rerank ``(qid, query, docid, text)`` rows with a pair scorer; ``hits`` is the depth."""
    scored = candidates.withColumn("score", scorer(F.col("query"), F.col("text")))
    return top_k(scored, "qid", "score", k)
