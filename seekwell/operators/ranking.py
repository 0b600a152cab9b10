"""Runs: ranking, slicing, sharding, joining payloads and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seekwell.scale import hash_rank, running_total, running_totals, seeded, seeded_place, stack, top_rows


def top_k(df: DataFrame, by: str, score: str, k: int | None, tie: str = "docid", ascending: bool = False) -> DataFrame:
    """``k`` best rows per ``by`` with a 1-based ``rank``; equal scores go by ``tie``. Without
    ``k`` all rows are ranked, a large group by many tasks."""
    if k is None:
        keyed = df.withColumn("_key", F.col(score) if ascending else -F.col(score))
        ranked = running_totals(keyed, [by], "_key", {"rank": F.lit(1)}, [tie]).drop("_key")
        return ranked.withColumn("rank", F.col("rank").cast("int"))
    best = F.col(score).asc() if ascending else F.col(score).desc()
    return top_rows(df, [by], [best, F.col(tie)], k)


def rank_rows(df: DataFrame, by: str, score: str, tie: str = "docid") -> DataFrame:
    """1-based rank over a run. Runs hold at most the search depth per query."""
    w = W.partitionBy(by).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w))


def rank_window(run: DataFrame, low: int, high: int) -> DataFrame:
    """Hits whose zero-based position lies in ``[low, high)``."""
    return run.filter((F.col("rank") > low) & (F.col("rank") <= high))


def first_per_group(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    return top_rows(df, [by], [F.col(order)], n)


def sort_by_score(items: Column, scores: Column) -> Column:
    """Items ordered by score descending; equal scores keep their place."""
    n = F.size(items)
    pos = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    rows = F.transform(pos, lambda i: F.struct((-F.get(scores, i)).alias("s"), i.alias("i"), F.get(items, i).alias("x")))
    return F.transform(F.array_sort(rows), lambda r: r["x"])


def budget_cut(df: DataFrame, by: str, order: str, length: str, budget: int) -> DataFrame:
    """Leading rows per group while the running length stays within ``budget``."""
    return running_total(df, [by], order, F.col(length), "used").filter(F.col("used") <= budget)


def with_docs(run: DataFrame, corpus: DataFrame, digits: int = 3) -> DataFrame:
    """Attach the document text to hits and round the score for display."""
    return run.join(corpus.select("docid", "text"), "docid").withColumn("score", F.round("score", digits))


def drop_padding(hits: DataFrame) -> DataFrame:
    """Padded hit arrays ``(qid, pred, score)`` to rows, without the -1 entries."""
    return (
        hits.select("qid", F.posexplode(F.arrays_zip("pred", "score")).alias("pos", "hit"))
        .select("qid", F.col("hit.pred").alias("docid"), (F.col("pos") + 1).alias("rank"), F.col("hit.score").alias("score"))
        .filter(F.col("docid") >= 0)
    )


def shard(df: DataFrame, key: str, n: int) -> DataFrame:
    """Equal shards over the sorted key: ``floor(total / n)`` rows each, the last one takes
    the rest. Row positions come from a two-pass running count."""
    total = df.agg(F.count(F.lit(1)).alias("c"))
    numbered = running_total(df, [], key, F.lit(1), "_pos")
    size = F.greatest(F.floor(total.scalar() / F.lit(n)), F.lit(1))
    return numbered.withColumn("shard", F.least(F.floor((F.col("_pos") - 1) / size), F.lit(n - 1)).cast("int")).drop("_pos")


def random_search(queries: DataFrame, corpus: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """``k`` distinct seeded random documents per query.

    The corpus gets one seeded order; each query starts at its own seeded place in that
    order and takes the next ``k`` documents, wrapping around. That is an equi-join of
    ``k`` positions per query, never a query by corpus product.
    """
    order = hash_rank(corpus.select("docid").withColumn("_h", seeded(seed, "docid")), [], "_h", ["docid"], "_pos")
    n = corpus.agg(F.count(F.lit(1)).alias("n")).scalar()
    wanted = (
        queries.select("qid", seeded_place(seed, "qid").alias("_start"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
        .withColumn("_n", n)
        .filter(F.col("rank") <= F.col("_n"))
        .withColumn("_pos", (F.col("_start") + F.col("rank")) % F.col("_n") + 1)
    )
    return wanted.join(order, "_pos").select("qid", "docid", "rank")


def concat_sets(*frames: DataFrame) -> DataFrame:
    return stack(*frames)


def candidate_pool(triples: DataFrame, pool: DataFrame | None = None) -> DataFrame:
    """Distinct texts: the given pool, or all positives and negatives."""
    if pool is not None:
        return pool.select("text").distinct()
    return triples.select(F.explode(F.concat(F.col("pos"), F.coalesce(F.col("neg"), F.array().cast("array<string>")))).alias("text")).distinct()


def labelled_hits(run: DataFrame, qrels: DataFrame) -> DataFrame:
    return run.join(qrels.select("qid", "docid").distinct(), ["qid", "docid"], "left_semi")


def unlabelled_hits(run: DataFrame, qrels: DataFrame, self_match: bool = True) -> DataFrame:
    """Hits that are not positives, and not the query itself when ids share a space."""
    out = run.join(qrels.select("qid", "docid").distinct(), ["qid", "docid"], "left_anti")
    return out.filter(F.col("qid") != F.col("docid")) if self_match else out


def key_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """All (qid, docid) pairs of two runs with both scores."""
    left = a.select("qid", "docid", F.col("score").alias("score_a"))
    right = b.select("qid", "docid", F.col("score").alias("score_b"))
    return left.join(right, ["qid", "docid"], "full_outer")
