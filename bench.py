"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (table folder), BENCH_CPUS (local cores).
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "bm25_search", "bm25_search_average_length", "dense_search", "hybrid_search", "fuse_two_runs", "impact_search",
    "dense_mrr", "dense_recall", "dense_ndcg", "dense_map", "rerank_map_mrr", "answer_recall", "hard_negatives",
    "length_buckets", "packed_sequences", "sliding_windows", "token_f1", "simple_token_counts",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from seekwell.checks import load

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries = load().QUERIES
    # one small query so that JVM start and code loading are not part of the first timing
    queries["bm25_search"](spark, folder.replace(os.path.basename(folder), "sf0.001") if os.path.isdir(
        os.path.join(os.path.dirname(folder), "sf0.001")) else folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    # search alone, on an index that was saved before
    from pyspark.sql import functions as F

    from seekwell.operators.lexical import LexicalIndex, bm25_search, build_index
    from seekwell.scale import scratch_path

    path = scratch_path(spark, "bench-index")
    read = lambda table: spark.read.parquet(f"{folder}/{table}.parquet")
    build_index(read("documents").select(F.col("doc_id").alias("docid"), "text")).save(path)
    topics = read("benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    start = time.perf_counter()
    bm25_search(LexicalIndex.load(spark, path), topics, 10).write.format("noop").mode("overwrite").save()
    times["bm25_saved_index"] = round(time.perf_counter() - start, 3)
    n_queries = spark.read.parquet(f"{folder}/benchmark.parquet").count()
    print(json.dumps({
        "metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sec_per_search_query": {k: round(times[k] / n_queries, 5) for k in ("bm25_search", "bm25_search_average_length", "bm25_saved_index", "impact_search")},
        "sf": os.path.basename(folder).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
