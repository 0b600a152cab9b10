"""Hand-computed retrieval results and the paths taken only for large inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seekwell.functions import vectors as V
from seekwell.operators import dense as D, fusion as X, lexical as L, ranking as R
from seekwell import scale


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture()
def corpus(spark):
    return spark.createDataFrame([(0, "a b b"), (1, "a c"), (2, "d")], "docid long, text string")


def test_bm25_by_hand(spark, corpus):
    q = spark.createDataFrame([(0, "a b"), (1, "d a a")], "qid long, query string")
    got = {(r.qid, r.docid): r.score for r in L.bm25_search(L.build_index(corpus), q, 10).collect()}
    idf = lambda df: math.log((3 - df + 0.5) / (df + 0.5) + 1)
    sat = lambda tf, dl: 1.9 * tf / (tf + 0.9 * (0.6 + 0.4 * dl))
    want = {
        (0, 0): idf(2) * sat(1, 3) + idf(1) * sat(2, 3), (0, 1): idf(2) * sat(1, 2),
        (1, 0): 2 * idf(2) * sat(1, 3), (1, 1): 2 * idf(2) * sat(1, 2), (1, 2): idf(1) * sat(1, 1),
    }
    assert set(got) == set(want)
    assert all(abs(got[k] - round(want[k], 6)) < 1e-9 for k in want)


def test_queries_do_not_share_scores(spark, corpus):
    index = L.build_index(corpus)
    both = spark.createDataFrame([(0, "a b"), (1, "d")], "qid long, query string")
    alone = both.filter("qid = 1")
    assert rows(L.bm25_search(index, both, 5).filter("qid = 1"), "docid", "score") == rows(L.bm25_search(index, alone, 5), "docid", "score")


def test_average_length(spark, corpus):
    q = spark.createDataFrame([(0, "c")], "qid long, query string")
    got = L.bm25_search(L.build_index(corpus), q, 5, k1=0.82, b=0.68, length_norm=True).first()
    want = math.log((3 - 1 + 0.5) / 1.5 + 1) * 1.82 / (1 + 0.82 * (0.32 + 0.68 * 2 / 2))
    assert got.docid == 1 and abs(got.score - round(want, 6)) < 1e-9


def test_query_parts_equal_one_part(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(F.col("doc_id").alias("docid"), "text")
    q = spark.read.parquet(f"{folder}/benchmark.parquet").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    want = rows(L.bm25_search(L.build_index(docs), q, 10), "qid", "docid", "score", "rank")
    monkeypatch.setattr(L, "BROADCAST_TERM_ROWS", 400)
    assert rows(L.bm25_search(L.build_index(docs), q, 10), "qid", "docid", "score", "rank") == want


def test_one_token_in_every_document(spark, monkeypatch):
    """A token that holds most postings loses no hit, whatever the parts of the queries."""
    docs = spark.range(3000).select(F.col("id").alias("docid"), F.concat(F.lit("hot t"), F.col("id")).alias("text"))
    q = spark.createDataFrame([(0, "hot t7"), (1, "hot")], "qid long, query string")
    want = rows(L.bm25_search(L.build_index(docs), q, 3000), "qid", "docid", "score")
    assert len(want) == 6000
    monkeypatch.setattr(L, "BROADCAST_TERM_ROWS", 1)
    assert rows(L.bm25_search(L.build_index(docs), q, 3000), "qid", "docid", "score") == want


def test_partition_count_does_not_change_the_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(F.col("doc_id").alias("docid"), "text")
    q = spark.read.parquet(f"{folder}/benchmark.parquet").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    want = rows(L.bm25_search(L.build_index(docs), q, 5), "qid", "docid", "score", "rank")
    for n in ("1", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            assert rows(L.bm25_search(L.build_index(docs), q, 5), "qid", "docid", "score", "rank") == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_fits_broadcast_counts_bytes(spark, monkeypatch):
    df = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("token"))
    assert scale.fits_broadcast(df)
    assert not scale.fits_broadcast(df, max_rows=5)
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 5000)
    assert not scale.fits_broadcast(df)


def test_dense_against_numpy(spark):
    rng = np.random.default_rng(0)
    m = np.round(rng.normal(size=(60, 8)), 3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "docid long, embedding array<double>")
    q = df.withColumnRenamed("docid", "qid")
    for metric, score in (("ip", lambda a, b: a @ b), ("cos", lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)), ("l2", lambda a, b: -np.linalg.norm(a - b))):
        got = {(r.qid, r["rank"]): r.docid for r in D.dense_search(q, df, 5, metric, skip_self=True).collect()}
        for i in range(60):
            order = sorted((j for j in range(60) if j != i), key=lambda j: (-round(float(score(m[i], m[j])), 6), j))[:5]
            assert [got[i, n + 1] for n in range(5)] == order


def test_dense_ties_go_to_the_smaller_id(spark):
    c = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(500)], "docid long, embedding array<double>").repartition(7)
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, embedding array<double>")
    assert rows(D.dense_search(q, c, 4), "rank", "docid") == [(1, 0), (2, 1), (3, 2), (4, 3)]


def test_blocked_pairs_equal_scan(spark, monkeypatch):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(90, 4)))], "docid long, embedding array<double>")
    q = df.withColumnRenamed("docid", "qid")
    want = rows(D.dense_search(q, df, 3), "qid", "docid", "score")
    monkeypatch.setattr(D, "BROADCAST_BYTES", 1000)
    monkeypatch.setattr(D, "BLOCK_ROWS", 20)
    assert rows(D.dense_search(q, df, 3), "qid", "docid", "score") == want


def test_approximate_with_all_lists_is_exact(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(80, 4)))], "docid long, embedding array<double>")
    q = df.withColumnRenamed("docid", "qid")
    monkeypatch.setattr(D, "BLOCK_ROWS", 25)
    assert rows(D.dense_search_approx(q, df, 3, n_lists=4, n_probe=4), "qid", "docid") == rows(D.dense_search(q, df, 3), "qid", "docid")


def runs(spark):
    a = spark.createDataFrame([(0, 1, 10.0), (0, 2, 6.0)], "qid long, docid long, score double")
    b = spark.createDataFrame([(0, 2, 0.5), (0, 3, 0.2)], "qid long, docid long, score double")
    return a, b


def test_hybrid_fills_with_the_minimum(spark):
    sparse, dense = runs(spark)
    got = {r.docid: r.score for r in X.hybrid_search(dense, sparse, 0.1, 5).collect()}
    assert got == {1: 1.2, 2: 1.1, 3: 0.8}


def test_fusion_fills_with_zero(spark):
    a, b = runs(spark)
    got = {r.docid: r.score for r in X.fuse_runs({"a": (a, 0.5, 10), "b": (b, 2.0, 1)}).collect()}
    assert got == {1: 0.5, 2: 1.3, 3: 0.4}
    single = X.fuse_runs({"a": (a, 1.0, 1), "b": (b, 0.0, 1)}, 2)
    assert rows(single, "docid", "score") == [(1, 10.0), (2, 6.0)]


def test_fusion_of_runs_with_merged_partitions(spark):
    """Inputs that are already placed by query must still meet in one group."""
    left = spark.range(400).select((F.col("id") % 40).alias("qid"), F.col("id").alias("docid"), F.lit(1.0).alias("score"))
    right = spark.range(4000).select((F.col("id") % 40).alias("qid"), (F.col("id") % 400).alias("docid"), (F.col("id") / 4000).alias("score"))
    a, b = R.top_k(left, "qid", "score", 50), R.top_k(right.filter("qid = docid % 40"), "qid", "score", 500)
    out = X.fuse_runs({"a": (a, 1.0, 1), "b": (b, 1.0, 1)}, 10000)
    assert out.count() == out.select("qid", "docid").distinct().count()


def test_late_interaction_by_hand(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]], [[0.5, 0.5], [1.0, 0.0], [0.0, 0.2]])], "q array<array<double>>, p array<array<double>>")
    assert df.select(V.colbert_score("q", "p").alias("s")).first().s == pytest.approx((1.0 + 0.5) / 2)


def test_impact_topic(spark):
    df = spark.sql("select map('a', 2, 'b', 1) as v union all select cast(map() as map<string,int>)")
    assert [r[0] for r in df.select(L.impact_topic(F.col("v"))).collect()] == ["a a b", "0"]


def test_shards(spark):
    got = rows(R.shard(spark.range(10).withColumnRenamed("id", "k"), "k", 3), "k", "shard")
    assert [s for _, s in got] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 2]


def test_running_totals_with_one_large_group(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).cast("int").alias("g"), F.col("id"))
    out = scale.running_totals(df, ["g"], "id", {"n": F.lit(1), "s": F.col("id")}, buckets=16)
    got = {r.id: (r.n, r.s) for r in out.collect()}
    seen = {0: (0, 0), 1: (0, 0)}
    for i in range(5000):
        g = int(i % 3 == 0)
        seen[g] = (seen[g][0] + 1, seen[g][1] + i)
        assert got[i] == seen[g]


def test_hash_rank_is_a_permutation(spark):
    df = spark.range(3000).withColumn("_h", scale.seeded(1, "id"))
    got = sorted((r._h, r.r) for r in scale.hash_rank(df, [], "_h", ["id"], "r").collect())
    assert [r for _, r in got] == list(range(1, 3001))


def test_random_search_is_distinct_and_complete(spark):
    q = spark.range(5).withColumnRenamed("id", "qid")
    c = spark.range(7).withColumnRenamed("id", "docid")
    out = R.random_search(q, c, 20)
    assert out.count() == 35 and out.distinct().count() == 35 == out.select("qid", "docid").distinct().count()


def test_zero_vector_has_no_direction(spark):
    df = spark.sql("select array(0.0D, 0.0D) as a, array(1.0D, 0.0D) as b")
    r = df.select(V.vec_cos("a", "b").alias("c"), V.l2_normalize("a").alias("n"), V.min_max("a").alias("m")).first()
    assert r.c is None and r.n == [0.0, 0.0] and r.m == [0.0, 0.0]


def test_dense_with_text_ids(spark, monkeypatch):
    c = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "docid string, embedding array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.1]), ("a", [0.0, 1.0])], "qid string, embedding array<double>")
    want = [("a", 1, "c"), ("a", 2, "b"), ("q", 1, "a"), ("q", 2, "b")]
    assert rows(D.dense_search(q, c, 2, skip_self=True), "qid", "rank", "docid") == want
    monkeypatch.setattr(D, "BROADCAST_BYTES", 10)
    assert rows(D.dense_search(q, c, 2, skip_self=True), "qid", "rank", "docid") == want


def test_scratch_folder_follows_the_session(spark, tmp_path):
    class Session:
        def __init__(self, folder, master):
            self.conf = {"spark.checkpoint.dir": folder}
            self.sparkContext = type("Context", (), {"master": master, "getCheckpointDir": lambda self: None})()

    assert scale.scratch_path(Session(str(tmp_path), "yarn"), "x").startswith(f"{tmp_path}/x-")
    with pytest.raises(ValueError):
        scale.scratch_path(Session(None, "yarn"), "x")
    assert scale.cut(spark.range(3)).count() == 3
