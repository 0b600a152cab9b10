"""Plans and results that must hold whatever the depth, the key type and the layout."""

from pyspark.sql import Window as W, functions as F

from seekwell.functions import scoring as Q
from seekwell.operators import context as C, dense as D, evaluation as E, packing as P, ranking as R, training as H
from seekwell.plans import jobs as J
from seekwell.scale import running_totals, scratch_path, top_rows
from seekwell.streaming import service as St
from seekwell.operators import lexical as L


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_deep_top_rows_are_ranked_by_salts(spark):
    df = spark.range(20000).select((F.col("id") % 2).alias("qid"), F.col("id").alias("docid"), F.xxhash64("id").alias("s"))
    deep = top_rows(df, ["qid"], [F.col("s").desc(), F.col("docid")], 3000)
    assert "_salt" in plan(deep) and "WindowGroupLimit" in plan(top_rows(df, ["qid"], [F.col("s").desc()], 10))
    rows, want = df.collect(), set()
    for q in (0, 1):
        best = sorted((r for r in rows if r.qid == q), key=lambda r: (-r.s, r.docid))[:3000]
        want |= {(q, r.docid, i + 1) for i, r in enumerate(best)}
    assert {(r.qid, r.docid, r["rank"]) for r in deep.collect()} == want


def test_ranks_over_text_equal_values_and_no_depth(spark):
    df = spark.range(500).select((F.col("id") % 3).cast("string").alias("k"), F.col("id"))
    got = {r.id: r.n for r in running_totals(df, [], "k", {"n": F.lit(1)}, ["id"]).collect()}
    want = {r.id: i + 1 for i, r in enumerate(sorted(df.collect(), key=lambda r: (r.k, r.id)))}
    assert got == want
    run = spark.createDataFrame([("q", str(i), float(i % 7)) for i in range(300)], "qid string, docid string, score double")
    ranked = sorted((r["rank"], -r.score, r.docid) for r in R.top_k(run, "qid", "score", None).collect())
    assert [x[1:] for x in ranked] == sorted((-r.score, r.docid) for r in run.collect()) and ranked[-1][0] == 300


def test_text_ids_in_shards_and_packing(spark):
    df = spark.createDataFrame([(f"d{i:02d}", "a b c") for i in range(10)], "doc_id string, text string")
    assert [r.shard for r in R.shard(df, "doc_id", 3).orderBy("doc_id").collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 2]
    packed = P.pack_mixture(df.withColumn("source", F.lit("s")), {"s": 100.0}, 16, 8)
    assert packed.count() == 2


def test_task_keeps_a_running_top(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        c = spark.range(2000).repartition(2).select(F.col("id").alias("docid"), F.array(F.rand(1), F.rand(2)).alias("embedding"))
        q = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, embedding array<double>")
        assert D._scan(q, c, 10, "ip", False).count() == 20
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ideal_gains_beyond_a_thousand_labels(spark):
    qrels = spark.range(3000).select(F.lit(0).alias("qid"), F.col("id").alias("docid"), F.lit(1).alias("grade"))
    run = qrels.limit(2000).select("qid", "docid", F.row_number().over(W.partitionBy("qid").orderBy("docid")).alias("rank"))
    out = E.mean_metrics(E.query_metrics(E.judge(run, qrels), E.label_totals(qrels), [2000]))
    assert {r.metric: r.value for r in out.collect()}["ndcg@2000"] == 1.0


def test_nothing_is_lost(spark):
    history = spark.createDataFrame([(1, 0, "user", "alpha beta"), (1, 2, "user", "alpha"), (2, 0, "user", "zeta"), (3, 0, "user", "x y"), (3, 2, "user", "nothing shared")], "conv_id long, turn long, role string, text string")
    query, past = C.split_history(history)
    assert {r.conv_id: r.prompt for r in C.history_retrieve(past, query, "bm25").collect()} == {1: "alpha beta\nalpha", 2: "zeta", 3: "nothing shared"}
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(400)))], "doc_id long, text string")
    assert C.chunk_retrieve(docs, 32, 256, 2, "concat").count() == 1
    small = spark.createDataFrame([(None,), (None,), (None,), ("a",), ("a",), ("a",)], "source string")
    assert H.merge_small_sources(small, "source", 2, 0).count() == 6
    labels = spark.createDataFrame([(None, None), (None, None), ("a", "x"), ("a", "x")], "l string, k string")
    assert tuple(E.v_measure(labels, "l", "k").first()) == (1.0, 1.0, 1.0)
    q = spark.createDataFrame([(0, "x"), (1, "y")], "qid long, query string")
    run = spark.createDataFrame([(0, 0, 1.0, 1)], "qid long, docid long, score double, rank int")
    faq = spark.createDataFrame([(0, "fx", "已解答")], "docid long, question string, answer string")
    assert {r.qid: r.route for r in J.faq_match(q, run, run, faq, lambda: (lambda p: "已解答")).collect()} == {0: "answered", 1: "clauses"}
    clauses = spark.createDataFrame([(0, "text")], "docid long, text string")
    out = J.clause_search(q, lambda: (lambda p: p), lambda asked: run, clauses, lambda: (lambda p: "ok"))
    assert {r.qid: len(r.docids) for r in out.collect()} == {0: 1, 1: 0}


def test_bad_labels_do_not_abort(spark):
    df = spark.createDataFrame([("3.0", "3"), ("3", "3"), ("4", "x")], "p string, t string")
    assert [r.s for r in df.select(Q.score_math_find("p", "t").alias("s")).collect()] == [0.0, 1.0, 0.0]


def stream_of(spark, rows, schema, name):
    """Each list of rows is a file of its own, read one file in a micro-batch."""
    path = scratch_path(spark, name)
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_document_that_arrives_again_replaces_itself(spark):
    parts = [[(1, "alpha beta"), (2, "alpha")], [(1, "gamma"), (3, "beta beta")]]
    out, check = scratch_path(spark, "deltas"), scratch_path(spark, "state")
    St.index_stream(stream_of(spark, parts, "docid long, text string", "doc-files"), out, check).awaitTermination()
    index = St.load_streamed_index(spark, out)
    whole = L.build_index(spark.createDataFrame([(1, "gamma"), (2, "alpha"), (3, "beta beta")], "docid long, text string"))
    topics = spark.createDataFrame([(0, "alpha beta gamma")], "qid long, query string")
    key = lambda run: sorted((r.docid, r.score, r["rank"]) for r in run.collect())
    assert key(L.bm25_search(index, topics, 10, length_norm=True)) == key(L.bm25_search(whole, topics, 10, length_norm=True))
