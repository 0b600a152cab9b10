"""Lexical, dense and hybrid retrieval over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from seekwell.checks import sql as S
from seekwell.checks.registry import Tables, register
from seekwell.functions import vectors as V
from seekwell.functions.text import simple_tokens, space_tokens
from seekwell.operators import dense as D, fusion as X, lexical as L, ranking as R
from seekwell.operators.vector_lists import VectorLists
from seekwell.scale import cut, scratch_path, stack

APP_BM25 = dict(k1=0.82, b=0.68, length_norm=True)


def bm25_run(t: Tables, k=10, **kw):
    return L.bm25_search(L.build_index(t.corpus), t.topics, k, **kw)


def dense_run(t: Tables, k=10):
    return D.dense_search(t.vec_queries, t.vec_corpus, k, skip_self=True)


@register("retrieve_with_text", f"WITH {S.bm25('run', 3, 0.82, 0.68, True)} "
          "SELECT r.qid, r.docid, r.rank, round(r.score, 3) AS score, d.text FROM run r JOIN documents d ON d.doc_id = r.docid")
def _(t):
    return R.with_docs(bm25_run(t, 3, **APP_BM25), t.corpus)


@register("index_postings", "WITH d AS (SELECT doc_id AS docid, len(string_split(text, ' ')) AS dl, unnest(string_split(text, ' ')) AS token FROM documents) "
          "SELECT docid, token, count(*) AS tf, max(dl) AS dl FROM d GROUP BY docid, token")
def _(t):
    return L.build_index(t.corpus).postings


@register("index_term_stats", "WITH d AS (SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS token FROM documents) "
          "SELECT token, count(*) AS df FROM d WHERE token NOT IN ('the', 'of', 'de', 'la') GROUP BY token")
def _(t):
    return L.term_stats(L.build_index(t.corpus, stop=["the", "of", "de", "la"]).postings)


@register("index_corpus_stats", "SELECT count(*) AS n_docs, sum(len(string_split(text, ' ')))::BIGINT AS n_tokens FROM documents")
def _(t):
    return L.build_index(t.corpus).stats


@register("bm25_search", f"WITH {S.bm25('run', 10)} SELECT * FROM run")
def _(t):
    return bm25_run(t)


@register("bm25_search_average_length", f"WITH {S.bm25('run', 10, 0.82, 0.68, True)} SELECT * FROM run")
def _(t):
    return bm25_run(t, **APP_BM25)


@register("bm25_search_simple_tokenizer", f"WITH {S.bm25('run', 10, 0.9, 0.4, True, S.SIMPLE)} SELECT * FROM run")
def _(t):
    return L.bm25_search(L.build_index(t.corpus, "simple"), t.topics, 10, length_norm=True, tokenizer="simple")


LEXICAL_SQL = """
dt AS (SELECT doc_id AS id, unnest(string_split(text, ' ')) AS token FROM documents),
dw AS (SELECT id AS docid, token, ceil(100 * (1 + ln(count(*))))::INT AS w FROM dt WHERE token <> '' GROUP BY id, token),
qt AS (SELECT item_id AS id, unnest(string_split(text, ' ')) AS token FROM benchmark),
qw AS (SELECT id AS qid, token, ceil(100 * (1 + ln(count(*))))::INT AS w FROM qt WHERE token <> '' GROUP BY id, token)"""


def lexical_weights(df, id_col):
    """Weights ``1 + ln(tf)`` of white-space tokens, quantised."""
    from seekwell.functions.text import token_counts

    raw = df.select(F.col(id_col).alias("id"), F.inline(token_counts(space_tokens("text")))).select(
        "id", "token", (F.log(F.col("n")) + 1).alias("w"))
    return L.quantize(L.lexical_vector(raw, special=[""]))


def impact_parts(t):
    return (lexical_weights(t.benchmark, "item_id").withColumnRenamed("id", "qid"),
            lexical_weights(t.documents, "doc_id").withColumnRenamed("id", "docid"))


@register("lexical_vectors", f"WITH {LEXICAL_SQL} SELECT docid, token, w FROM dw")
def _(t):
    return impact_parts(t)[1]


@register("impact_search", f"WITH {LEXICAL_SQL}, s AS (SELECT qid, docid, round(sum(qw.w::DOUBLE * dw.w::DOUBLE), 6) AS score FROM qw JOIN dw USING (token) GROUP BY qid, docid) "
          + S.ranked("s", 100))
def _(t):
    q, d = impact_parts(t)
    return L.impact_search(q, d, 100)


@register("impact_search_deep", f"WITH {LEXICAL_SQL}, s AS (SELECT qid, docid, round(sum(qw.w::DOUBLE * dw.w::DOUBLE), 6) AS score FROM qw JOIN dw USING (token) GROUP BY qid, docid) "
          + S.ranked("s", 5000))
def _(t):
    q, d = impact_parts(t)
    return L.impact_search(q, d, 5000)


@register("impact_topics", f"WITH {LEXICAL_SQL}, r AS (SELECT qid, string_agg(trim(repeat(token || ' ', w::INT)), ' ' ORDER BY token) AS topic FROM qw GROUP BY qid) "
          "SELECT item_id AS qid, coalesce(topic, '0') AS topic FROM benchmark LEFT JOIN r ON r.qid = item_id")
def _(t):
    vectors = L.as_map(lexical_weights(t.benchmark, "item_id"))
    joined = t.benchmark.join(vectors, F.col("item_id") == F.col("id"), "left")
    empty = F.create_map().cast("map<string,int>")
    return joined.select(F.col("item_id").alias("qid"), L.impact_topic(F.coalesce("vector", empty)).alias("topic"))


@register("vector_similarities", f"WITH {S.dense('near', 1)} SELECT n.qid, n.docid, round(list_dot_product(a.e, b.e), 6) AS ip, "
          "round(list_distance(a.e, b.e), 6) AS l2, round(list_cosine_similarity(a.e, b.e), 6) AS cos "
          "FROM near n JOIN near_v a ON a.vec_id = n.qid JOIN near_v b ON b.vec_id = n.docid")
def _(t):
    run = dense_run(t, 1).select("qid", "docid")
    rows = (run.join(t.embeddings.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("a")), "qid")
            .join(t.embeddings.select(F.col("vec_id").alias("docid"), F.col("embedding").alias("b")), "docid"))
    return rows.select("qid", "docid", F.round(V.vec_dot("a", "b"), 6).alias("ip"), F.round(V.vec_l2("a", "b"), 6).alias("l2"),
                       F.round(V.vec_cos("a", "b"), 6).alias("cos"))


@register("vector_scaling", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
 u AS (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS i, sqrt(list_dot_product(e, e)) AS n, list_min(e) AS lo, list_max(e) AS hi FROM v)
 SELECT vec_id, i - 1 AS pos, round(x / n, 6) AS unit, round((x - lo) / (hi - lo), 6) AS scaled FROM u""")
def _(t):
    rows = t.embeddings.select("vec_id", F.posexplode(F.arrays_zip(V.l2_normalize("embedding").alias("u"), V.min_max("embedding").alias("s"))))
    return rows.select("vec_id", "pos", F.round("col.u", 6).alias("unit"), F.round("col.s", 6).alias("scaled"))


@register("dense_search", f"WITH {S.dense('dense', 10)} SELECT * FROM dense")
def _(t):
    return dense_run(t)


@register("dense_search_l2", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
 s AS (SELECT a.vec_id AS qid, b.vec_id AS docid, round(sqrt(greatest(list_dot_product(a.e, a.e) + list_dot_product(b.e, b.e) - 2 * list_dot_product(a.e, b.e), 0)), 6) AS score
   FROM v a CROSS JOIN v b WHERE a.vec_id <> b.vec_id)
 SELECT qid, docid, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, docid) AS rank FROM s) WHERE rank <= 10""")
def _(t):
    return D.dense_search(t.vec_queries, t.vec_corpus, 10, "l2", skip_self=True)


@register("dense_search_cosine", f"WITH {S.dense('d', 10).replace('list_dot_product', 'list_cosine_similarity')} SELECT * FROM d")
def _(t):
    return D.dense_search(t.vec_queries, t.vec_corpus, 10, "cos", skip_self=True)


@register("dense_search_blocked", f"WITH {S.dense('dense', 10)} SELECT * FROM dense")
def _(t):
    q, c = t.vec_queries, t.vec_corpus
    return R.top_k(D._grid(q, c, max(3 * D.QUERY_BYTES, D._held(q, 10)), 10, "ip", True), "qid", "score", 10)


@register("dense_search_approximate")
def _(t):
    return D.dense_search_approx(t.vec_queries, t.vec_corpus, 10, n_lists=16, n_probe=4, skip_self=True)


@register("dense_approximate_recall")
def _(t):
    approx = D.dense_search_approx(t.vec_queries, t.vec_corpus, 10, n_lists=16, n_probe=4, skip_self=True)
    return D.recall_against(approx, dense_run(t))


def vector_lists(t, corpus=None):
    return VectorLists.build(corpus if corpus is not None else t.vec_corpus, scratch_path(t.spark, "vector-lists"))


@register("vector_lists_all_probed", f"WITH {S.dense('dense', 10)} SELECT * FROM dense")
def _(t):
    saved = VectorLists.load(t.spark, vector_lists(t).path)
    return saved.search(t.vec_queries, 10, n_probe=len(saved.centroids), skip_self=True)


@register("vector_lists_after_additions", f"WITH {S.dense('dense', 10)} SELECT * FROM dense")
def _(t):
    """Two thirds of the vectors with wrong values first; a delta replaces them and brings the rest."""
    wrong = t.vec_corpus.filter("docid % 3 <> 0").withColumn("embedding", F.reverse("embedding"))
    lists = vector_lists(t, wrong)
    lists.add(t.vec_corpus)
    return VectorLists.load(t.spark, lists.path).search(t.vec_queries, 10, n_probe=len(lists.centroids), skip_self=True)


@register("vector_lists_recall", f"WITH {S.dense('dense', 10)} SELECT count(*) AS n_exact, true AS recall_at_least_90 FROM dense")
def _(t):
    run = vector_lists(t).search(t.vec_queries, 10, skip_self=True)
    return D.recall_against(run, dense_run(t)).select("n_exact", (F.col("recall") >= 0.9).alias("recall_at_least_90"))


@register("mixed_vector_search", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_reverse(embedding)::DOUBLE[] AS r FROM embeddings),
 s AS (SELECT a.vec_id AS qid, b.vec_id AS docid, round(0.7e0 * list_dot_product(a.e, b.e) + 0.3e0 * list_dot_product(a.r, b.e), 6) AS score FROM v a CROSS JOIN v b WHERE a.vec_id <> b.vec_id) """
          + S.ranked("s", 10))
def _(t):
    other = t.vec_queries.select("qid", F.reverse("embedding").alias("embedding"))
    return D.mix_search(t.vec_queries, other, t.vec_corpus, 0.7, 10, skip_self=True)


@register("random_search", """WITH o AS (SELECT doc_id AS docid, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS pos, count(*) OVER () AS n FROM documents),
 q AS (SELECT item_id AS qid, ('0x' || substr(md5('42|' || item_id), 1, 15))::BIGINT AS start, unnest(range(1, 11)) AS rank FROM benchmark)
 SELECT qid, docid, rank FROM q JOIN o ON o.pos = (q.start + q.rank) % o.n + 1""")
def _(t):
    return R.random_search(t.topics, t.corpus, 10)


NEIGHBOUR_SQL = S.dense("dense", 20) + """,
rev_s AS (SELECT a.vec_id AS qid, b.vec_id AS docid, round(list_dot_product(list_reverse(a.e), b.e), 6) AS score FROM dense_v a CROSS JOIN dense_v b WHERE a.vec_id <> b.vec_id),
other AS (""" + S.ranked("rev_s", 20) + ")"


def two_runs(t):
    """Two runs over the same vectors: as stored, and with the query vector reversed."""
    other = D.dense_search(t.vec_queries.select("qid", F.reverse("embedding").alias("embedding")), t.vec_corpus, 20, skip_self=True)
    return dense_run(t, 20), other


def saved_runs(t):
    """The two runs, searched and written once for queries that read a run more than once."""
    return tuple(cut(run, "runs") for run in two_runs(t))


@register("hybrid_search", f"""WITH {NEIGHBOUR_SQL},
 p AS (SELECT coalesce(d.qid, s.qid) AS qid, coalesce(d.docid, s.docid) AS docid, d.score AS d, s.score AS s FROM dense d FULL JOIN other s ON d.qid = s.qid AND d.docid = s.docid),
 f AS (SELECT qid, docid, round(0.3e0 * coalesce(s, min(s) OVER (PARTITION BY qid), 0) + coalesce(d, min(d) OVER (PARTITION BY qid), 0), 8) AS score FROM p) """
          + S.ranked("f", 10))
def _(t):
    d, s = two_runs(t)
    return X.hybrid_search(d, s, 0.3, 10)


@register("fuse_two_runs", f"""WITH {NEIGHBOUR_SQL},
 u AS (SELECT qid, docid, 0.5e0 * score / 10000 AS part FROM other UNION ALL SELECT qid, docid, 0.2e0 * score FROM dense),
 f AS (SELECT qid, docid, round(sum(part), 6) AS score FROM u GROUP BY qid, docid) """ + S.ranked("f", 1000))
def _(t):
    d, s = two_runs(t)
    return X.fuse_runs({"sparse": (s, 0.5, 10000), "dense": (d, 0.2, 1)})


@register("fuse_deep", f"""WITH {NEIGHBOUR_SQL},
 u AS (SELECT qid, docid, 0.5e0 * score / 10000 AS part FROM other UNION ALL SELECT qid, docid, 0.2e0 * score FROM dense),
 f AS (SELECT qid, docid, round(sum(part), 6) AS score FROM u GROUP BY qid, docid) """ + S.ranked("f", 5000))
def _(t):
    d, s = two_runs(t)
    return X.fuse_runs({"sparse": (s, 0.5, 10000), "dense": (d, 0.2, 1)}, 5000)


THREE_SQL = NEIGHBOUR_SQL + """,
mv AS (SELECT vec_id, [e[1:16], e[17:32], e[33:48], e[49:64]] AS m FROM dense_v),
c AS (SELECT qid, docid FROM dense UNION SELECT qid, docid FROM other),
ct AS (SELECT c.qid, c.docid, unnest(a.m) AS x, b.m AS bm FROM c JOIN mv a ON a.vec_id = c.qid JOIN mv b ON b.vec_id = c.docid),
multi AS (SELECT qid, docid, round(avg(list_max(list_transform(bm, lambda y: list_dot_product(x, y)))), 6) AS score FROM ct GROUP BY qid, docid)"""


def slices(col):
    """Four 16-dimensional slices of a vector as its token vectors."""
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice(col, i * 16 + 1, F.lit(16)))


def multi_scores(t, runs=None):
    d, s = runs or two_runs(t)
    pairs = stack(d, s).select("qid", "docid").distinct()
    a = t.embeddings.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("a"))
    b = t.embeddings.select(F.col("vec_id").alias("docid"), F.col("embedding").alias("b"))
    rows = pairs.join(a, "qid").join(b, "docid")
    return rows.select("qid", "docid", F.round(V.colbert_score(slices(F.col("a")), slices(F.col("b"))), 6).alias("score"))


@register("late_interaction_scores", f"WITH {THREE_SQL} SELECT * FROM multi")
def _(t):
    return multi_scores(t)


@register("fuse_three_runs", f"""WITH {THREE_SQL},
 u AS (SELECT qid, docid, 0.3e0 * score / 0.3e0 AS part FROM other UNION ALL SELECT qid, docid, 0.2e0 * score FROM dense UNION ALL SELECT qid, docid, 0.4e0 * score FROM multi),
 f AS (SELECT qid, docid, round(sum(part), 6) AS score FROM u GROUP BY qid, docid) """ + S.ranked("f", 1000))
def _(t):
    d, s = saved_runs(t)
    return X.fuse_runs({"sparse": (s, 0.3, 0.3), "dense": (d, 0.2, 1), "multi": (multi_scores(t, (d, s)), 0.4, 1)})


@register("multi_mode_scores", f"""WITH {THREE_SQL},
 r AS (SELECT qid, docid, score AS colbert FROM multi),
 m AS (SELECT r.qid, r.docid, r.colbert, list_dot_product(a.e, b.e) AS dense,
   CASE WHEN ea.label = eb.label THEN abs(a.e[1]) * abs(b.e[1]) ELSE 0 END AS sparse
   FROM r JOIN dense_v a ON a.vec_id = r.qid JOIN dense_v b ON b.vec_id = r.docid JOIN embeddings ea ON ea.vec_id = r.qid JOIN embeddings eb ON eb.vec_id = r.docid)
 SELECT qid, docid, round(dense, 6) AS dense, round(sparse, 6) AS sparse, colbert,
   round((sparse * 0.3e0 + dense) / 1.3e0, 6) AS sparse_dense, round((colbert + sparse * 0.3e0 + dense) / 2.3e0, 5) AS all_modes FROM m""")
def _(t):
    d, s = two_runs(t)
    pairs = stack(d, s).select("qid", "docid").distinct()
    side = lambda p, key: t.embeddings.select(
        F.col("vec_id").alias(key), F.col("embedding").alias(f"{p}_dense"), slices(F.col("embedding")).alias(f"{p}_multi"),
        F.create_map(F.col("label").cast("string"), F.abs(F.col("embedding")[0])).alias(f"{p}_sparse"))
    scored = X.multi_mode_score(pairs.join(side("q", "qid"), "qid").join(side("d", "docid"), "docid"), (1.0, 0.3, 1.0))
    return scored.select("qid", "docid", F.round("dense", 6).alias("dense"), F.round("sparse", 6).alias("sparse"),
                         F.round("colbert", 6).alias("colbert"), F.round("sparse_dense", 6).alias("sparse_dense"),
                         F.round((F.round("colbert", 6) + F.col("sparse") * 0.3 + F.col("dense")) / 2.3, 5).alias("all_modes"))


@register("rerank_by_mode", f"WITH {THREE_SQL}, j AS (SELECT d.qid, d.docid, m.score FROM dense d JOIN multi m USING (qid, docid)) " + S.ranked("j"))
def _(t):
    d, s = saved_runs(t)
    return X.rerank(d, multi_scores(t, (d, s)), "score", 20)


@register("dense_rerank", f"""WITH {NEIGHBOUR_SQL}, j AS (SELECT o.qid, o.docid, round(list_dot_product(a.e, b.e), 3) AS score
 FROM other o JOIN dense_v a ON a.vec_id = o.qid JOIN dense_v b ON b.vec_id = o.docid) """ + S.ranked("j"))
def _(t):
    return X.dense_rerank(t.vec_queries, two_runs(t)[1], t.vec_corpus, 20)


WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({c}), '[\\s\\p{{Z}}]+'), lambda w: w <> ''))"


@register("pair_rerank_overlap", f"""WITH {S.bm25('run', 5, 0.82, 0.68, True)},
 j AS (SELECT r.qid, r.docid, round(len(list_intersect({WORDS.format(c='b.text')}, {WORDS.format(c='d.text')})) / len({WORDS.format(c='b.text')}), 6) AS score
   FROM run r JOIN benchmark b ON b.item_id = r.qid JOIN documents d ON d.doc_id = r.docid) """ + S.ranked("j"))
def _(t):
    hits = bm25_run(t, 5, **APP_BM25).select("qid", "docid").join(t.corpus, "docid").join(t.topics, "qid")
    return X.pair_rerank(hits, k=5).select("qid", "docid", "score", "rank")


@register("sigmoid_scores", f"WITH {S.bm25('run', 10)} SELECT qid, docid, round(1 / (1 + exp(-score)), 6) AS score FROM run")
def _(t):
    return bm25_run(t).select("qid", "docid", F.round(V.sigmoid("score"), 6).alias("score"))


@register("query_shards", """WITH n AS (SELECT count(*) AS c FROM documents), p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)
 SELECT doc_id, least(floor(i / greatest(floor(c / 7), 1)), 6)::INT AS shard FROM p CROSS JOIN n""")
def _(t):
    return R.shard(t.documents.select("doc_id"), "doc_id", 7)


@register("query_shards_text_ids", """WITH n AS (SELECT count(*) AS c FROM documents), p AS (SELECT md5(doc_id::VARCHAR) AS qid, row_number() OVER (ORDER BY md5(doc_id::VARCHAR)) - 1 AS i FROM documents)
 SELECT qid, least(floor(i / greatest(floor(c / 7), 1)), 6)::INT AS shard FROM p CROSS JOIN n""")
def _(t):
    return R.shard(t.documents.select(F.md5(F.col("doc_id").cast("string")).alias("qid")), "qid", 7)


@register("rank_window", f"WITH {S.bm25('run', 50)} SELECT * FROM run WHERE rank > 2 AND rank <= 20")
def _(t):
    return R.rank_window(bm25_run(t, 50), 2, 20)


@register("rank_rows", f"WITH {NEIGHBOUR_SQL} SELECT qid, docid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM other")
def _(t):
    return R.rank_rows(two_runs(t)[1].drop("rank"), "qid", "score")


@register("run_key_union", f"WITH {NEIGHBOUR_SQL} SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.docid, b.docid) AS docid, a.score AS score_a, b.score AS score_b "
          "FROM dense a FULL JOIN other b ON a.qid = b.qid AND a.docid = b.docid")
def _(t):
    return R.key_union(*two_runs(t))
