"""Readers and writers, each as a round trip of a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from seekwell.checks import sql as S
from seekwell.checks.registry import Tables, register
from seekwell.checks.retrieval import bm25_run, dense_run, lexical_weights
from seekwell.operators import lexical as L
from seekwell.scale import scratch_path
from seekwell.sources import files as A


def folder(t: Tables, name: str) -> str:
    return scratch_path(t.spark, name)


@register("corpus_json_lines", "SELECT doc_id::VARCHAR AS docid, text FROM documents")
def _(t):
    path = folder(t, "corpus")
    A.write_corpus(t.corpus, path)
    return A.read_corpus(t.spark, path, "jsonl").select("docid", "text")


@register("corpus_json_array", "SELECT item_id::VARCHAR AS docid, text FROM benchmark")
def _(t):
    # arrays of 64 rows, one per file, as exported corpora have it
    path = folder(t, "array")
    row = F.struct(F.col("item_id").alias("id"), F.col("text").alias("contents"))
    arrays = t.benchmark.groupBy(F.floor(F.col("item_id") / 64)).agg(F.to_json(F.collect_list(row)).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return A.read_corpus(t.spark, path, "json").select("docid", "text")


@register("corpus_tab_separated", "SELECT doc_id::VARCHAR AS docid, translate(text, chr(10) || chr(13) || chr(9), '   ') AS text, source AS title FROM documents")
def _(t):
    path = folder(t, "tsv")
    t.documents.select(F.concat_ws("\t", F.col("doc_id").cast("string"), F.translate("text", "\n\r\t", "   "), "source").alias("value")).write.text(path)
    return A.read_corpus(t.spark, path, "tsv")


@register("topics_round_trip", "SELECT item_id::VARCHAR AS qid, translate(text, chr(10) || chr(9), '  ') AS query FROM benchmark")
def _(t):
    path = folder(t, "topics")
    A.write_topics(t.topics, path)
    return A.read_topics(t.spark, path)


@register("qa_pairs_from_nested_json", "SELECT a.conv_id, a.turn // 1 AS turn, a.text AS question, b.text AS answer FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant'")
def _(t):
    a, b = t.conversations.alias("a"), t.conversations.alias("b")
    pairs = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1)
                   & (F.col("a.role") == "user") & (F.col("b.role") == "assistant"))
    nested = pairs.select("a.conv_id", "a.turn", F.to_json(F.array(F.array("a.text", "b.text"))).alias("value"))
    return A.qa_pairs(nested).select("conv_id", "turn", "question", "answer")


@register("answer_dictionary", "SELECT text AS question, arg_max(source, doc_id) AS answer FROM documents GROUP BY text")
def _(t):
    rows = t.documents.select(F.col("text").alias("question"), F.col("source").alias("answer"), F.col("doc_id").alias("pos"))
    return A.qa_dict(rows)


@register("positional_ids", "SELECT doc_id, row_number() OVER (ORDER BY n_chars * 1000000 + doc_id) - 1 AS docid FROM documents")
def _(t):
    df = t.documents.select("doc_id", (F.col("n_chars") * 1000000 + F.col("doc_id")).alias("key"))
    return A.with_positional_id(df, "key").select("doc_id", "docid")


@register("labelled_lines", "SELECT trim(unnest(string_split(text, chr(10)))) AS sentence, role AS label FROM conversations WHERE role IN ('user', 'assistant')")
def _(t):
    files = {}
    for role in ("user", "assistant"):
        path = folder(t, role)
        t.conversations.filter(F.col("role") == role).select("text").write.text(path)
        files[path] = role
    return A.read_labelled_lines(t.spark, files)


@register("run_file_round_trip", f"WITH {S.bm25('run', 20)} SELECT qid::VARCHAR AS qid, docid::VARCHAR AS docid, rank::INT AS rank, score FROM run WHERE rank <= 10")
def _(t):
    path = folder(t, "run")
    A.write_run(bm25_run(t, 20), path)
    return A.read_run(t.spark, path, top=10)


@register("run_file_lines", f"WITH {S.bm25('run', 10)} SELECT qid, rank, qid || ' Q0 ' || docid || ' ' || rank || ' ' || printf('%.6f', score) || ' bm25' AS value FROM run")
def _(t):
    return A.run_lines(bm25_run(t), "bm25")


@register("ranked_list_file", f"WITH {S.dense('run', 10)} SELECT qid::VARCHAR AS qid, docid::VARCHAR AS docid, rank::INT AS rank FROM run")
def _(t):
    path = folder(t, "list")
    dense_run(t).select(F.concat_ws("\t", *[F.col(c).cast("string") for c in ("qid", "docid", "rank")]).alias("value")).write.text(path)
    return A.read_msmarco_run(t.spark, path)


@register("hit_file_round_trip", f"WITH {S.dense('run', 10)} SELECT qid::VARCHAR AS qid, docid::VARCHAR AS docid, rank::INT AS rank, score FROM run")
def _(t):
    path = folder(t, "hits")
    A.write_hits(dense_run(t), path)
    return A.read_hits(t.spark, path)


@register("labels_from_table", "SELECT doc_id AS qid, doc_id AS docid, (quality * 2 + toxic)::INT AS grade FROM labels")
def _(t):
    return A.qrels_from_table(t.labels.withColumn("g", F.col("quality") * 2 + F.col("toxic")), "doc_id", "doc_id", "g")


@register("labels_from_positions", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS qid, unnest([quality, toxic + 2]) AS docid, 1 AS grade FROM labels")
def _(t):
    df = t.labels.select("doc_id", F.lit(None).cast("long").alias("query_id"), F.array("quality", F.col("toxic") + 2).alias("pos_index"))
    return A.qrels_from_pos_index(df, "doc_id")


@register("labels_first_positive", "SELECT text AS qid, min(doc_id) AS docid, 1 AS grade FROM documents GROUP BY text")
def _(t):
    # the positive list of a text is the smallest and the largest id that carries it
    df = t.documents.groupBy(F.col("text").alias("qid")).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    return A.qrels_from_positives(df.select("qid", F.array(F.struct(F.col("a").alias("docid")), F.struct(F.col("b").alias("docid"))).alias("pos")), True)


@register("triples_file_round_trip", "SELECT text AS query, source AS pos, lang AS neg, n_chars::DOUBLE AS pos_score FROM documents")
def _(t):
    path = folder(t, "triples")
    t.documents.select(F.col("text").alias("query"), F.array("source").alias("pos"), F.array("lang").alias("neg"),
                       F.array(F.col("n_chars").cast("double")).alias("pos_scores")).write.json(path)
    df = A.read_triples(t.spark, path, with_scores=True)
    return df.select("query", F.col("pos")[0].alias("pos"), F.col("neg")[0].alias("neg"), F.col("pos_scores")[0].alias("pos_score"))


@register("sharded_write", "SELECT ceil(count(*) / 128) <= count(*) AS bounded, count(*) AS n FROM documents")
def _(t):
    path = folder(t, "shards")
    A.write_sharded(t.documents, path, 128)
    back = A.read_many(t.spark, path, t.documents.schema)
    return back.groupBy("source").count().agg((F.max("count") <= 128).alias("bounded"), F.sum("count").alias("n"))


@register("many_files_with_source", "SELECT lang, count(*) AS n, count(*) AS n_from_folder FROM documents GROUP BY lang")
def _(t):
    path = folder(t, "many")
    t.documents.select("doc_id", "lang", F.col("lang").alias("part")).write.partitionBy("part").json(path)
    back = A.read_many(t.spark, f"{path}/*", "doc_id long, lang string")
    inside = F.col("source").contains(F.concat(F.lit("part="), "lang", F.lit("/")))
    return back.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(inside, 1)).alias("n_from_folder"))


@register("capped_rows_per_source", """SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id), doc_id) AS r FROM documents) WHERE r <= 10""")
def _(t):
    _, n = A.parse_capped_path("documents.json[10]")
    return A.cap_rows(t.documents.select("source", "doc_id"), "source", "doc_id", n)


@register("sparse_vector_file", "WITH d AS (SELECT item_id AS id, unnest(string_split(text, ' ')) AS token FROM benchmark) SELECT id::VARCHAR AS id, token, ceil(100 * (1 + ln(count(*))))::INT AS w FROM d WHERE token <> '' GROUP BY id, token")
def _(t):
    path = folder(t, "sparse")
    A.write_sparse(L.as_map(lexical_weights(t.benchmark, "item_id")), path)
    return A.read_sparse(t.spark, path)


@register("embedding_store", "SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1)::INT - 1 AS pos FROM embeddings")
def _(t):
    path = folder(t, "vectors")
    A.write_embeddings(t.embeddings.withColumnRenamed("vec_id", "id"), path)
    return A.read_embeddings(t.spark, path).select("id", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


@register("metric_log", "SELECT lang, 'eval' AS command, '{\"k\": 10}' AS args, count(*) AS n FROM documents GROUP BY lang")
def _(t):
    path = folder(t, "log")
    per_lang = t.documents.groupBy("lang").count()
    A.append_metrics(per_lang, path, "eval", {"k": 10})
    log = t.spark.read.schema("time timestamp, command string, args string, metrics string").json(path)
    m = F.from_json("metrics", "lang string, count long")
    return log.select(m["lang"].alias("lang"), "command", "args", m["count"].alias("n"))


@register("changed_sources", "SELECT (SELECT count(DISTINCT lang) FROM documents) AS first_run, 0 AS unchanged, (SELECT count(DISTINCT role) FROM conversations) AS added")
def _(t):
    base, manifest = folder(t, "watched"), folder(t, "manifest")
    t.documents.select("doc_id", "lang").repartition("lang").write.partitionBy("lang").parquet(f"{base}/a")
    watch = [f"{base}/a/*/*.parquet"]
    first = A.changed_files(t.spark, watch, manifest).count()
    A.save_manifest(t.spark, watch, manifest)
    same = A.changed_files(t.spark, watch, manifest)
    t.conversations.select("turn", "role").repartition("role").write.partitionBy("role").parquet(f"{base}/b")
    added = A.changed_files(t.spark, [*watch, f"{base}/b/*/*.parquet"], manifest)
    return same.agg(F.lit(first).alias("first_run"), F.count(F.lit(1)).alias("unchanged")).select(
        "first_run", "unchanged", added.agg(F.count(F.lit(1))).scalar().alias("added"))


@register("split_by_ratio", """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS p, count(*) OVER () AS n FROM labels)
 SELECT doc_id, CASE WHEN p <= floor(n * 0.2e0) THEN 'test' ELSE 'train' END AS split FROM r""")
def _(t):
    return A.split_by_ratio(t.labels.select("doc_id"), "doc_id", 0.2)


@register("label_mapping", "SELECT doc_id, CASE WHEN toxic = 1 THEN 'human' WHEN quality = 1 THEN 'consult' ELSE 'chat' END AS label, CASE WHEN toxic = 1 THEN 2 WHEN quality = 1 THEN 1 ELSE 0 END AS label_id FROM labels")
def _(t):
    named = t.labels.select("doc_id", F.when(F.col("toxic") == 1, "human").when(F.col("quality") == 1, "consult").otherwise("chat").alias("label"))
    ids = A.label_ids(named, A.INTENTS).drop("label")
    return A.label_names(ids, A.INTENTS).select("doc_id", "label", "label_id")


@register("saved_index_search", f"WITH {S.bm25('run', 10)} SELECT * FROM run")
def _(t):
    path = folder(t, "index")
    L.build_index(t.corpus).save(path)
    return L.bm25_search(L.LexicalIndex.load(t.spark, path), t.topics, 10)
