"""Training rows, packing, windows and in-context retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from seekwell.checks import sql as S
from seekwell.checks.evaluation import items
from seekwell.checks.registry import register
from seekwell.checks.retrieval import bm25_run, dense_run
from seekwell.checks.text import turn_pairs, PAIRS_SQL
from seekwell.functions.text import space_tokens
from seekwell.operators import context as C, evaluation as E, packing as P, ranking as R, training as H
from seekwell.scale import running_total, stack

TRIPLES = S.dense("run", 20) + """,
j AS (SELECT r.qid, r.docid, r.rank, r.score, a.label = b.label AS rel FROM run r JOIN embeddings a ON a.vec_id = r.qid JOIN embeddings b ON b.vec_id = r.docid),
trip AS (SELECT qid, list(docid ORDER BY rank) FILTER (rel) AS pos, coalesce(list(docid ORDER BY rank) FILTER (NOT rel), []) AS neg,
  list(score ORDER BY rel DESC, rank) AS scores FROM j GROUP BY qid HAVING bool_or(rel))"""


def triples(t):
    """Neighbours with the same class are positives, the other neighbours negatives."""
    run = dense_run(t, 20)
    rows = E.judge_by_class(run, items(t)).join(run.select("qid", "docid", "score"), ["qid", "docid"])
    sides = rows.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.when(F.col("grade") == 1, F.struct("rank", "docid", "score")))).alias("p"),
        F.array_sort(F.collect_list(F.when(F.col("grade") == 0, F.struct("rank", "docid", "score")))).alias("n"))
    return sides.filter(F.size("p") > 0).select("qid", F.col("p.docid").alias("pos"), F.col("n.docid").alias("neg"), F.concat("p.score", "n.score").alias("teacher_scores"))


def text(col):
    return F.array_join(F.transform(col, lambda x: x.cast("string")), " ")


def shuffle_sql(items_sql: str, key: str) -> str:
    return (f"list_transform(list_sort(list_transform(range(0, len({items_sql})), lambda i: {{'h': md5('42|' || {key} || '|' || i), 'i': i, 'x': {items_sql}[i + 1]}})), lambda r: r.x)")


NEG_SQL = f"""{S.bm25('run', 50)}, {S.QRELS},
 c AS (SELECT r.qid, r.docid FROM run r ANTI JOIN qrels q ON q.qid = r.qid AND q.docid = r.docid WHERE rank > 2 AND rank <= 20),
 neg AS (SELECT * FROM (SELECT qid, docid, row_number() OVER (PARTITION BY qid ORDER BY md5('42|' || qid || '|' || docid), docid) AS pos FROM c) WHERE pos <= 10)"""


def mined(t):
    qrels = E.phrase_matches(t.corpus, t.topics)
    return H.hard_negatives(bm25_run(t, 50), qrels, 2, 20, 10), qrels


@register("hard_negatives", f"WITH {NEG_SQL} SELECT * FROM neg")
def _(t):
    return mined(t)[0]


@register("backfilled_negatives", f"""WITH {NEG_SQL}, o AS (SELECT doc_id AS docid, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS at, count(*) OVER () AS n FROM documents),
 s AS (SELECT item_id AS qid, (SELECT count(*) FROM neg WHERE neg.qid = item_id) AS have, (SELECT count(*) FROM qrels WHERE qrels.qid = item_id) AS npos FROM benchmark),
 d AS (SELECT qid, have, unnest(range(1, least(25 + npos, (SELECT count(*) FROM documents)) + 1)) AS draw FROM s WHERE have < 25),
 f AS (SELECT d.qid, have, draw, o.docid FROM d JOIN o ON o.at = (('0x' || substr(md5('42|' || d.qid), 1, 15))::BIGINT + draw) % o.n + 1),
 k AS (SELECT f.* FROM f ANTI JOIN (SELECT qid, docid FROM neg UNION SELECT qid, docid FROM qrels) u ON u.qid = f.qid AND u.docid = f.docid)
 SELECT * FROM neg UNION ALL SELECT qid, docid, pos FROM (SELECT qid, docid, have + row_number() OVER (PARTITION BY qid ORDER BY draw) AS pos FROM k) WHERE pos <= 25""")
def _(t):
    neg, qrels = mined(t)
    return H.backfill_negatives(t.topics, neg, qrels, t.corpus, 25)


REPEAT = "flatten(list_transform(range(0, CASE WHEN len({x}) >= {n} THEN 1 WHEN len({x}) = 0 THEN 0 ELSE ceil({n} / len({x}))::INT END), lambda z: {x}))"


@register("train_groups", f"""WITH {TRIPLES}, r AS (SELECT qid, pos, {REPEAT.format(x='neg', n=24)} AS neg FROM trip)
 SELECT qid, array_to_string({shuffle_sql('pos', 'qid')}[1:1] || {shuffle_sql('neg', 'qid')}[1:24], ' ') AS grp FROM r""")
def _(t):
    return triples(t).select("qid", text(H.train_group(F.col("pos"), F.col("neg"), F.col("qid"), 25)).alias("grp"))


@register("teacher_score_filter", f"WITH {TRIPLES} SELECT qid, len(scores) AS n FROM trip WHERE list_max(scores) >= 0.35 AND list_max(scores) - list_min(scores) >= 0.1")
def _(t):
    return H.teacher_filter(triples(t), minimum=0.35, margin=0.1).select("qid", F.size("teacher_scores").alias("n"))


CHOICE_AT = {"first": "1", "random": "('0x' || substr(md5('42|' || qid), 1, 8))::BIGINT % len(pos) + 1",
             "teacher": "list_position(scores, list_max(scores))", "teacher-pos": "list_position(scores[1:len(pos)], list_max(scores[1:len(pos)]))"}

for _how, _at in CHOICE_AT.items():
    @register(f"positive_choice_{_how.replace('-', '_')}", f"""WITH {TRIPLES}, a AS (SELECT *, {_at} AS ix FROM trip)
 SELECT qid, (pos || neg)[ix] AS positive, scores[ix] AS positive_score, array_to_string(list_filter(neg, lambda x, i: i + len(pos) <> ix), ' ') AS neg FROM a""")
    def _(t, how=_how):
        return H.choose_positive(triples(t), how).select("qid", "positive", "positive_score", text("neg").alias("neg"))


NEG_ORDER = {"first": "i", "random": "md5('42|' || qid || '|' || (i - 1))", "teacher+": "-s", "teacher-": "s"}

for _how, _key in NEG_ORDER.items():
    @register(f"negative_choice_{_how.replace('+', '_high').replace('-', '_low')}", f"""WITH {TRIPLES},
 r AS (SELECT qid, {REPEAT.format(x='neg', n=24)} AS x, {REPEAT.format(x='scores[len(pos) + 1:]', n=24)} AS s FROM trip WHERE len(neg) > 0),
 u AS (SELECT qid, unnest(x) AS x, unnest(s) AS s, generate_subscripts(x, 1) AS i FROM r),
 o AS (SELECT qid, x, s, row_number() OVER (PARTITION BY qid ORDER BY {_key}, i) AS pos FROM u)
 SELECT qid, pos, x AS neg, s AS score FROM o WHERE pos <= 24""")
    def _(t, how=_how):
        rows = H.choose_negatives(H.choose_positive(triples(t), "first"), 24, how)
        return rows.select("qid", F.posexplode(F.arrays_zip("neg", "neg_scores")).alias("p", "x")).select(
            "qid", (F.col("p") + 1).alias("pos"), F.col("x.neg").alias("neg"), F.col("x.neg_scores").alias("score"))


@register("stable_distillation", f"""WITH {TRIPLES}, u AS (SELECT qid, unnest(neg) AS x, unnest(scores[len(pos) + 1:]) AS s, generate_subscripts(neg, 1) AS i FROM trip)
 SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY s DESC, i) AS pos, x AS neg, s AS score FROM u""")
def _(t):
    rows = H.choose_positive(triples(t), "first").select("qid", F.posexplode(H.stable_distill(F.col("neg"), F.col("neg_scores"))).alias("p", "r"))
    return rows.select("qid", (F.col("p") + 1).alias("pos"), F.col("r.x").alias("neg"), F.col("r.s").alias("score"))


@register("default_teacher_scores", f"WITH {TRIPLES} SELECT qid, unnest(CASE WHEN len(pos) > 1 THEN scores ELSE [100.0e0] || list_transform(range(1, len(scores)), lambda i: 0.0e0) END) AS score FROM trip")
def _(t):
    d = triples(t)
    given = F.when(F.size("pos") > 1, F.col("teacher_scores"))
    return d.select("qid", F.explode(H.teacher_or_default(given, F.size("teacher_scores"))).alias("score"))


@register("history_as_negatives", f"WITH {TRIPLES} SELECT qid, array_to_string(CASE WHEN len(pos) > 3 THEN pos ELSE neg END, ' ') AS neg FROM trip")
def _(t):
    return triples(t).select("qid", text(H.history_negatives(F.when(F.size("pos") > 3, F.col("pos")), F.col("neg"))).alias("neg"))


@register("rerank_candidates", f"WITH {TRIPLES} SELECT qid, unnest(pos || neg) AS key, unnest(range(0, len(pos) + len(neg))) AS key_index FROM trip")
def _(t):
    d = triples(t).withColumns({"key": F.lit(None).cast("array<bigint>"), "key_index": F.lit(None).cast("array<bigint>"),
                                "pos_index": F.lit(None).cast("array<bigint>"), "neg_index": F.lit(None).cast("array<bigint>")})
    return H.rerank_candidates(d).select("qid", F.inline(F.arrays_zip("key", "key_index")))


def length_rows(t):
    """Turn pairs as training rows: the turn is the query, the next turn the positive."""
    return turn_pairs(t).select("conv_id", "turn", F.col("pred").alias("query"), F.array("gold").alias("pos"), F.array().cast("array<string>").alias("neg"))


BUCKET = "CASE WHEN n < 50 THEN '0-50' WHEN n < 100 THEN '50-100' WHEN n < 200 THEN '100-200' ELSE '200-inf' END"


@register("length_buckets", f"WITH {PAIRS_SQL}, l AS (SELECT greatest(len(string_split(pred, ' ')), len(string_split(gold, ' '))) AS n FROM p) SELECT {BUCKET} AS bucket, count(*) AS n, round(avg(n), 6) AS avg_length FROM l GROUP BY bucket")
def _(t):
    rows = length_rows(t).withColumn("length", H.row_length())
    return H.bucket_report(rows.withColumn("bucket", H.length_bucket(F.col("length"), (0, 50, 100, 200))))


@register("bucket_batch_sizes", """WITH l AS (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents), b AS (SELECT doc_id, CASE WHEN n < 500 THEN 0 WHEN n < 1000 THEN 1 WHEN n < 2000 THEN 2 WHEN n < 3000 THEN 3 WHEN n < 4000 THEN 4 WHEN n < 5000 THEN 5 WHEN n < 6000 THEN 6 WHEN n < 7000 THEN 7 ELSE 8 END AS b FROM l)
 SELECT doc_id, [48, 32, 20, 18, 14, 14, 12, 10, 8][b + 1] AS size8, [700, 570, 388, 288, 224, 180, 157, 128, 104][b + 1] AS size1, 16 AS other FROM b""")
def _(t):
    b = H.length_bucket(F.size(space_tokens("text")))
    return t.documents.select("doc_id", H.bucket_batch_size(b, 8, 16).alias("size8"), H.bucket_batch_size(b, 1, 16).alias("size1"), H.bucket_batch_size(b, 4, 16).alias("other"))


MERGED = """c AS (SELECT lang || source AS s, count(*) AS n FROM documents GROUP BY 1), m AS (SELECT doc_id, CASE WHEN n < 8 THEN 'small' ELSE s END AS source FROM documents JOIN c ON c.s = lang || source
  WHERE n >= 8 OR (SELECT sum(n) FROM c WHERE n < 8) >= 20)"""


def merged(t):
    rows = t.documents.select("doc_id", F.concat("lang", "source").alias("source"))
    return H.merge_small_sources(rows, "source", 8, 20)


@register("merged_small_sources", f"WITH {MERGED} SELECT source, count(*) AS n FROM m GROUP BY source")
def _(t):
    return merged(t).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@register("merged_small_sources_missing", """WITH s AS (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN lang || source END AS s FROM documents), c AS (SELECT s, count(*) AS n FROM s GROUP BY s),
 m AS (SELECT doc_id, CASE WHEN n < 6 THEN 'small' ELSE s.s END AS source FROM s JOIN c ON c.s IS NOT DISTINCT FROM s.s WHERE n >= 6 OR (SELECT sum(n) FROM c WHERE n < 6) >= 20) SELECT source, count(*) AS n FROM m GROUP BY source""")
def _(t):
    rows = t.documents.select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.concat("lang", "source")).alias("source"))
    return H.merge_small_sources(rows, "source", 6, 20).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


BATCHES = """r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id), doc_id) AS p, count(*) OVER (PARTITION BY source) AS n FROM documents),
 b AS (SELECT source, doc_id, (p - 1) // 6 AS batch, n FROM r)"""


@register("same_source_batches", f"WITH {BATCHES} SELECT source, doc_id, batch, md5('42|' || source || '|' || batch) AS batch_order FROM b WHERE n - batch * 6 >= 6")
def _(t):
    return H.batches(t.documents.select("source", "doc_id"), "source", "doc_id", 6)


@register("same_source_batches_with_tail", f"WITH {BATCHES} SELECT source, doc_id, batch FROM b WHERE n - batch * 6 >= 2")
def _(t):
    return H.batches(t.documents.select("source", "doc_id"), "source", "doc_id", 6, keep_tail=2).drop("batch_order")


STRIDES = """l AS (SELECT doc_id, (ceil((len(string_split(text, ' ')) - 256) / 128) + 1)::INT AS strides FROM documents),
 r AS (SELECT doc_id, strides, row_number() OVER (PARTITION BY strides ORDER BY md5('42|' || doc_id), doc_id) AS p, count(*) OVER (PARTITION BY strides) AS n, row_number() OVER (ORDER BY strides, md5('42|' || doc_id), doc_id) AS g FROM l)"""


def stride_rows(t):
    return t.documents.select("doc_id", F.size(space_tokens("text")).alias("length"))


@register("stride_batches_strict", f"WITH {STRIDES} SELECT doc_id, strides, (p - 1) // 4 AS batch FROM r WHERE n - (p - 1) // 4 * 4 >= 4")
def _(t):
    return H.stride_batches(stride_rows(t), "length", "doc_id", 256, 128, 4).drop("length", "batch_order")


@register("stride_batches_relaxed", f"WITH {STRIDES} SELECT doc_id, strides, (g - 1) // 4 AS batch FROM r")
def _(t):
    return H.stride_batches(stride_rows(t), "length", "doc_id", 256, 128, 4, "relaxed").drop("length", "batch_order")


@register("stride_batches_ascending", f"WITH {STRIDES}, b AS (SELECT doc_id, strides, (g - 1) // 4 AS batch FROM r), m AS (SELECT *, max(strides) OVER (PARTITION BY batch) AS most FROM b) SELECT doc_id, strides, batch, dense_rank() OVER (ORDER BY most, batch)::BIGINT AS place FROM m")
def _(t):
    rows = H.stride_batches(stride_rows(t), "length", "doc_id", 256, 128, 4, "relaxed", sort="ascend").drop("length")
    order = rows.select("batch_order").distinct()
    return rows.join(running_total(order, [], "batch_order", F.lit(1).cast("long"), "place"), "batch_order").drop("batch_order")


@register("stride_batches_descending", f"WITH {STRIDES}, b AS (SELECT doc_id, strides, (p - 1) // 4 AS batch FROM r WHERE n - (p - 1) // 4 * 4 >= 4) SELECT doc_id, strides, batch, dense_rank() OVER (ORDER BY -strides, batch)::BIGINT AS place FROM b")
def _(t):
    rows = H.stride_batches(stride_rows(t), "length", "doc_id", 256, 128, 4, sort="descend").drop("length")
    order = rows.select("batch_order").distinct()
    return rows.join(running_total(order, [], "batch_order", F.lit(1).cast("long"), "place"), "batch_order").drop("batch_order")


@register("shuffled_thirds", f"""WITH d AS (SELECT doc_id, text, length(text) // 3 + 1 AS z, ('0x' || substr(md5('42|draw|' || doc_id), 1, 8))::BIGINT / 4294967296 AS u FROM documents),
 p AS (SELECT *, list_filter([text[1:z], text[z + 1:2 * z], text[2 * z + 1:3 * z]], lambda x: x <> '') AS parts FROM d)
 SELECT doc_id, CASE WHEN length(text) > 100 AND u < 0.5 THEN array_to_string({shuffle_sql('parts', 'doc_id')}, ' ') ELSE text END AS text FROM p""")
def _(t):
    return t.documents.select("doc_id", H.shuffle_text(F.col("text"), F.col("doc_id"), 0.5).alias("text"))


MIXTURE = {"src0": 30.0, "src1": 10.0, "src2": 60.0, "src3": 0.0}


@register("packed_sequences", """WITH d AS (SELECT source, doc_id, unnest(string_split(text, ' ') || ['</s>']) AS token, generate_subscripts(string_split(text, ' ') || ['</s>'], 1) AS i FROM documents WHERE source IN ('src0', 'src1', 'src2')),
 s AS (SELECT source, token, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) - 1 AS ix FROM d), c AS (SELECT source, ix // 128 AS piece, string_agg(token, ' ' ORDER BY ix) AS text, count(*) AS n FROM s GROUP BY 1, 2)
 SELECT source, piece, text FROM c WHERE n = 128 AND piece < CASE source WHEN 'src0' THEN ceil(ceil(40000 * 0.3e0) / 128) WHEN 'src1' THEN ceil(ceil(40000 * 0.1e0) / 128) ELSE ceil(ceil(40000 * 0.6e0) / 128) END""")
def _(t):
    packed = P.pack_mixture(t.documents.select("source", "doc_id", "text"), MIXTURE, 40000, 128)
    return packed.select("source", "piece", F.array_join("tokens", " ").alias("text"))


def window_sql(size: int, stride: int, count: str) -> str:
    return f"""WITH d AS (SELECT doc_id, string_split(text, ' ') AS t FROM documents), n AS (SELECT *, len(t) AS n FROM d),
 w AS (SELECT *, unnest(range(0, {count})) AS w FROM n)
 SELECT doc_id, w AS "window", array_to_string(t[w * {stride} + 1:w * {stride} + {size}], ' ') AS text, least(w * {stride} + {size}, n) - CASE WHEN w = 0 THEN 0 ELSE least((w - 1) * {stride} + {size}, n) END AS labelled FROM w"""


@register("sliding_windows", window_sql(256, 100, "greatest(ceil((n - 256) / 100), 0)::INT + 1"))
def _(t):
    return P.sliding_windows(t.documents, 256, 100).select("doc_id", "window", F.array_join("tokens", " ").alias("text"), "labelled")


@register("single_windows", window_sql(256, 256, "1").replace("AS labelled FROM w", "AS labelled FROM w WHERE n >= 64"))
def _(t):
    return P.sliding_windows(t.documents, 256, 0, 64).select("doc_id", "window", F.array_join("tokens", " ").alias("text"), "labelled")


@register("suffix_targets", """WITH d AS (SELECT doc_id, string_split(text[1:4000], ' ') AS t FROM documents), n AS (SELECT doc_id, CASE WHEN len(t) > 300 THEN t[len(t) - 299:] ELSE t END AS t FROM d)
 SELECT doc_id, array_to_string(t, ' ') AS text, len(t) - 64 AS masked, 64 AS labelled FROM n WHERE len(t) >= 64""")
def _(t):
    return P.suffix_targets(t.documents, 300, 64, 4000).select("doc_id", F.array_join("tokens", " ").alias("text"), "masked", "labelled")


@register("language_rows", """WITH d AS (SELECT doc_id, string_split(text, ' ') AS t FROM documents) SELECT doc_id, array_to_string(CASE WHEN len(t) < 400 THEN t || ['</s>'] ELSE t[1:400] END, ' ') AS text FROM d WHERE len(t) >= 50""")
def _(t):
    return P.language_rows(t.documents, 50, 400).select("doc_id", F.array_join("tokens", " ").alias("text"))


@register("instruction_rows", f"""WITH {PAIRS_SQL}, w AS (SELECT conv_id * 1000 + turn AS id, string_split(trim(pred), ' ') AS i, string_split(trim(gold), ' ') AS o FROM p), h AS (SELECT *, (100 - len(o)) // 2 AS h FROM w WHERE len(o) <= 100)
 SELECT id, array_to_string(CASE WHEN len(i) > 100 - len(o) THEN i[1:h] || CASE WHEN h = 0 THEN [] ELSE i[len(i) - h + 1:] END ELSE i END, ' ') AS input, array_to_string(o, ' ') AS output FROM h""")
def _(t):
    rows = turn_pairs(t).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("pred").alias("input"), F.col("gold").alias("output"))
    return P.instruction_rows(rows, 100)


@register("collated_keys", f"""WITH {S.bm25('run', 3)} SELECT qid, string_agg(docid::VARCHAR, ' ' ORDER BY rank) AS key_index, md5(string_agg(d.text, '|' ORDER BY rank)) AS key_digest FROM run r JOIN documents d ON d.doc_id = r.docid GROUP BY qid""")
def _(t):
    rows = H.collate_keys(t.topics, bm25_run(t, 3), t.corpus)
    return rows.select("qid", text("key_index").alias("key_index"), F.md5(F.array_join("key", "|")).alias("key_digest"))


@register("collated_negatives", f"""WITH {S.bm25('run', 30)}, {S.QRELS},
 h AS (SELECT r.qid, r.docid, r.rank, d.text FROM run r JOIN documents d ON d.doc_id = r.docid ANTI JOIN qrels q ON q.qid = r.qid AND q.docid = r.docid),
 s AS (SELECT DISTINCT q.qid, d.text FROM qrels q JOIN documents d ON d.doc_id = q.docid), k AS (SELECT h.* FROM h ANTI JOIN s ON s.qid = h.qid AND s.text = h.text),
 a AS (SELECT k.* FROM k JOIN benchmark b ON b.item_id = k.qid WHERE NOT contains(lower(k.text), lower(split_part(b.text, ' ', 3))))
 SELECT qid, docid, pos FROM (SELECT qid, docid, row_number() OVER (PARTITION BY qid ORDER BY rank) AS pos FROM a) WHERE pos <= 5""")
def _(t):
    queries = t.topics.withColumn("answers", F.array(F.split("query", " ")[2]))
    rows = H.collate_negatives(queries, bm25_run(t, 30), t.corpus, E.phrase_matches(t.corpus, t.topics), 5, drop_answers=True)
    return rows.select("qid", "docid", "pos")


@register("collated_scores", f"WITH {TRIPLES}, u AS (SELECT qid, unnest(list_sort(pos || neg)) AS docid FROM trip) SELECT u.qid, string_agg(printf('%.6f', j.score), ' ' ORDER BY u.docid) AS teacher_scores FROM u JOIN j ON j.qid = u.qid AND j.docid = u.docid GROUP BY u.qid")
def _(t):
    d = triples(t).select("qid", F.array_sort(F.concat("pos", "neg")).alias("key_index"))
    rows = H.collate_scores(d, dense_run(t, 20))
    return rows.select("qid", F.array_join(F.transform("teacher_scores", lambda s: F.format_string("%.6f", s)), " ").alias("teacher_scores"))


@register("collated_losses", f"""WITH {TRIPLES}, h AS (SELECT qid, CASE WHEN qid % 2 = 0 THEN list_reverse(pos || neg) ELSE pos || neg END AS keys FROM trip), u AS (SELECT qid, unnest(keys) AS docid, generate_subscripts(keys, 1) AS place FROM h)
 SELECT u.qid, string_agg(printf('%.6f', -(j.score + u.place)), ' ' ORDER BY u.place) AS teacher_scores FROM u JOIN j ON j.qid = u.qid AND j.docid = u.docid GROUP BY u.qid""")
def _(t):
    """Even samples have their candidates as history, the others as positives and negatives."""
    d = triples(t).withColumn("history", F.when(F.col("qid") % 2 == 0, F.reverse(F.concat("pos", "neg"))))
    places = d.select("qid", F.posexplode(F.coalesce("history", F.concat("pos", "neg"))).alias("place", "docid"))
    losses = places.join(dense_run(t, 20), ["qid", "docid"]).select("qid", "place", (F.col("score") + F.col("place") + 1).alias("loss"))
    rows = H.collate_losses(d.drop("teacher_scores"), losses)
    return rows.select("qid", F.array_join(F.transform("teacher_scores", lambda s: F.format_string("%.6f", s)), " ").alias("teacher_scores"))


@register("first_rows_per_group", "SELECT lang, doc_id, rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 5")
def _(t):
    return R.first_per_group(t.documents.select("lang", "doc_id"), "lang", "doc_id", 5)


@register("budget_cut", "SELECT conv_id, turn, used FROM (SELECT conv_id, turn, sum(len(string_split(text, ' '))) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS used FROM conversations) WHERE used <= 200")
def _(t):
    rows = t.conversations.select("conv_id", "turn", F.size(space_tokens("text")).alias("n"))
    return R.budget_cut(rows, "conv_id", "turn", "n", 200).drop("n")


@register("concatenated_sets", "SELECT kind, count(*) AS n, count(lang) AS with_lang FROM (SELECT 'doc' AS kind, lang FROM documents UNION ALL SELECT 'turn', NULL FROM conversations UNION ALL SELECT 'item', NULL FROM benchmark) GROUP BY kind")
def _(t):
    all_rows = R.concat_sets(t.documents.select(F.lit("doc").alias("kind"), "lang"), t.conversations.select(F.lit("turn").alias("kind")), t.benchmark.select(F.lit("item").alias("kind")))
    return all_rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("lang").alias("with_lang"))


@register("candidate_pool", f"WITH {PAIRS_SQL} SELECT pred AS text FROM p UNION SELECT gold FROM p")
def _(t):
    return R.candidate_pool(turn_pairs(t).select(F.array("pred").alias("pos"), F.array("gold").alias("neg")))


@register("labelled_hits", f"WITH {S.bm25('run', 20)}, {S.QRELS} SELECT qid, docid, rank FROM run SEMI JOIN qrels USING (qid, docid)")
def _(t):
    return R.labelled_hits(bm25_run(t, 20), E.phrase_matches(t.corpus, t.topics)).select("qid", "docid", "rank")


@register("unlabelled_hits", f"WITH {S.bm25('run', 20)}, {S.QRELS} SELECT qid, docid, rank FROM run ANTI JOIN qrels USING (qid, docid) WHERE qid <> docid")
def _(t):
    return R.unlabelled_hits(bm25_run(t, 20), E.phrase_matches(t.corpus, t.topics)).select("qid", "docid", "rank")


@register("padded_hits", f"WITH {S.dense('run', 10)} SELECT qid, docid, rank, score FROM run WHERE score > 0.3")
def _(t):
    from seekwell.sources.files import hit_lists

    lists = hit_lists(dense_run(t, 10)).select(F.col("query_id").alias("qid"), "score", F.zip_with("pred", "score", lambda d, s: F.when(s > 0.3, d).otherwise(F.lit(-1))).alias("pred"))
    return R.drop_padding(lists)


HISTORY = """q AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'user' GROUP BY conv_id), cur AS (SELECT c.conv_id, c.text FROM conversations c JOIN q ON c.conv_id = q.conv_id AND c.turn = q.last),
 h AS (SELECT c.conv_id, c.turn, c.text FROM conversations c JOIN q ON c.conv_id = q.conv_id AND c.turn < q.last)"""


def history_sql(order: str, join_order: str, extra: str = "", source: str = "h") -> str:
    return f"""WITH {HISTORY}{extra}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY {order}) AS rank FROM {source}), p AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY {join_order}) AS t FROM r WHERE rank <= 2 GROUP BY conv_id)
 SELECT conv_id, coalesce(p.t || chr(10), '') || cur.text AS prompt FROM cur LEFT JOIN p USING (conv_id)"""


LOCAL_BM25 = """, it AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS token, len(string_split(text, ' ')) AS dl FROM h), tf AS (SELECT conv_id, turn, token, count(*) AS tf, max(dl) AS dl FROM it GROUP BY ALL),
 dfc AS (SELECT conv_id, token, count(*) AS df FROM tf GROUP BY ALL), nc AS (SELECT conv_id, count(*) AS n FROM h GROUP BY conv_id), qt AS (SELECT conv_id, unnest(string_split(text, ' ')) AS token FROM cur),
 sc AS (SELECT tf.conv_id, tf.turn, round(sum(ln((n - df + 0.5e0) / (df + 0.5e0) + 1) * 1.9e0 * tf.tf / (tf.tf + 0.9e0 * (0.6e0 + 0.4e0 * tf.dl))), 6) AS score FROM qt JOIN tf ON tf.conv_id = qt.conv_id AND tf.token = qt.token JOIN dfc ON dfc.conv_id = qt.conv_id AND dfc.token = qt.token JOIN nc ON nc.conv_id = qt.conv_id GROUP BY ALL),
 hs AS (SELECT h.*, sc.score FROM h JOIN sc USING (conv_id, turn) WHERE score <> 0)"""

for _method, _order, _extra, _source in (("recent", "turn DESC", "", "h"), ("random", "md5('42|' || conv_id || '|' || turn), turn", "", "h"),
                                         ("bm25", "score DESC, turn", LOCAL_BM25, "hs"), ("oracle", "length(text) / 100, turn", "", "h")):
    for _name, _join in (("sequential", "turn"), ("relevance", "rank DESC")):
        @register(f"history_{_method}_{_name}", history_sql(_order, _join, _extra, _source))
        def _(t, method=_method, name=_name):
            query, history = C.split_history(t.conversations)
            return C.history_retrieve(history.withColumn("loss", F.length("text") / 100), query, method, 2, name)


@register("history_dense")
def _(t):
    from seekwell.operators.hooks import embed, hashing_encoder

    query, history = C.split_history(t.conversations)
    return C.history_retrieve(embed(history, "text", hashing_encoder(64)), embed(query, "text", hashing_encoder(64)), "dense", 2, "relevance")


def chunk_sql(mode: str) -> str:
    keys = "c - w + 1" if mode == "replace" else "c - w - 1"
    keep = "w - 4" if mode == "replace" else "w"
    return f"""WITH d AS (SELECT doc_id, string_split(text, ' ') AS t, ceil(len(string_split(text, ' ')) / 32)::INT AS c FROM documents), f AS (SELECT doc_id, c, least(c, 8) AS w, list_transform(range(0, c * 32 - len(t)), lambda i: '<pad>') || t AS t FROM d),
 b AS (SELECT doc_id, t, c, w, {keys} AS k FROM f WHERE {keys} >= 1 AND c >= 2{" AND w >= 6" if mode == "replace" else ""}), ch AS (SELECT doc_id, c, k, unnest(range(0, c)) AS item, t FROM b), cc AS (SELECT doc_id, c, k, item, list_filter(t[item * 32 + 1:item * 32 + 32], lambda x: x <> '<pad>') AS toks FROM ch),
 it AS (SELECT doc_id, item, unnest(toks) AS token, len(toks) AS dl FROM cc WHERE item < k), tf AS (SELECT doc_id, item, token, count(*) AS tf, max(dl) AS dl FROM it GROUP BY ALL), dfc AS (SELECT doc_id, token, count(*) AS df FROM tf GROUP BY ALL), nc AS (SELECT doc_id, max(k) AS n FROM cc GROUP BY doc_id),
 qt AS (SELECT doc_id, unnest(toks) AS token FROM cc WHERE item = c - 2), sc AS (SELECT tf.doc_id, tf.item, round(sum(ln((n - df + 0.5e0) / (df + 0.5e0) + 1) * 1.9e0 * tf.tf / (tf.tf + 0.9e0 * (0.6e0 + 0.4e0 * tf.dl))), 6) AS score FROM qt JOIN tf ON tf.doc_id = qt.doc_id AND tf.token = qt.token JOIN dfc ON dfc.doc_id = qt.doc_id AND dfc.token = qt.token JOIN nc ON nc.doc_id = qt.doc_id GROUP BY ALL),
 r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item) AS rank FROM sc WHERE score <> 0) WHERE rank <= 2),
 v AS (SELECT doc_id, rank, unnest([item, item + 1]) AS item FROM r), g AS (SELECT v.doc_id, string_agg(array_to_string(cc.toks, ' '), ' ' ORDER BY v.rank DESC, v.item) FILTER (len(cc.toks) > 0) AS found FROM v JOIN cc ON cc.doc_id = v.doc_id AND cc.item = v.item GROUP BY v.doc_id)
 SELECT doc_id, coalesce(found || ' ', '') || array_to_string(list_filter(t[(c - (CASE WHEN found IS NULL THEN w ELSE {keep} END)) * 32 + 1:], lambda x: x <> '<pad>'), ' ') AS context FROM b LEFT JOIN g USING (doc_id)"""


for _mode in ("replace", "concat"):
    @register(f"chunk_retrieval_{_mode}", chunk_sql(_mode))
    def _(t, mode=_mode):
        return C.chunk_retrieve(t.documents, 32, 256, 2, mode)
