"""Metrics over whole runs and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from seekwell.checks import sql as S
from seekwell.checks.registry import register
from seekwell.checks.retrieval import bm25_run, dense_run
from seekwell.checks.text import NORM_EN, NORM_ZH, PAIRS_SQL, turn_pairs
from seekwell.functions import scoring as Q
from seekwell.functions.text import first_integer, first_line, integers, space_tokens, words
from seekwell.operators import dense as D, evaluation as E, ranking as R
from seekwell.scale import stack

KS = (1, 5, 10, 20)


def items(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), "label")


JUDGED = S.dense("run", 20) + """,
judged AS (SELECT r.qid, r.docid, r.rank, (a.label = b.label)::INT AS grade FROM run r JOIN embeddings a ON a.vec_id = r.qid JOIN embeddings b ON b.vec_id = r.docid),
totals AS (SELECT e.vec_id AS qid, c.n - 1 AS n_rel FROM embeddings e JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) c USING (label))"""


def metric_sql(name: str, expr: str) -> str:
    """Mean over queries of ``expr`` at each cutoff ``k``, long form."""
    parts = [f"SELECT '{name}@{k}' AS metric, round(avg(v), 6) AS value FROM (SELECT j.qid, {expr.format(k=k)} AS v FROM cum j JOIN totals t USING (qid) GROUP BY j.qid)" for k in KS]
    return " UNION ALL ".join(parts)


CUM = "cum AS (SELECT *, sum(grade) OVER (PARTITION BY qid ORDER BY rank) AS found FROM judged)"
EXPR = {
    "mrr": "coalesce(1 / min(CASE WHEN grade > 0 AND rank <= {k} THEN rank END), 0)",
    "recall": "count(CASE WHEN grade > 0 AND rank <= {k} THEN 1 END) / max(n_rel)",
    "precision": "count(CASE WHEN grade > 0 AND rank <= {k} THEN 1 END) / {k}",
    "map": "coalesce(sum(CASE WHEN grade > 0 AND rank <= {k} THEN found / rank END), 0) / max(n_rel)",
    "ndcg": "coalesce(sum(CASE WHEN grade > 0 AND rank <= {k} THEN 1 / log2(rank + 1) END), 0) / list_sum(list_transform(range(1, least({k}, max(n_rel)) + 1), lambda i: 1 / log2(i + 1)))",
}


def judged_dense(t):
    return E.query_metrics(E.judge_by_class(dense_run(t, 20), items(t)), E.class_totals(items(t)), KS)


for _name in EXPR:
    @register(f"dense_{_name}", f"WITH {JUDGED}, {CUM} " + metric_sql(_name, EXPR[_name]))
    def _(t, name=_name):
        return E.mean_metrics(judged_dense(t)).filter(F.col("metric").startswith(f"{name}@"))


@register("phrase_labels", f"WITH {S.QRELS} SELECT qid, docid FROM qrels")
def _(t):
    return E.phrase_matches(t.corpus, t.topics)


BM25_JUDGED = f"""{S.bm25('run', 20)}, {S.QRELS},
judged AS (SELECT r.qid, r.docid, r.rank, (q.docid IS NOT NULL)::INT AS grade FROM run r LEFT JOIN qrels q ON q.qid = r.qid AND q.docid = r.docid),
totals AS (SELECT qid, coalesce(n, 0) AS n_rel FROM (SELECT DISTINCT qid FROM run) LEFT JOIN (SELECT qid, count(*) AS n FROM qrels GROUP BY qid) USING (qid))"""


@register("bm25_metrics", f"WITH {BM25_JUDGED}, {CUM} " + " UNION ALL ".join(
    metric_sql(n, EXPR[n].replace("/ max(n_rel)", "/ nullif(max(n_rel), 0)").replace("max(n_rel)) + 1)", "greatest(max(n_rel), 1)) + 1)")).replace("AS v FROM cum", "AS v FROM cum").replace("avg(v)", "avg(coalesce(v, 0))") for n in EXPR))
def _(t):
    qrels = E.phrase_matches(t.corpus, t.topics)
    return E.mean_metrics(E.query_metrics(E.judge(bm25_run(t, 20), qrels), E.label_totals(qrels), KS))


@register("graded_ndcg", f"""WITH {S.dense('run', 20)}, c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
 g AS (SELECT r.qid, r.rank, CASE WHEN a.label = b.label THEN 2 WHEN abs(a.label - b.label) = 1 THEN 1 ELSE 0 END AS grade FROM run r JOIN embeddings a ON a.vec_id = r.qid JOIN embeddings b ON b.vec_id = r.docid),
 t AS (SELECT e.vec_id AS qid, max(CASE WHEN c.label = e.label THEN c.n - 1 ELSE 0 END) AS n2, sum(CASE WHEN c.label <> e.label THEN c.n ELSE 0 END) AS n1 FROM embeddings e JOIN c ON abs(c.label - e.label) <= 1 GROUP BY e.vec_id),
 i AS (SELECT qid, unnest(range(1, 11)) AS rank, n2, n1 FROM t),
 d AS (SELECT qid, sum(grade / log2(rank + 1)) AS dcg FROM g WHERE rank <= 10 GROUP BY qid), m AS (SELECT qid, sum(CASE WHEN rank <= n2 THEN 2 WHEN rank <= n2 + n1 THEN 1 ELSE 0 END / log2(rank + 1)) AS best FROM i GROUP BY qid)
 SELECT 'ndcg@10' AS metric, round(avg(CASE WHEN best > 0 THEN dcg / best ELSE 0 END), 6) AS value FROM d JOIN m USING (qid)""")
def _(t):
    it = items(t)
    run = dense_run(t, 20)
    labelled = run.join(it.select(F.col("id").alias("qid"), F.col("label").alias("a")), "qid").join(it.select(F.col("id").alias("docid"), F.col("label").alias("b")), "docid")
    gap = F.abs(F.col("a") - F.col("b"))
    judged = labelled.select("qid", "docid", "rank", F.when(gap == 0, 2).when(gap == 1, 1).otherwise(0).alias("grade"))
    # labels follow from classes, so totals come from class sizes and not from pairs
    sizes = it.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    near = it.select(F.col("id").alias("qid"), F.col("label").alias("own"), F.explode(F.array(F.col("label") - 1, "label", F.col("label") + 1)).alias("label")).join(sizes, "label")
    grade, n = F.when(F.col("label") == F.col("own"), 2).otherwise(1), F.when(F.col("label") == F.col("own"), F.col("n") - 1).otherwise(F.col("n"))
    per = near.groupBy("qid", grade.alias("grade")).agg(F.sum(n).alias("n"))
    totals = per.groupBy("qid").agg(F.sum("n").alias("n_rel"), F.sort_array(F.collect_list(F.struct("grade", "n")), asc=False).alias("grades"))
    return E.mean_metrics(E.query_metrics(judged, totals, [10])).filter("metric = 'ndcg@10'")


@register("ndcg_deep", """WITH r AS (SELECT lang AS qid, doc_id AS docid, 1 + doc_id % 2 AS grade, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents),
 i AS (SELECT qid, grade, row_number() OVER (PARTITION BY qid ORDER BY grade DESC) AS rank FROM r),
 d AS (SELECT qid, sum(grade / log2(rank + 1)) AS dcg FROM r WHERE rank <= 3000 GROUP BY qid), m AS (SELECT qid, sum(grade / log2(rank + 1)) AS best FROM i WHERE rank <= 3000 GROUP BY qid)
 SELECT 'ndcg@3000' AS metric, round(avg(dcg / best), 6) AS value, true AS bounded FROM d JOIN m USING (qid)""")
def _(t):
    rows = t.documents.select(F.col("lang").alias("qid"), F.col("doc_id").alias("docid"), (F.lit(1) + F.pmod("doc_id", F.lit(2))).alias("grade"))
    run = R.top_k(rows.withColumn("score", -F.col("docid")), "qid", "score", None)
    out = E.mean_metrics(E.query_metrics(E.judge(run, rows), E.label_totals(rows), [3000])).filter("metric = 'ndcg@3000'")
    return out.withColumn("bounded", F.col("value") <= 1)


@register("rerank_map_mrr", f"""WITH {S.dense('run', 20)},
 j AS (SELECT r.qid, r.docid, r.rank, (a.label = b.label)::INT AS rel FROM run r JOIN embeddings a ON a.vec_id = r.qid JOIN embeddings b ON b.vec_id = r.docid),
 c AS (SELECT *, sum(rel) OVER (PARTITION BY qid ORDER BY rank) AS found FROM j),
 p AS (SELECT qid, sum(rel) AS pos, count(*) AS n, sum(CASE WHEN rel = 1 THEN found / rank END) AS prec, min(CASE WHEN rel = 1 AND rank <= 10 THEN rank END) AS first FROM c GROUP BY qid)
 SELECT count(*) AS n_queries, round(avg(prec / pos), 6) AS map, round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM p WHERE pos > 0 AND pos < n""")
def _(t):
    run = dense_run(t, 20)
    judged = E.judge_by_class(run, items(t)).withColumnRenamed("grade", "rel").drop("rank")
    return E.rerank_quality(judged.join(run.select("qid", "docid", "score"), ["qid", "docid"]))


@register("answer_recall", f"""WITH {S.bm25('run', 100)}, {S.QRELS},
 f AS (SELECT r.qid, min(r.rank) AS first FROM run r JOIN qrels q ON q.qid = r.qid AND q.docid = r.docid GROUP BY r.qid)
 SELECT {', '.join(f'round(avg(coalesce((first <= {k})::INT, 0)), 6) AS recall_{k}' for k in (1, 5, 10, 20, 100))} FROM benchmark LEFT JOIN f ON f.qid = item_id""")
def _(t):
    answers = t.topics.select("qid", F.array("query").alias("answers"))
    return E.answer_recall(bm25_run(t, 100), t.corpus, answers, (1, 5, 10, 20, 100))


EN = lambda c: NORM_EN.format(c=c)
ZH = lambda c: NORM_ZH.format(c=c)


@register("exact_match", f"WITH {PAIRS_SQL} SELECT conv_id, turn, {EN('pred')} = {EN('gold')} OR {EN('pred')} = {EN("(pred || '!')")} AS em FROM p")
def _(t):
    return turn_pairs(t).select("conv_id", "turn", Q.exact_match("pred", F.array("gold", F.concat("pred", F.lit("!")))).alias("em"))


def f1_sql(pred: str, gold: str, unit: str) -> str:
    return f"""pt AS (SELECT conv_id, turn, w, count(*) AS c FROM (SELECT conv_id, turn, unnest({unit.format(c=pred)}) AS w FROM p) WHERE w <> '' GROUP BY ALL),
 gt AS (SELECT conv_id, turn, w, count(*) AS c FROM (SELECT conv_id, turn, unnest({unit.format(c=gold)}) AS w FROM p) WHERE w <> '' GROUP BY ALL),
 s AS (SELECT pt.conv_id, pt.turn, sum(least(pt.c, gt.c)) AS same FROM pt JOIN gt USING (conv_id, turn, w) GROUP BY ALL),
 pn AS (SELECT conv_id, turn, sum(c) AS n FROM pt GROUP BY ALL), gn AS (SELECT conv_id, turn, sum(c) AS n FROM gt GROUP BY ALL)
 SELECT p.conv_id, p.turn, round(coalesce(2 * same::DOUBLE / (pn.n + gn.n)::DOUBLE, 0), 6) AS f1 FROM p LEFT JOIN s USING (conv_id, turn) LEFT JOIN pn USING (conv_id, turn) LEFT JOIN gn USING (conv_id, turn)"""


@register("token_f1", f"WITH {PAIRS_SQL}, " + f1_sql(EN("pred"), EN("gold"), "string_split({c}, ' ')"))
def _(t):
    return turn_pairs(t).select("conv_id", "turn", F.round(Q.f1_answer("pred", "gold"), 6).alias("f1"))


@register("character_f1", f"WITH {PAIRS_SQL}, " + f1_sql(ZH("pred"), ZH("gold"), "string_split({c}, '')"))
def _(t):
    return turn_pairs(t).select("conv_id", "turn", F.round(Q.f1_answer_zh("pred", "gold"), 6).alias("f1"))


W = r"list_filter(regexp_split_to_array({c}, '[\s\p{{Z}}]+'), lambda w: w <> '')"


@register("rouge_1_2", f"""WITH {PAIRS_SQL}, w AS (SELECT conv_id, turn, {W.format(c='pred')} AS a, {W.format(c='gold')} AS b FROM p),
 g AS (SELECT conv_id, turn, list_distinct(a) AS a1, list_distinct(b) AS b1, list_distinct(list_transform(range(1, greatest(len(a), 1)), lambda i: a[i] || ' ' || a[i + 1])) AS a2,
   list_distinct(list_transform(range(1, greatest(len(b), 1)), lambda i: b[i] || ' ' || b[i + 1])) AS b2 FROM w)
 SELECT conv_id, turn, round(CASE WHEN len(list_intersect(a1, b1)) = 0 THEN 0 ELSE 2.0e0 * len(list_intersect(a1, b1)) / (len(a1) + len(b1)) END, 6) AS rouge1,
   round(CASE WHEN len(list_intersect(a2, b2)) = 0 THEN 0 ELSE 2.0e0 * len(list_intersect(a2, b2)) / (len(a2) + len(b2)) END, 6) AS rouge2 FROM g""")
def _(t):
    p = turn_pairs(t).select("conv_id", "turn", words("pred").alias("a"), words("gold").alias("b"))
    return p.select("conv_id", "turn", F.round(Q.rouge_n(F.col("a"), F.col("b"), 1), 6).alias("rouge1"), F.round(Q.rouge_n(F.col("a"), F.col("b"), 2), 6).alias("rouge2"))


ROUGE_SQL = f"""WITH {PAIRS_SQL}, w AS (SELECT row_number() OVER () AS id, conv_id, turn, {W.format(c='pred')} AS a, {W.format(c='gold')} AS b FROM p), {S.lcs('l', 'w')}
 SELECT conv_id, turn, CASE WHEN len(a) + len(b) = 0 THEN 0 ELSE 2 * lcs / (len(a) + len(b)) END AS f1, CASE WHEN len(b) = 0 THEN 0 ELSE lcs / len(b) END AS recall FROM w JOIN l USING (id)"""


@register("rouge_l", f"SELECT conv_id, turn, round(f1, 6) AS f1, round(recall, 6) AS recall FROM ({ROUGE_SQL})")
def _(t):
    p = turn_pairs(t).select("conv_id", "turn", words("pred").alias("a"), words("gold").alias("b"))
    return p.select("conv_id", "turn", F.round(Q.rouge_l(F.col("a"), F.col("b")), 6).alias("f1"), F.round(Q.rouge_l(F.col("a"), F.col("b"), "r"), 6).alias("recall"))


PREDICTED = "c AS (SELECT quality AS label, (n_chars > 1500)::INT AS pred, toxic FROM documents JOIN labels USING (doc_id))"


def predicted(t):
    return t.documents.join(t.labels, "doc_id").select(F.col("quality").alias("label"), (F.col("n_chars") > 1500).cast("int").alias("pred"), "toxic", "doc_id", "n_chars", "source", "lang")


@register("accuracy_and_f1", f"WITH {PREDICTED} SELECT round(avg((pred = label)::INT), 6) AS accuracy, round(2.0e0 * count(*) FILTER (pred = 1 AND label = 1) / (count(*) FILTER (pred = 1) + count(*) FILTER (label = 1)), 6) AS f1 FROM c")
def _(t):
    return E.binary_f1(predicted(t), "pred", "label")


@register("judge_confusion", """WITH c AS (SELECT CASE WHEN n_chars > 5000 THEN NULL ELSE n_chars > 1500 END AS j, quality = 1 AS m FROM documents JOIN labels USING (doc_id))
 SELECT count(*) FILTER (j AND m) AS tt, count(*) FILTER (j AND NOT m) AS tf, count(*) FILTER (NOT j AND m) AS ft, count(*) FILTER (NOT j AND NOT m) AS ff,
  count(*) FILTER (j IS NULL) AS errors, round(count(*) FILTER (j = m) / count(*) FILTER (j IS NOT NULL), 6) AS agreement FROM c""")
def _(t):
    d = predicted(t).select(F.when(F.col("n_chars") <= 5000, F.col("n_chars") > 1500).alias("j"), (F.col("label") == 1).alias("m"))
    return E.judge_confusion(d, "j", "m")


@register("top_answer_accuracy", f"""WITH {S.bm25('run', 1)}, {S.QRELS} SELECT count(*) AS n, round(avg((q.docid IS NOT NULL)::INT), 6) AS accuracy
 FROM benchmark LEFT JOIN run r ON r.qid = item_id LEFT JOIN qrels q ON q.qid = r.qid AND q.docid = r.docid""")
def _(t):
    hits = E.judge(bm25_run(t, 1), E.phrase_matches(t.corpus, t.topics))
    every = t.topics.select("qid").join(hits, "qid", "left")
    return every.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce((F.col("grade") > 0).cast("double"), F.lit(0.0))), 6).alias("accuracy"))


@register("substring_accuracy", f"WITH {PAIRS_SQL}, a AS (SELECT pred, split_part(gold, ' ', 1) AS x FROM p) SELECT count(*) AS n, round(avg((contains(pred, x) OR contains(pred, lower(x)) OR contains(pred, upper(x[1:1]) || lower(x[2:])))::INT), 6) AS accuracy FROM a")
def _(t):
    p = turn_pairs(t).withColumn("x", F.split("gold", " ")[0])
    return p.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(Q.substring_match("pred", F.array("x")).cast("double")), 6).alias("accuracy"))


CATEGORY = {"en": "germanic", "de": "germanic", "fr": "romance", "es": "romance"}


def choice_sql(order: str) -> str:
    return f"""WITH o AS (SELECT doc_id AS question, lang AS subject, quality * 2 + toxic AS answer, unnest([0, 1, 2, 3]) AS option, n_chars FROM documents JOIN labels USING (doc_id)),
 s AS (SELECT *, abs(option * 1000 - n_chars) AS score FROM o), p AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score {order}, option) AS r FROM s),
 a AS (SELECT subject, avg((option = answer)::INT) AS acc FROM p WHERE r = 1 GROUP BY subject)
 SELECT CASE WHEN subject IN ('en', 'de') THEN 'germanic' ELSE 'romance' END AS category, round(avg(acc), 6) AS accuracy FROM a GROUP BY 1 UNION ALL SELECT 'all', round(avg(acc), 6) FROM a"""


def choices(t):
    d = predicted(t).select(F.col("doc_id").alias("question"), F.col("lang").alias("subject"), (F.col("label") * 2 + F.col("toxic")).alias("answer"),
                            "n_chars", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("option"))
    return d.withColumn("score", F.abs(F.col("option") * 1000 - F.col("n_chars")))


@register("choice_accuracy", choice_sql("DESC"))
def _(t):
    return E.choice_accuracy(choices(t), CATEGORY)


@register("choice_accuracy_by_perplexity", choice_sql("ASC"))
def _(t):
    return E.choice_accuracy(choices(t), CATEGORY, lower_is_better=True)


@register("perplexity", """WITH w AS (SELECT conv_id AS doc, length(text) / 1000 AS loss, len(string_split(text, ' ')) AS n FROM conversations), d AS (SELECT doc, sum(loss * n) / sum(n) AS nll FROM w GROUP BY doc)
 SELECT count(*) AS n_docs, round(exp(avg(nll)), 6) AS perplexity FROM d""")
def _(t):
    return E.perplexity(t.conversations.select(F.col("conv_id").alias("doc"), (F.length("text") / 1000).alias("loss"), F.size(space_tokens("text")).alias("n")))


DATASETS = {"user": "hotpotqa", "assistant": "qasper", "system": "triviaqa"}


@register("dataset_scores", f"""WITH p AS (SELECT a.conv_id, a.turn, CASE WHEN a.role = 'system' THEN split_part(a.text, chr(10), 1) ELSE a.text END AS pred, b.text AS gold, a.role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
 f AS (SELECT * FROM (WITH {f1_sql(EN('pred'), EN('gold'), "string_split({c}, ' ')")})),
 s AS (SELECT CASE role WHEN 'user' THEN 'hotpotqa' WHEN 'assistant' THEN 'qasper' ELSE 'triviaqa' END AS dataset, f1 FROM p JOIN f USING (conv_id, turn)),
 d AS (SELECT dataset, round(100 * avg(f1), 2) AS value FROM s GROUP BY dataset)
 SELECT 'dataset' AS level, dataset AS name, value FROM d UNION ALL
 SELECT 'category', CASE dataset WHEN 'hotpotqa' THEN 'EN Multi-Doc QA' WHEN 'qasper' THEN 'EN Single-Doc QA' ELSE 'EN Few-Shot Learning' END, round(avg(value), 2) FROM d GROUP BY 2 UNION ALL
 SELECT 'overall', 'all', round(avg(value), 2) FROM d""")
def _(t):
    roles = t.conversations.select("conv_id", "turn", "role")
    p = turn_pairs(t).join(roles, ["conv_id", "turn"]).withColumn("dataset", F.element_at(E.literal_map(DATASETS), F.col("role")))
    pred = F.when(F.col("dataset").isin(*E.FIRST_LINE_DATASETS), first_line("pred")).otherwise(F.col("pred"))
    return E.dataset_scores(p.select("dataset", E.f1_over_answers(pred, F.array("gold")).alias("score")))


CODE_LINE = "coalesce(list_filter(string_split(regexp_replace(pred, '^\\n+', ''), chr(10)), lambda x: NOT (contains(x, '`') OR contains(x, '#') OR contains(x, '//')))[1], '')"
RATIO = "CASE WHEN len(a) + len(b) = 0 THEN 1 ELSE round(200.0e0 * lcs / (len(a) + len(b))) / 100 END"
LETTERS = "list_filter(string_split({c}, ''), lambda c: c <> '')"
# every dataset with a metric, in the order of their names
SCORED = sorted(d for d, kind in E.DATASET_METRIC.items() if kind in E.METRICS)
NAMES_SQL = "[" + ", ".join(f"'{d}'" for d in SCORED) + "]"
CLASSES = ("the", "he", "der", "de", "tion", "on", "la")


def in_sql(kind: str) -> str:
    return "dataset IN (" + ", ".join(f"'{d}'" for d, k in E.DATASET_METRIC.items() if k == kind) + ")"


@register("dataset_report", f"""WITH {PAIRS_SQL.replace("a.text AS pred", "a.text || ' ' || a.turn || ' ' || a.conv_id % 3 AS pred")},
 base AS (SELECT row_number() OVER () AS id, conv_id, turn, gold, len(string_split(gold, ' ')) * 100 AS length, {NAMES_SQL}[1 + (conv_id * 31 + turn) % {len(SCORED)}] AS dataset, pred FROM p),
 cut1 AS (SELECT * REPLACE (CASE WHEN dataset IN ('trec', 'triviaqa', 'samsum', 'lsht') THEN split_part(ltrim(pred, chr(10)), chr(10), 1) ELSE pred END AS pred) FROM base),
 en AS (SELECT id AS conv_id, 0 AS turn, {EN('pred')} AS a, {EN('gold')} AS b FROM cut1 WHERE {in_sql('f1')}), zh AS (SELECT id AS conv_id, 0 AS turn, {ZH('pred')} AS a, {ZH('gold')} AS b FROM cut1 WHERE {in_sql('f1_zh')}),
 f_en AS (SELECT * FROM (WITH p AS (SELECT * FROM en), {f1_sql('a', 'b', "string_split({c}, ' ')")})), f_zh AS (SELECT * FROM (WITH p AS (SELECT * FROM zh), {f1_sql('a', 'b', "string_split({c}, '')")})),
 toks AS (SELECT id, {W.format(c='pred')} AS a, {W.format(c='gold')} AS b FROM cut1 WHERE {in_sql('rouge')} UNION ALL
   SELECT id, list_filter(string_split(pred, ''), lambda c: trim(c) <> ''), list_filter(string_split(gold, ''), lambda c: trim(c) <> '') FROM cut1 WHERE {in_sql('rouge_zh')} UNION ALL
   SELECT id, {LETTERS.format(c=CODE_LINE)}, {LETTERS.format(c='gold')} FROM cut1 WHERE {in_sql('code')}), {S.lcs('l', 'toks')},
 num AS (SELECT id, dataset, regexp_extract_all(pred, '[0-9]+') AS x, (conv_id % 3)::VARCHAR AS y, CASE turn % 3 WHEN 0 THEN 'the' WHEN 1 THEN 'der' ELSE 'tion' END AS truth, pred FROM cut1),
 cl AS (SELECT id, truth, list_filter({list(CLASSES)}, lambda x: contains(pred, x) AND NOT (contains(truth, x) AND x <> truth)) AS found FROM num WHERE {in_sql('class')}),
 s AS (SELECT conv_id AS id, f1 AS score FROM f_en UNION ALL SELECT conv_id, f1 FROM f_zh UNION ALL SELECT id, CASE WHEN {in_sql('code')} THEN {RATIO} WHEN len(a) + len(b) = 0 THEN 0 ELSE 2 * lcs / (len(a) + len(b)) END FROM toks JOIN l USING (id) JOIN cut1 USING (id)
   UNION ALL SELECT id, CASE WHEN list_contains(found, truth) THEN 1 / len(found) ELSE 0 END FROM cl
   UNION ALL SELECT id, CASE WHEN len(x) = 0 THEN 0 ELSE len(list_filter(x, lambda v: v = y)) / len(x) END FROM num WHERE {in_sql('number')} OR {in_sql('paragraph')} OR {in_sql('paragraph_zh')}),
 g AS (SELECT dataset, CASE WHEN length < 4000 THEN '0-4k' WHEN length < 8000 THEN '4-8k' ELSE '8k+' END AS bucket, round(score, 6) AS score FROM cut1 JOIN s USING (id)),
 d AS (SELECT dataset, count(*) AS n, round(100 * avg(score), 2) AS value FROM g GROUP BY dataset)
 SELECT 'dataset' AS level, dataset AS name, NULL AS bucket, n, value FROM d UNION ALL SELECT 'length', dataset, bucket, count(*), round(100 * avg(score), 2) FROM g GROUP BY dataset, bucket
 UNION ALL SELECT 'category', c.category, NULL, sum(n)::BIGINT, ((2 * sum(round(100 * value)::BIGINT)::BIGINT + count(*)) // (2 * count(*))) / 100 FROM d JOIN (VALUES {', '.join(f"('{k}', '{v}')" for k, v in E.DATASET_CATEGORY.items())}) c(dataset, category) USING (dataset) GROUP BY c.category
 UNION ALL SELECT 'overall', 'all', NULL, sum(n)::BIGINT, ((2 * sum(round(100 * value)::BIGINT)::BIGINT + count(*)) // (2 * count(*))) / 100 FROM d""")
def _(t):
    p = turn_pairs(t).withColumn("pred", F.concat_ws(" ", "pred", "turn", F.col("conv_id") % 3))
    dataset = F.element_at(F.array(*[F.lit(d) for d in SCORED]), (1 + (F.col("conv_id") * 31 + F.col("turn")) % len(SCORED)).cast("int"))
    p = p.withColumns({"dataset": dataset, "kind": F.element_at(E.literal_map(E.DATASET_METRIC), dataset)})
    number = (F.col("conv_id") % 3).cast("string")
    truth = (F.when(F.col("kind") == "class", F.when(F.col("turn") % 3 == 0, "the").when(F.col("turn") % 3 == 1, "der").otherwise("tion"))
             .when(F.col("kind") == "number", number).when(F.col("kind") == "paragraph", F.concat(F.lit("Paragraph "), number))
             .when(F.col("kind") == "paragraph_zh", F.concat(F.lit("段落"), number)).otherwise(F.col("gold")))
    classes = F.array(*[F.lit(c) for c in CLASSES])
    return E.dataset_report(p.select("dataset", F.col("pred").alias("prediction"), F.array(truth).alias("answers"), classes.alias("classes"), (F.size(F.split("gold", " ")) * 100).alias("length")))


@register("dataset_scores_by_length", """WITH s AS (SELECT lang AS dataset, CASE WHEN len(string_split(text, ' ')) < 4000 THEN '0-4k' WHEN len(string_split(text, ' ')) < 8000 THEN '4-8k' ELSE '8k+' END AS bucket, quality FROM documents JOIN labels USING (doc_id))
 SELECT dataset, bucket, round(100 * avg(quality), 2) AS value FROM s GROUP BY dataset, bucket""")
def _(t):
    n = F.size(space_tokens("text"))
    d = t.documents.join(t.labels, "doc_id").select(F.col("lang").alias("dataset"), F.when(n < 4000, "0-4k").when(n < 8000, "4-8k").otherwise("8k+").alias("bucket"), "quality")
    return d.groupBy("dataset", "bucket").agg(F.round(100 * F.avg("quality"), 2).alias("value"))


@register("number_share", """WITH n AS (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS x FROM documents)
 SELECT doc_id, round(CASE WHEN len(x) = 0 THEN 0 ELSE len(list_filter(x, lambda y: y = x[1])) / len(x) END, 6) AS share, round(CASE WHEN len(x) = 0 THEN 0 ELSE len(list_filter(x, lambda y: y = x[-1])) / len(x) END, 6) AS paragraph FROM n""")
def _(t):
    last = F.coalesce(F.element_at(integers("text"), -1), F.lit(""))
    d = t.documents.withColumn("last", F.when(F.size(integers("text")) > 0, last))
    return d.select("doc_id", F.round(Q.number_share("text", first_integer("text")), 6).alias("share"),
                    F.round(F.coalesce(Q.paragraph_share("text", F.concat(F.lit("Paragraph "), "last")), F.lit(0.0)), 6).alias("paragraph"))


@register("class_score", """WITH c AS (SELECT doc_id, text, CASE lang WHEN 'en' THEN 'the' WHEN 'de' THEN 'der' ELSE 'tion' END AS truth FROM documents),
 f AS (SELECT doc_id, truth, list_filter(['the', 'he', 'der', 'de', 'tion', 'on', 'la'], lambda x: contains(text, x) AND NOT (contains(truth, x) AND x <> truth)) AS found FROM c)
 SELECT doc_id, round(CASE WHEN list_contains(found, truth) THEN 1 / len(found) ELSE 0 END, 6) AS score FROM f""")
def _(t):
    truth = F.when(F.col("lang") == "en", "the").when(F.col("lang") == "de", "der").otherwise("tion")
    classes = F.array(*[F.lit(c) for c in ("the", "he", "der", "de", "tion", "on", "la")])
    return t.documents.select("doc_id", F.round(Q.class_score("text", truth, classes), 6).alias("score"))


TASKS = ("kv_retrieval", "passkey", "longdialogue_qa_eng", "math_find", "math_calc", "longbook_qa_eng")


@register("task_scores", rf"""WITH {PAIRS_SQL}, {f1_sql(EN('pred'), EN('gold'), "string_split({c}, ' ')").replace(" SELECT p.conv_id", ", f AS (SELECT p.conv_id", 1)}),
 q AS (SELECT conv_id, turn, pred, split_part(gold, ' ', 1) AS w, regexp_extract(gold, '[0-9]+') AS num, regexp_extract_all(gold, '[0-9]+') AS gn, regexp_extract_all(pred, '[0-9]+') AS pn,
   regexp_split_to_array(regexp_replace(pred, '[\n:"''.,?!{{}}]', ' ', 'g'), '[\s\p{{Z}}]+') AS pw FROM p)
 SELECT 'kv_retrieval' AS task, count(*) AS n, round(avg(list_contains(pw, w)::INT), 6) AS score FROM q UNION ALL
 SELECT 'passkey', count(*), round(avg((regexp_extract(pred, '[0-9]+') = num)::INT), 6) FROM q UNION ALL
 SELECT 'longdialogue_qa_eng', count(*), round(avg(list_contains(list_transform(pw, lambda x: upper(x)), upper(w))::INT), 6) FROM q UNION ALL
 SELECT 'math_find', count(*), round(avg(coalesce((try_cast(regexp_extract(pred, '[0-9]+\.[0-9]+|[0-9]+') AS DOUBLE) = try_cast(num AS DOUBLE))::INT, 0)), 6) FROM q UNION ALL
 SELECT 'longbook_qa_eng', count(*), round(avg(f1), 6) FROM f""")
def _(t):
    p = turn_pairs(t)
    w, num = F.split("gold", " ")[0], first_integer("gold")
    label = {"kv_retrieval": w, "passkey": num, "longdialogue_qa_eng": F.upper(w), "math_find": num, "longbook_qa_eng": F.col("gold")}
    rows = p.select("conv_id", "turn", "pred", F.explode(F.array(*[
        F.struct(F.lit(name).alias("task"), F.array(value).alias("labels")) for name, value in label.items()])).alias("x"))
    scored = rows.select("x.task", Q.task_score("x.task", "pred", "x.labels").alias("score"))
    return scored.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.round("score", 6)), 6).alias("score"))


@register("task_scores_coded")
def _(t):
    p = turn_pairs(t)
    letter = F.upper(F.substring("gold", 1, 1))
    label = {"code_run": F.array(first_integer("gold")), "code_debug": F.array(F.split("gold", " ")[0], letter), "math_calc": integers("gold"),
             "longbook_choice_eng": F.array(letter), "longbook_qa_chn": F.array("gold")}
    rows = p.select("pred", F.explode(F.array(*[F.struct(F.lit(n).alias("task"), v.alias("labels")) for n, v in label.items()])).alias("x"))
    return rows.select("x.task", Q.task_score("x.task", "pred", "x.labels").alias("score")).groupBy("task").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("score"))


@register("code_similarity", f"""WITH {PAIRS_SQL}, s AS (SELECT row_number() OVER () AS id, conv_id, turn, {LETTERS.format(c=CODE_LINE)} AS a, {LETTERS.format(c='gold')} AS b FROM p), {S.lcs('l', 's')}
 SELECT conv_id, turn, {RATIO} AS ratio FROM s JOIN l USING (id)""")
def _(t):
    return turn_pairs(t).select("conv_id", "turn", Q.edit_ratio(Q.code_line("pred"), F.col("gold")).alias("ratio"))


@register("score_grid", "SELECT lang, round(avg(CASE WHEN toxic = 0 THEN quality END), 6) AS d0, round(avg(CASE WHEN toxic = 1 THEN quality END), 6) AS d1 FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def _(t):
    return E.score_grid(t.documents.join(t.labels, "doc_id"), "lang", "toxic", "quality", [0, 1])


WHOLE = PAIRS_SQL.replace("b.text AS gold", "array_to_string(string_split(a.text, ' ')[2:3], ' ') || (CASE a.turn % 2 WHEN 0 THEN '' ELSE ' ' || b.text END) AS gold")


@register("topic_accuracy", f"""WITH {WHOLE}, {f1_sql(EN('pred'), EN('gold'), "string_split({c}, ' ')").replace(" SELECT p.conv_id", ", f AS (SELECT p.conv_id", 1)})
 SELECT turn AS num, floor(avg(length(pred)))::BIGINT AS length, round(avg(contains(lower(pred), lower(gold))::INT), 6) AS accuracy, round(avg(f1), 4) AS f1 FROM p JOIN f USING (conv_id, turn) GROUP BY turn""")
def _(t):
    target = F.concat(F.array_join(F.slice(F.split("pred", " "), 2, 2), " "), F.when(F.col("turn") % 2 == 0, "").otherwise(F.concat(F.lit(" "), "gold")))
    p = turn_pairs(t).select(F.col("turn").alias("num"), F.length("pred").alias("length"), target.alias("target"), F.col("pred").alias("prediction"))
    return E.topic_accuracy(p)


@register("language_average", f"WITH {PREDICTED.replace('SELECT quality', 'SELECT lang, quality')}, l AS (SELECT lang, round(avg((pred = label)::INT), 6) AS accuracy FROM c GROUP BY lang) SELECT * FROM l UNION ALL SELECT 'average', round(avg(accuracy), 6) FROM l")
def _(t):
    per = predicted(t).groupBy("lang").agg(F.round(F.avg((F.col("pred") == F.col("label")).cast("double")), 6).alias("accuracy"))
    return E.add_average(per, "lang", ["accuracy"])


def reward_sql(kind: str) -> str:
    gain = "1 / (ln(2 + {r}) / ln(3))" if kind == "absolute" else "1 / log10(9 + {r})"
    base = gain.format(r="15")
    final = f"least(greatest(round((r - {base}) / (1 - {base}), 3), 0), 1)" if kind == "absolute" else "least(greatest(round((r - o) * 10, 3), -2), 2)"
    return f"""WITH {S.bm25('a', 10)}, {S.bm25('b', 10, 0.82, 0.68, True)}, {S.QRELS}, n AS (SELECT qid, count(*) AS n FROM qrels GROUP BY qid),
 ha AS (SELECT qid, sum({gain.format(r='rank')}) AS o FROM a JOIN qrels USING (qid, docid) GROUP BY qid), hb AS (SELECT qid, sum({gain.format(r='rank')}) AS r FROM b JOIN qrels USING (qid, docid) GROUP BY qid),
 x AS (SELECT item_id AS qid, n, coalesce(o / n, {base}) AS o, coalesce(r / n, {base}) AS r FROM benchmark LEFT JOIN n ON n.qid = item_id LEFT JOIN ha ON ha.qid = item_id LEFT JOIN hb ON hb.qid = item_id)
 SELECT qid, CASE WHEN n IS NULL THEN 0 ELSE {final} END AS reward FROM x"""


for _kind in ("relative", "absolute"):
    @register(f"rewrite_reward_{_kind}", reward_sql(_kind))
    def _(t, kind=_kind):
        other = bm25_run(t, 10, k1=0.82, b=0.68, length_norm=True)
        return E.rewrite_reward(bm25_run(t), other, t.topics, E.phrase_matches(t.corpus, t.topics), 10, kind)


@register("rewrite_reward_mixed", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_reverse(embedding)::DOUBLE[] AS r, label FROM embeddings),
 sa AS (SELECT a.vec_id AS qid, b.vec_id AS docid, round(list_dot_product(a.e, b.e), 6) AS score FROM v a CROSS JOIN v b), a AS (""" + S.ranked("sa", 10) + """),
 sb AS (SELECT a.vec_id AS qid, b.vec_id AS docid, round(0.6e0 * list_dot_product(a.r, b.e) + 0.4e0 * list_dot_product(a.e, b.e), 6) AS score FROM v a CROSS JOIN v b), b AS (""" + S.ranked("sb", 10) + """),
 rel AS (SELECT a.vec_id AS qid, b.vec_id AS docid FROM v a JOIN v b ON a.label = b.label AND b.vec_id % 7 = 0), n AS (SELECT qid, count(*) AS n FROM rel GROUP BY qid),
 ha AS (SELECT qid, sum(1 / log10(9 + rank)) AS o FROM a JOIN rel USING (qid, docid) GROUP BY qid), hb AS (SELECT qid, sum(1 / log10(9 + rank)) AS r FROM b JOIN rel USING (qid, docid) GROUP BY qid)
 SELECT vec_id AS qid, CASE WHEN n.n IS NULL THEN 0 ELSE least(greatest(round((coalesce(hb.r / n.n, 1 / log10(24)) - coalesce(ha.o / n.n, 1 / log10(24))) * 10, 3), -2), 2) END AS reward FROM v LEFT JOIN n ON n.qid = vec_id LEFT JOIN ha ON ha.qid = vec_id LEFT JOIN hb ON hb.qid = vec_id""")
def _(t):
    side = t.embeddings.select("vec_id", "label")
    rel = E.ClassLabels(side.withColumnRenamed("vec_id", "qid"), side.filter("vec_id % 7 = 0").withColumnRenamed("vec_id", "docid"))
    rewritten = t.vec_queries.select("qid", F.reverse("embedding").alias("embedding"))
    return E.mixed_rewrite_reward(t.vec_queries, rewritten, t.vec_corpus, t.vec_queries.select("qid", F.lit("q").alias("query")), rel, 0.6, 10)


PAIR_SCORES = S.dense("run", 20) + ", s AS (SELECT r.score, (a.label = b.label)::INT AS gold FROM run r JOIN embeddings a ON a.vec_id = r.qid JOIN embeddings b ON b.vec_id = r.docid)"


def scored_pairs(t):
    run = dense_run(t, 20)
    return E.judge_by_class(run, items(t)).join(run.select("qid", "docid", "score"), ["qid", "docid"]).select("score", F.col("grade").alias("gold"))


@register("similarity_spearman", f"""WITH {PAIR_SCORES}, r AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS x, rank() OVER (ORDER BY gold) + (count(*) OVER (PARTITION BY gold) - 1) / 2 AS y FROM s)
 SELECT count(*) AS n, round(corr(x, y), 6) AS spearman FROM r""")
def _(t):
    return E.spearman(scored_pairs(t), "score", "gold")


@register("pair_average_precision", f"""WITH {PAIR_SCORES}, g AS (SELECT score, sum(gold) AS pos, count(*) AS n FROM s GROUP BY score),
 c AS (SELECT pos, sum(pos) OVER (ORDER BY score DESC) AS hits, sum(n) OVER (ORDER BY score DESC) AS seen FROM g) SELECT round((sum(pos * hits / seen) / sum(pos))::DOUBLE, 6) AS average_precision FROM c""")
def _(t):
    return E.average_precision(scored_pairs(t), "score", "gold")


@register("v_measure", """WITH d AS (SELECT lang AS l, source AS k FROM documents), c AS (SELECT l, k, count(*) AS c FROM d GROUP BY l, k), a AS (SELECT l, sum(c)::DOUBLE AS a FROM c GROUP BY l), b AS (SELECT k, sum(c)::DOUBLE AS b FROM c GROUP BY k),
 n AS (SELECT sum(c)::DOUBLE AS n FROM c), x AS (SELECT sum(-c / n * ln(c / b)) AS lk, sum(-c / n * ln(c / a)) AS kl FROM c JOIN a USING (l) JOIN b USING (k), n),
 hl AS (SELECT sum(-a / n * ln(a / n)) AS hl FROM a, n), hk AS (SELECT sum(-b / n * ln(b / n)) AS hk FROM b, n), r AS (SELECT 1 - lk / hl AS h, 1 - kl / hk AS c FROM x, hl, hk)
 SELECT round(h, 6) AS homogeneity, round(c, 6) AS completeness, round(2 * h * c / (h + c), 6) AS v_measure FROM r""")
def _(t):
    return E.v_measure(t.documents, "lang", "source")


@register("cluster_quality")
def _(t):
    return E.cluster_quality(t.embeddings, "label", 10)


@register("probe_accuracy")
def _(t):
    from seekwell.sources.files import split_by_ratio

    parts = split_by_ratio(t.embeddings, "vec_id", 0.25)
    return E.probe_accuracy(parts.filter("split = 'train'"), parts.filter("split = 'test'"), "label")


BOARD = """r AS (SELECT source AS model, CASE WHEN lang = 'es' THEN 'CQADupstackEs' WHEN lang = 'fr' THEN 'CQADupstackFr' ELSE lang END AS task, avg(quality) AS value FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2),
 m AS (SELECT model, CASE WHEN task LIKE 'CQADupstack%' THEN 'CQADupstack' ELSE task END AS task, round(round(avg(round(value * 100, 2)), 6), 2) AS value FROM r GROUP BY 1, 2),
 w AS (SELECT model, max(CASE WHEN task = 'en' THEN value END) AS en, max(CASE WHEN task = 'de' THEN value END) AS de, max(CASE WHEN task = 'CQADupstack' THEN value END) AS "CQADupstack" FROM m GROUP BY model),
 b AS (SELECT *, round(round((en + de + "CQADupstack") / 3, 6), 2) AS average FROM w)"""


def board(t):
    task = F.when(F.col("lang") == "es", "CQADupstackEs").when(F.col("lang") == "fr", "CQADupstackFr").otherwise(F.col("lang"))
    r = predicted(t).groupBy(F.col("source").alias("model"), task.alias("task")).agg(F.avg("label").alias("value"))
    return E.leaderboard(r, ["en", "de", "CQADupstack"])


@register("leaderboard", f"WITH {BOARD} SELECT * FROM b")
def _(t):
    return board(t)


@register("leaderboard_markdown", f"""WITH {BOARD} SELECT model, '| ' || model || ' | ' || coalesce(en::VARCHAR, ' ') || ' | ' || coalesce(de::VARCHAR, ' ') || ' | ' || coalesce("CQADupstack"::VARCHAR, ' ') || ' | ' || coalesce(average::VARCHAR, ' ') || ' |' AS line FROM b""")
def _(t):
    return E.markdown_rows(board(t))


BOARD_TASKS = {"Quality": ["en", "de", "CQADupstack"], "Length": ["en-long", "de-long", "fr-long"]}


def board_rows(t):
    kind = predicted(t).withColumn("long", (F.col("n_chars") > 1500).cast("int"))
    task = F.when(F.col("lang") == "es", "CQADupstackEs").when(F.col("lang") == "fr", "CQADupstackFr").otherwise(F.col("lang"))
    quality = kind.groupBy(F.col("source").alias("model"), task.alias("task")).agg(F.avg("label").alias("value")).withColumn("type", F.lit("Quality"))
    length = kind.groupBy(F.col("source").alias("model"), F.concat("lang", F.lit("-long")).alias("task")).agg(F.avg("long").alias("value")).withColumn("type", F.lit("Length"))
    return stack(quality, length)


BOARDS_SQL = """k AS (SELECT source AS model, lang, quality, (n_chars > 1500)::INT AS long FROM documents JOIN labels USING (doc_id)),
 r AS (SELECT 'Quality' AS type, model, CASE WHEN lang IN ('es', 'fr') THEN 'CQADupstack' ELSE lang END AS task, round(avg(quality) * 100, 2) AS value FROM k GROUP BY model, lang
   UNION ALL SELECT 'Length', model, lang || '-long', round(avg(long) * 100, 2) FROM k WHERE lang <> 'es' GROUP BY model, lang),
 m AS (SELECT type, model, task, round(round(avg(value), 6), 2) AS value FROM r GROUP BY type, model, task),
 c AS (SELECT type, model, sum(round(100 * value)::BIGINT)::BIGINT AS total, count(*) AS n FROM m GROUP BY type, model HAVING count(*) = 3),
 boards AS (SELECT type AS board, model, task AS name, value FROM m UNION ALL SELECT type, model, 'Avg', ((2 * total + n) // (2 * n)) / 100 FROM c
   UNION ALL SELECT 'Overall', model, type, ((2 * total + n) // (2 * n)) / 100 FROM c UNION ALL SELECT 'Overall', model, 'Avg', ((2 * sum(total)::BIGINT + sum(n)::BIGINT) // (2 * sum(n)::BIGINT)) / 100 FROM c GROUP BY model)"""


@register("leaderboards", f"WITH {BOARDS_SQL} SELECT * FROM boards")
def _(t):
    return E.leaderboards(board_rows(t), BOARD_TASKS)


def lines_sql() -> str:
    parts = []
    for board, names in {**BOARD_TASKS, "Overall": list(BOARD_TASKS)}.items():
        title = "Overall" if board == "Overall" else f"Task Type: {board}"
        parts += [f"SELECT '{board}' AS board, 0 AS number, '{title}' AS line", f"SELECT '{board}', 1, '| Model | {' | '.join(names)} | Avg |'", f"SELECT '{board}', 2, '|:---|{':---:|' * (len(names) + 1)}'"]
        cells = " || ' | ' || ".join(f"coalesce(max(CASE WHEN name = '{n}' THEN value END)::VARCHAR, ' ')" for n in [*names, "Avg"])
        parts.append(f"SELECT '{board}', (row_number() OVER (ORDER BY x.model) + 2)::INT, '| ' || x.model || ' | ' || {cells} || ' |' FROM (SELECT DISTINCT model FROM boards) x LEFT JOIN boards b ON b.model = x.model AND b.board = '{board}' GROUP BY x.model")
    return f"WITH {BOARDS_SQL} " + " UNION ALL ".join(parts)


@register("leaderboard_lines", lines_sql())
def _(t):
    return E.leaderboard_lines(E.leaderboards(board_rows(t), BOARD_TASKS), BOARD_TASKS)
