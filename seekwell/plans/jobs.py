"""End-to-end question-answering jobs over batches of questions."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.sql import Column, DataFrame, functions as F

from seekwell.operators import dense as D, evaluation as E, fusion as X, lexical as L, training as H
from seekwell.operators.hooks import generate
from seekwell.operators.ranking import top_k
from seekwell.operators.vector_lists import VectorLists
from seekwell.scale import cut, stack
from seekwell.sources.files import INTENTS

# The two verdicts of the judge.
ANSWERED, IRRELEVANT = "已解答", "不相关"
# Hybrid weight and context depth of the service.
ALPHA, CLAUSES = 0.3, 3


def judge_prompt(question: Column, matched: Column, answer: Column) -> Column:
    return F.concat(F.lit("问题：\n"), question, F.lit("\n参考问题：\n"), matched, F.lit("\n参考答案：\n"), answer)


def faq_match(questions: DataFrame, dense: DataFrame, sparse: DataFrame, faq: DataFrame, judge) -> DataFrame:
    """Best known question per question, judged.

    ``faq`` is ``(docid, question, answer)``. ``route`` is ``answered``, ``clauses`` (the
    judge found the match irrelevant, or there is no match) or ``unknown`` (any other verdict).
    """
    best = X.hybrid_search(dense, sparse, ALPHA, 1)
    rows = questions.join(best.select("qid", "docid"), "qid").join(faq, "docid")
    rows = rows.withColumn("prompt", judge_prompt(F.col("query"), F.col("question"), F.col("answer")))
    judged = generate(rows, "prompt", judge, out="verdict")
    route = F.when(F.col("verdict") == ANSWERED, "answered").when(F.col("verdict") == IRRELEVANT, "clauses").otherwise("unknown")
    judged = judged.select("qid", "docid", "question", "answer", route.alias("route"))
    return questions.select("qid").join(judged, "qid", "left").fillna("clauses", ["route"])


def faq_match_rerank(questions: DataFrame, dense: DataFrame, sparse: DataFrame, faq: DataFrame, scorer=X.overlap_score, k: int = 5) -> DataFrame:
    """Best of the ``k`` hybrid hits by a pair scorer."""
    hits = X.hybrid_search(dense, sparse, ALPHA, k).select("qid", "docid")
    rows = hits.join(questions, "qid").join(faq, "docid").withColumn("text", F.col("question"))
    return X.pair_rerank(rows, scorer, 1).select("qid", "docid", "question", "answer", "score")


def clause_search(questions: DataFrame, keywords, search, clauses: DataFrame, answer) -> DataFrame:
    """Keywords of the question, top clauses, one context prompt, answer.

    ``search`` maps ``(qid, query)`` to a run; ``keywords`` and ``answer`` are model factories.
    Questions without a clause are answered from an empty context. Each model is called once
    per question: the keywords are written before they are searched.
    """
    asked = cut(generate(questions, "query", keywords, out="keywords"), "keywords")
    run = search(asked.select("qid", F.col("keywords").alias("query")))
    top = run.filter(F.col("rank") <= CLAUSES).join(clauses.select("docid", "text"), "docid")
    context = top.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "docid", "text"))).alias("_c"))
    lines = F.transform("_c", lambda c: F.concat(F.lit("条款"), c["rank"].cast("string"), F.lit("：\n"), c["text"]))
    none = F.array().cast(dict(context.dtypes)["_c"])
    rows = questions.join(context, "qid", "left").withColumn("_c", F.coalesce("_c", none)).withColumn("prompt", F.concat(F.lit("问题：\n"), "query", F.lit("\n"), F.array_join(lines, "\n")))
    return generate(rows, "prompt", answer).select("qid", F.transform("_c", lambda c: c["docid"]).alias("docids"), "prompt", "answer")


def route_by_intent(df: DataFrame, probabilities: str) -> DataFrame:
    """Largest class probability decides between chat, consult and human."""
    p = F.col(probabilities)
    label = (F.array_position(p, F.array_max(p)) - 1).cast("int")
    names = F.create_map(*[F.lit(x) for kv in INTENTS.items() for x in kv])
    return df.withColumn("label", label).withColumn("route", F.element_at(names, F.col("label")))


def batch_retrieve(index: L.LexicalIndex | None, corpus_vectors: DataFrame | VectorLists | None, queries: DataFrame, k: int) -> DataFrame:
    """Run for text queries (an index) or vector queries (corpus vectors, or saved vector lists)."""
    if index is not None:
        return L.bm25_search(index, queries, k, k1=0.82, b=0.68, length_norm=True)
    if isinstance(corpus_vectors, VectorLists):
        return corpus_vectors.search(queries, k)
    return D.dense_search(queries, corpus_vectors, k)


def two_stage(index: L.LexicalIndex, topics: DataFrame, query_vectors: DataFrame, doc_vectors: DataFrame, n: int, k: int) -> DataFrame:
    """Lexical top ``n``, then dense order of the candidates."""
    first = L.bm25_search(index, topics, n, k1=0.82, b=0.68, length_norm=True)
    return X.dense_rerank(query_vectors, first, doc_vectors, k, digits=6)


def evaluate_and_collate(run: DataFrame, topics: DataFrame, corpus: DataFrame, qrels: DataFrame, ks, max_neg: int) -> dict[str, DataFrame]:
    """Metrics of a run and the training rows made from it."""
    return {
        "metrics": E.mean_metrics(E.query_metrics(E.judge(run, qrels), E.label_totals(qrels), ks)),
        "keys": H.collate_keys(topics, run, corpus),
        "negatives": H.collate_negatives(topics, run, corpus, qrels, max_neg),
    }


def intent_pipeline(features: int = 1 << 16) -> Pipeline:
    """Word hashes, inverse document frequency and multinomial logistic regression."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol="sentence", outputCol="_words", pattern=r"[\p{L}\p{N}]+|[^\s]", gaps=False),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="features"),
        LogisticRegression(labelCol="label", maxIter=30, regParam=0.01),
    ])


def evaluate_intents(rows: DataFrame) -> DataFrame:
    """Train on ``split = 'train'`` rows of ``(sentence, label, split)``, score the rest."""
    model = intent_pipeline().fit(rows.filter(F.col("split") == "train"))
    out = model.transform(rows.filter(F.col("split") == "test"))
    correct = (F.col("prediction") == F.col("label")).cast("double")
    per = out.groupBy(F.col("label").cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(correct), 6).alias("accuracy"))
    return stack(per, out.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(correct), 6).alias("accuracy")).withColumn("label", F.lit("all")))
