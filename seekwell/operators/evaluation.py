"""Ranking, answer, classification and leaderboard metrics."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seekwell.functions import scoring as Q
from seekwell.functions.scoring import best_of, f1_answer
from seekwell.functions.text import first_line, words
from seekwell.operators.phrases import phrase_matches
from seekwell.scale import cut, running_total, running_totals, stack, top_rows

# Metric and category of the long-context benchmark datasets.
DATASET_METRIC = {
    "narrativeqa": "f1", "qasper": "f1", "multifieldqa_en": "f1", "multifieldqa_zh": "f1_zh", "hotpotqa": "f1",
    "2wikimqa": "f1", "musique": "f1", "dureader": "rouge_zh", "gov_report": "rouge", "qmsum": "rouge",
    "multi_news": "rouge", "vcsum": "rouge_zh", "trec": "class", "triviaqa": "f1", "samsum": "rouge", "lsht": "class",
    "passage_retrieval_en": "paragraph", "passage_count": "number", "passage_retrieval_zh": "paragraph_zh",
    "lcc": "code", "repobench-p": "code",
}
DATASET_CATEGORY = {
    "narrativeqa": "EN Single-Doc QA", "qasper": "EN Single-Doc QA", "multifieldqa_en": "EN Single-Doc QA",
    "multifieldqa_zh": "CN Single-Doc QA", "hotpotqa": "EN Multi-Doc QA", "2wikimqa": "EN Multi-Doc QA",
    "musique": "EN Multi-Doc QA", "dureader": "CN Multi-Doc QA", "gov_report": "EN Summarization",
    "qmsum": "EN Summarization", "multi_news": "EN Summarization", "vcsum": "CN Summarization",
    "trec": "EN Few-Shot Learning", "triviaqa": "EN Few-Shot Learning", "samsum": "EN Few-Shot Learning",
    "lsht": "CN Few-Shot Learning", "passage_retrieval_en": "EN Synthetic Task", "passage_count": "EN Synthetic Task",
    "passage_retrieval_zh": "CN Synthetic Task", "lcc": "Code Completion", "repobench-p": "Code Completion",
}
# Datasets scored on the first line of the prediction only.
FIRST_LINE_DATASETS = ("trec", "triviaqa", "samsum", "lsht")


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def judge(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Run rows with the ``grade`` of the document, zero when unlabelled."""
    grade = F.col("grade") if "grade" in qrels.columns else F.lit(1)
    g = qrels.select("qid", "docid", grade.alias("grade")).groupBy("qid", "docid").agg(F.max("grade").alias("grade"))
    return run.select("qid", "docid", "rank").join(g, ["qid", "docid"], "left").fillna(0, ["grade"])


def judge_by_class(run: DataFrame, items: DataFrame) -> DataFrame:
    """Two items are relevant to each other when they share a class; joined to the run only."""
    q = items.select(F.col("id").alias("qid"), F.col("label").alias("_q"))
    d = items.select(F.col("id").alias("docid"), F.col("label").alias("_d"))
    return run.select("qid", "docid", "rank").join(q, "qid").join(d, "docid").select(
        "qid", "docid", "rank", (F.col("_q") == F.col("_d")).cast("int").alias("grade"))


def class_totals(items: DataFrame) -> DataFrame:
    """Number of relevant items per query: class size without the item itself."""
    size = items.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n_rel"))
    return items.join(size, "label").select(F.col("id").alias("qid"), "n_rel")


def label_totals(qrels: DataFrame) -> DataFrame:
    """Relevant documents per query and their number per grade, best grade first. Grades are
    few, so the list is short however many labels a query has."""
    grade = F.col("grade") if "grade" in qrels.columns else F.lit(1)
    pos = qrels.select("qid", "docid", grade.alias("grade")).filter(F.col("grade") > 0).distinct()
    each = pos.groupBy("qid", "grade").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("qid").agg(F.sum("n").alias("n_rel"), F.sort_array(F.collect_list(F.struct("grade", "n")), asc=False).alias("grades"))


def _discount(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + F.lit(1.0))


def query_metrics(judged: DataFrame, totals: DataFrame, ks) -> DataFrame:
    """Per-query ``mrr, recall, precision, map, ndcg`` at every cutoff, in one aggregate.

    ``totals`` has ``n_rel`` and, for graded labels, the numbers per grade.
    """
    hit = F.col("grade") > 0
    w = W.partitionBy("qid").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = judged.withColumn("_found", F.sum(hit.cast("int")).over(w))
    aggs = []
    for k in ks:
        top = hit & (F.col("rank") <= k)
        aggs += [
            F.min(F.when(top, F.col("rank"))).alias(f"_first_{k}"),
            F.count(F.when(top, 1)).alias(f"_hits_{k}"),
            F.coalesce(F.sum(F.when(top, F.col("_found") / F.col("rank"))), F.lit(0.0)).alias(f"_prec_{k}"),
            F.coalesce(F.sum(F.when(top, F.col("grade") * _discount(F.col("rank")))), F.lit(0.0)).alias(f"_dcg_{k}"),
        ]
    per = rows.groupBy("qid").agg(*aggs).join(totals, "qid", "left").fillna(0, ["n_rel"])
    n = F.col("n_rel")
    cols = [F.col("qid")]
    for k in ks:
        if "grades" in totals.columns:
            best = F.flatten(F.transform("grades", lambda g: F.array_repeat(g["grade"], F.least(g["n"], F.lit(k)).cast("int"))))
            grades = F.slice(F.coalesce(best, F.array().cast(f"array<{dict(totals.select(F.col('grades')[0]['grade'].alias('g')).dtypes)['g']}>")), 1, k)
        else:
            grades = F.array_repeat(F.lit(1), F.least(n, F.lit(k)).cast("int"))
        ideal = F.aggregate(F.transform(grades, lambda g, i: g * _discount(i + 1)), F.lit(0.0), lambda a, x: a + x)
        safe = lambda top, bottom: F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))
        cols += [
            F.coalesce(F.lit(1.0) / F.col(f"_first_{k}"), F.lit(0.0)).alias(f"mrr@{k}"),
            safe(F.col(f"_hits_{k}"), n).alias(f"recall@{k}"),
            (F.col(f"_hits_{k}") / F.lit(k)).alias(f"precision@{k}"),
            safe(F.col(f"_prec_{k}"), n).alias(f"map@{k}"),
            safe(F.col(f"_dcg_{k}"), ideal).alias(f"ndcg@{k}"),
        ]
    return per.select(*cols)


def mean_metrics(per_query: DataFrame, by: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Long table ``metric, value`` of the means over the queries of a run."""
    names = [c for c in per_query.columns if "@" in c]
    wide = per_query.groupBy(*(by or [])).agg(*[F.round(F.avg(f"`{c}`"), digits).alias(c) for c in names])
    return wide.unpivot(by or [], [f"`{c}`" for c in names], "metric", "value")


def add_average(per_language: DataFrame, by: str, values: list[str], digits: int = 6) -> DataFrame:
    """Rows per language and one ``average`` row: the mean of the language means."""
    mean = per_language.agg(*[F.round(F.avg(v), digits).alias(v) for v in values]).withColumn(by, F.lit("average"))
    return stack(per_language.select(by, *values), mean.select(by, *values))


def answer_recall(run: DataFrame, docs: DataFrame, answers: DataFrame, ks) -> DataFrame:
    """Share of questions with an answer inside the first ``k`` hits. Questions without
    hits count as misses, an answer without tokens is found nowhere.

    Only documents that are hits are tokenised, each once; the run is written once.
    """
    run = cut(run.select("qid", "docid", "rank"), "run")
    texts = docs.select("docid", "text").join(run.select("docid").distinct(), "docid", "left_semi")
    found = phrase_matches(texts, answers.select("qid", F.explode("answers").alias("query")))
    first = run.join(found.distinct(), ["qid", "docid"]).groupBy("qid").agg(F.min("rank").alias("first"))
    every = answers.select("qid").join(first, "qid", "left")
    return every.agg(*[F.round(F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))), 6).alias(f"recall_{k}") for k in ks])


def rerank_quality(scored: DataFrame, k: int = 10, by: str = "qid", item: str = "docid") -> DataFrame:
    """Mean AP and MRR@k over queries that have both relevant and other candidates.

    ``scored`` is ``(qid, docid, score, rel)``; with several rows per candidate (sub
    queries) the best score counts. The candidates of a query, a list as deep as the search
    that made it, are ranked in one window; queries are spread over the tasks.
    """
    best = scored.groupBy(by, item).agg(F.max("score").alias("score"), F.max("rel").alias("rel"))
    order = W.partitionBy(by).orderBy(F.col("score").desc(), F.col(item))
    rows = best.withColumns({"rank": F.row_number().over(order), "found": F.sum("rel").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))})
    per = rows.groupBy(by).agg(
        F.sum("rel").alias("pos"), F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("rel") == 1, F.col("found") / F.col("rank"))).alias("prec"),
        F.min(F.when((F.col("rel") == 1) & (F.col("rank") <= k), F.col("rank"))).alias("first"))
    both = per.filter((F.col("pos") > 0) & (F.col("pos") < F.col("n")))
    return both.agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg(F.col("prec") / F.col("pos")), 6).alias("map"),
                    F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def binary_f1(df: DataFrame, pred: str, label: str, positive="1") -> DataFrame:
    p, g = F.col(pred).cast("string") == positive, F.col(label).cast("string") == positive
    n = lambda c: F.count(F.when(c, 1))
    both = n(p & g)
    return df.agg(F.round(F.avg((F.col(pred) == F.col(label)).cast("double")), 6).alias("accuracy"),
                  F.round(F.when(both == 0, F.lit(0.0)).otherwise(2.0 * both / (n(p) + n(g))), 6).alias("f1"))


def judge_confusion(df: DataFrame, judge_col: str, match_col: str) -> DataFrame:
    """Counts of judge against truth and the agreement; rows without a verdict are errors."""
    j, m = F.col(judge_col), F.col(match_col)
    n = lambda c: F.count(F.when(c, 1))
    tt, tf, ft, ff = n(j & m), n(j & ~m), n(~j & m), n(~j & ~m)
    return df.agg(tt.alias("tt"), tf.alias("tf"), ft.alias("ft"), ff.alias("ff"), n(j.isNull()).alias("errors"),
                  F.round((tt + ff) / (tt + tf + ft + ff), 6).alias("agreement"))


def choice_accuracy(options: DataFrame, category: dict[str, str], lower_is_better: bool = False) -> DataFrame:
    """``(question, subject, option, score, answer)``: best option per question, accuracy per
    subject, mean of subjects per category and overall."""
    score = -F.col("score") if lower_is_better else F.col("score")
    picked = options.groupBy("subject", "question").agg(
        F.max_by("option", F.struct(score, -F.col("option"))).alias("pick"), F.max("answer").alias("answer"))
    subject = picked.groupBy("subject").agg(F.avg((F.col("pick") == F.col("answer")).cast("double")).alias("acc"))
    grouped = subject.withColumn("category", F.element_at(literal_map(category), F.col("subject")))
    per = grouped.groupBy("category").agg(F.round(F.avg("acc"), 6).alias("accuracy"))
    return stack(per, grouped.agg(F.round(F.avg("acc"), 6).alias("accuracy")).withColumn("category", F.lit("all")))


def perplexity(losses: DataFrame) -> DataFrame:
    """``(doc, loss, n)`` windows: token-weighted mean per document, mean over documents, exp."""
    per = losses.groupBy("doc").agg(F.try_divide(F.sum(F.col("loss") * F.col("n")), F.sum("n")).alias("nll"))
    return per.agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.exp(F.avg("nll")), 6).alias("perplexity"))


# Scorer of one answer by metric name: prediction, answer, class names.
METRICS = {
    "f1": lambda p, a, c: Q.f1_answer(p, a),
    "f1_zh": lambda p, a, c: Q.f1_answer_zh(p, a),
    "rouge": lambda p, a, c: Q.rouge_l(words(p), words(a)),
    "rouge_zh": lambda p, a, c: Q.rouge_l(Q.characters(p), Q.characters(a)),
    "class": lambda p, a, c: Q.class_score(p, a, c),
    "paragraph": lambda p, a, c: Q.paragraph_share(p, a),
    "paragraph_zh": lambda p, a, c: Q.paragraph_share(p, a, "zh"),
    "number": lambda p, a, c: Q.number_share(p, a),
    "code": lambda p, a, c: Q.edit_ratio(Q.code_line(p), a),
}
# Length buckets of the benchmark report, in tokens.
LENGTH_BUCKETS = {"0-4k": 4000, "4-8k": 8000, "8k+": None}


def dataset_score(dataset: Column, prediction: Column, answers: Column, classes: Column | None = None) -> Column:
    """Best score over ``answers`` by the metric of the row's dataset: one expression for all datasets, in which only the
    branch of the row's metric is evaluated. Null for a dataset without a metric here."""
    text = F.when(dataset.isin(*FIRST_LINE_DATASETS), first_line(prediction)).otherwise(prediction)
    names = F.coalesce(classes if classes is not None else F.lit(None).cast("array<string>"), F.array().cast("array<string>"))
    best = lambda metric: best_of(answers, lambda a: metric(text, a, names).cast("double"))
    out = F.lit(None).cast("double")
    for kind, metric in METRICS.items():
        out = F.when(dataset.isin(*[d for d, k in DATASET_METRIC.items() if k == kind]), best(metric)).otherwise(out)
    return out


def length_bucket(length: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, upper in reversed(LENGTH_BUCKETS.items()):
        out = F.lit(name) if upper is None else F.when(length < upper, name).otherwise(out)
    return out


def dataset_report(rows: DataFrame) -> DataFrame:
    """``(dataset, prediction, answers, classes, length)`` to ``(level, name, bucket, n, value)``.

    Percent per dataset and per dataset and length bucket from one aggregate, then the means of the datasets per category
    and overall.
    """
    scored = rows.select("dataset", length_bucket(F.col("length")).alias("bucket"),
                         dataset_score(F.col("dataset"), F.col("prediction"), F.col("answers"), F.col("classes")).alias("score")).filter("score is not null")
    ds, bucket = F.col("dataset"), F.col("bucket")
    per = scored.groupingSets([[ds], [ds, bucket]], ds, bucket).agg(F.grouping("bucket").alias("_all"), F.count(F.lit(1)).alias("n"), F.round(100 * F.avg("score"), 2).alias("value"))
    per = cut(per, "dataset-scores")
    whole = per.filter("_all = 1")
    part = lambda df, level, name: df.select(F.lit(level).alias("level"), name.alias("name"), F.lit(None).cast("string").alias("bucket"), "n", "value")
    # means of hundredths, so that ties are exact
    cents, count = F.sum(F.round(100 * F.col("value")).cast("long")), F.count(F.lit(1))
    mean = (F.floor((2 * cents + count) / (2 * count)) / 100).alias("value")
    category = whole.groupBy(F.element_at(literal_map(DATASET_CATEGORY), ds).alias("category")).agg(F.sum("n").alias("n"), mean)
    overall = whole.agg(F.sum("n").alias("n"), mean)
    return stack(part(whole, "dataset", ds), per.filter("_all = 0").select(F.lit("length").alias("level"), ds.alias("name"), "bucket", "n", "value"),
                 part(category, "category", F.col("category")), part(overall.filter("n > 0"), "overall", F.lit("all")))


def dataset_scores(scored: DataFrame) -> DataFrame:
    """``(dataset, score)`` rows: percent per dataset, mean per category, overall mean."""
    per = scored.groupBy("dataset").agg(F.round(100 * F.avg("score"), 2).alias("value"))
    cat = per.groupBy(F.element_at(literal_map(DATASET_CATEGORY), F.col("dataset")).alias("name")).agg(F.round(F.avg("value"), 2).alias("value"))
    return stack(per.select(F.lit("dataset").alias("level"), F.col("dataset").alias("name"), "value"),
                 cat.select(F.lit("category").alias("level"), "name", "value"),
                 per.agg(F.round(F.avg("value"), 2).alias("value")).select(F.lit("overall").alias("level"), F.lit("all").alias("name"), "value"))


def score_grid(df: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """Mean value by two conditions, one output column per known column value."""
    out = df.groupBy(row).pivot(column, columns).agg(F.round(F.avg(value), 6))
    return out.select(row, *[F.col(f"`{c}`").alias(f"d{c}") for c in columns])


def topic_accuracy(df: DataFrame) -> DataFrame:
    """``(num, length, target, prediction)``: substring accuracy and F1 per topic count."""
    hit = F.contains(F.lower("prediction"), F.lower("target")).cast("double")
    return df.groupBy("num").agg(F.floor(F.avg("length")).cast("long").alias("length"), F.round(F.avg(hit), 6).alias("accuracy"),
                                 F.round(F.avg(f1_answer("prediction", "target")), 4).alias("f1"))


@dataclass(frozen=True)
class ClassLabels:
    """Labels given by classes: a document is relevant to every query it shares a class with. ``queries`` is
    ``(qid, label)``, ``docs`` is ``(docid, label)``; a null class is shared with nothing. The pairs are never made, as a
    class of a tenth of both sides has a hundredth of all pairs."""

    queries: DataFrame
    docs: DataFrame

    def totals(self) -> DataFrame:
        """``(qid, n_rel)`` of the queries with a relevant document. Queries with the same classes, nearly always one, are
        counted together."""
        q = self.queries.filter("label is not null").groupBy("qid").agg(F.sort_array(F.collect_set("label")).alias("_set"))
        sets = q.select("_set").distinct().select("_set", F.explode("_set").alias("label"))
        n = self.docs.select("docid", "label").distinct().join(sets, "label").filter("docid is not null").select("_set", "docid").distinct()
        return q.join(n.groupBy("_set").agg(F.count(F.lit(1)).alias("n_rel")), "_set").select("qid", "n_rel")

    def hits(self, run: DataFrame) -> DataFrame:
        """The rows of ``run`` whose document is relevant."""
        pairs = run.select("qid", "docid").distinct().join(self.queries.select("qid", "label").distinct(), "qid")
        pairs = pairs.join(self.docs.select("docid", "label").distinct(), ["docid", "label"]).select("qid", "docid")
        return run.join(pairs, ["qid", "docid"], "left_semi")


def rewrite_reward(original: DataFrame, rewritten: DataFrame, queries: DataFrame, qrels: DataFrame | ClassLabels, k: int, kind: str = "relative") -> DataFrame:
    """Reward of a rewritten query from the ranking gain over the original.

    ``queries`` is ``(qid, query)``, ``qrels`` is ``(qid, docid)`` or classes. An empty query gets the lower clip, a query
    without labels zero.
    """
    if kind == "absolute":
        low, high = 0.0, 1.0
        gain = lambda r: F.lit(1.0) / F.log(3.0, F.lit(2) + r)
    elif kind in ("relative", "mixed_relative"):
        low, high = -2.0, 2.0
        gain = lambda r: F.lit(1.0) / F.log10(F.lit(9) + r)
    else:
        raise ValueError(f"unknown reward {kind!r}")
    base = gain(F.lit(int(1.5 * k)))
    if isinstance(qrels, ClassLabels):
        totals, relevant = qrels.totals(), qrels.hits
    else:
        labels = qrels.select("qid", "docid").distinct()
        totals, relevant = labels.groupBy("qid").agg(F.count(F.lit(1)).alias("n_rel")), lambda run: run.join(labels, ["qid", "docid"], "left_semi")
    hits = lambda run, out: relevant(run).groupBy("qid").agg(F.sum(gain(F.col("rank"))).alias(out))
    rows = (queries.join(totals, "qid", "left").join(hits(original, "o"), "qid", "left").join(hits(rewritten, "r"), "qid", "left"))
    o = F.coalesce(F.col("o") / F.col("n_rel"), base)
    r = F.coalesce(F.col("r") / F.col("n_rel"), base)
    raw = F.round((r - base) / (F.lit(1.0) - base), 3) if kind == "absolute" else F.round((r - o) * 10, 3)
    clipped = F.least(F.greatest(raw, F.lit(low)), F.lit(high))
    reward = F.when(F.col("n_rel").isNotNull(), clipped).when(F.col("query") == "", F.lit(low)).otherwise(F.lit(0.0))
    return rows.select("qid", reward.alias("reward"))


def mixed_rewrite_reward(original: DataFrame, rewritten: DataFrame, corpus: DataFrame, queries: DataFrame, qrels: DataFrame | ClassLabels, ratio: float, k: int) -> DataFrame:
    """Relative reward where the rewritten query is searched with ``ratio`` of its own vector and the rest of the original
    one. ``original`` and ``rewritten`` are ``(qid, embedding)``, ``corpus`` is ``(docid, embedding)``."""
    from seekwell.operators.dense import dense_search, mix_search

    return rewrite_reward(dense_search(original, corpus, k), mix_search(rewritten, original, corpus, ratio, k), queries, qrels, k, "mixed_relative")


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """``(value, average rank)``, ties share the mean. Equal values are grouped first, so a
    value that fills most of the table is one row of the running count."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    return running_total(counts, [], value, F.col("_n"), "_upto").select(
        value, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(out))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks for ties."""
    ranked = df.join(average_ranks(df, x, "_rx"), x).join(average_ranks(df, y, "_ry"), y)
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("_rx", "_ry"), 6).alias("spearman"))


def average_precision(df: DataFrame, score: str, rel: str) -> DataFrame:
    """Area under precision and recall steps at every distinct score."""
    steps = df.groupBy(F.col(score).alias("_s")).agg(F.sum(rel).alias("_pos"), F.count(F.lit(1)).alias("_n")).withColumn("_key", -F.col("_s"))
    both = running_totals(steps, [], "_key", {"_hits": F.col("_pos"), "_seen": F.col("_n")})
    return both.agg(F.round(F.sum(F.col("_pos") * F.col("_hits") / F.col("_seen")) / F.sum("_pos"), 6).alias("average_precision"))


def v_measure(df: DataFrame, label: str, cluster: str) -> DataFrame:
    """Homogeneity, completeness and their harmonic mean from two labelings; a missing label is
    a label of its own."""
    pair = df.select(F.col(label).alias("l"), F.col(cluster).alias("k"))
    cells = pair.groupBy("l", "k").agg(F.count(F.lit(1)).alias("c"))
    a = cells.groupBy("l").agg(F.sum("c").alias("a"))
    b = cells.groupBy("k").agg(F.sum("c").alias("b"))
    n = cells.agg(F.sum("c")).scalar()
    a_, b_ = a.withColumnRenamed("l", "_l"), b.withColumnRenamed("k", "_k")
    joined = cells.join(a_, F.col("l").eqNullSafe(F.col("_l"))).join(b_, F.col("k").eqNullSafe(F.col("_k"))).withColumn("n", n)
    cond = joined.agg(
        F.sum(-F.col("c") / F.col("n") * F.log(F.col("c") / F.col("b"))).alias("h_lc"),
        F.sum(-F.col("c") / F.col("n") * F.log(F.col("c") / F.col("a"))).alias("h_cl"))
    entropy = lambda t, col: t.withColumn("n", n).agg(F.sum(-F.col(col) / F.col("n") * F.log(F.col(col) / F.col("n")))).scalar()
    h = F.when(F.col("hl") == 0, F.lit(1.0)).otherwise(1 - F.col("h_lc") / F.col("hl"))
    c = F.when(F.col("hc") == 0, F.lit(1.0)).otherwise(1 - F.col("h_cl") / F.col("hc"))
    out = cond.withColumn("hl", entropy(a, "a")).withColumn("hc", entropy(b, "b")).select(h.alias("h"), c.alias("c"))
    return out.select(F.round("h", 6).alias("homogeneity"), F.round("c", 6).alias("completeness"),
                      F.round(F.when(F.col("h") + F.col("c") == 0, F.lit(0.0)).otherwise(2 * F.col("h") * F.col("c") / (F.col("h") + F.col("c"))), 6).alias("v_measure"))


def cluster_quality(vectors: DataFrame, label: str, k: int, seed: int = 42) -> DataFrame:
    """k-means on the vectors, compared with the labels."""
    data = vectors.select(label, array_to_vector("embedding").alias("features"))
    model = KMeans(k=k, seed=seed).fit(data)
    return v_measure(model.transform(data), label, "prediction")


def probe_accuracy(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Logistic regression on frozen vectors."""
    prep = lambda d: d.select(F.col(label).cast("double").alias("label"), array_to_vector("embedding").alias("features"))
    model = LogisticRegression(maxIter=100).fit(prep(train))
    out = model.transform(prep(test))
    return out.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("prediction") == F.col("label")).cast("double")), 6).alias("accuracy"))


# Fixed value: sub-forum tasks that are shown as one task.
MERGED_TASK = "CQADupstack"


def leaderboard(results: DataFrame, tasks: list[str]) -> DataFrame:
    """``(model, task, value)`` to one row per model in percent, with the average only when
    every task is present. Sub-forum tasks are averaged into one first."""
    name = F.when(F.col("task").startswith(MERGED_TASK), MERGED_TASK).otherwise(F.col("task"))
    pct = results.select("model", name.alias("task"), F.round(F.col("value") * 100, 2).alias("value"))
    merged = pct.groupBy("model", "task").agg(F.round(F.round(F.avg("value"), 6), 2).alias("value"))
    wide = merged.groupBy("model").pivot("task", tasks).agg(F.first("value"))
    have = sum((F.col(f"`{t}`").isNotNull().cast("int") for t in tasks), F.lit(0))
    total = sum((F.coalesce(F.col(f"`{t}`"), F.lit(0.0)) for t in tasks), F.lit(0.0))
    return wide.withColumn("average", F.when(have == len(tasks), F.round(F.round(total / len(tasks), 6), 2)))


def markdown_rows(board: DataFrame) -> DataFrame:
    """One markdown table line per model."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in board.columns]
    return board.select(board.columns[0], F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def leaderboards(results: DataFrame, tasks: dict[str, list[str]]) -> DataFrame:
    """``(type, task, model, value)`` to long tables ``(board, model, name, value)`` in percent.

    One board per task type has the tasks and ``Avg``, which needs every task of ``tasks[type]``. The board ``Overall`` has
    the average of each type that a model completed, and ``Avg`` over all tasks of those types. Sub-forum tasks are
    averaged into one first. Tasks, types and models come from one aggregate over grouping sets.
    """
    name = F.when(F.col("task").startswith(MERGED_TASK), MERGED_TASK).otherwise(F.col("task"))
    pct = results.select("type", "model", name.alias("task"), F.round(F.col("value") * 100, 2).alias("value"))
    known = reduce(Column.__or__, [(F.col("type") == t) & F.col("task").isin(*ts) for t, ts in tasks.items()])
    merged = pct.filter(known).groupBy("type", "model", "task").agg(F.round(F.round(F.avg("value"), 6), 2).alias("value"))
    t, m, k = F.col("type"), F.col("model"), F.col("task")
    sets = merged.groupingSets([[t, m, k], [t, m]], t, m, k).agg(F.grouping("task").alias("_all"), F.count(F.lit(1)).alias("n"), F.sum(F.round(100 * F.col("value")).cast("long")).alias("total"))
    sets = cut(sets, "board-sums")  # hundredths of percents, so that sums and ties are exact
    done = sets.filter((F.col("_all") == 1) & (F.col("n") == F.element_at(literal_map({x: len(ts) for x, ts in tasks.items()}), t)))
    mean = lambda total, n: F.floor((2 * total + n) / (2 * n)) / 100
    overall = done.groupBy("model").agg(mean(F.sum("total"), F.sum("n")).alias("value"))
    row = lambda df, board, label, value: df.select(board.alias("board"), "model", label.alias("name"), value.alias("value"))
    return stack(row(sets.filter("_all = 0"), t, k, F.col("total") / 100), row(done, t, F.lit("Avg"), mean(F.col("total"), F.col("n"))),
                 row(done, F.lit("Overall"), t, mean(F.col("total"), F.col("n"))), row(overall, F.lit("Overall"), F.lit("Avg"), F.col("value")))


def leaderboard_lines(boards: DataFrame, tasks: dict[str, list[str]]) -> DataFrame:
    """Markdown lines ``(board, number, line)`` of :func:`leaderboards`: title, header, rule, then one line per model that
    has results anywhere, by name; a missing value is a blank cell."""
    columns = {**tasks, "Overall": list(tasks)}
    spark = boards.sparkSession
    head = []
    for board, names in columns.items():
        title = "Overall" if board == "Overall" else f"Task Type: {board}"
        head += [(board, 0, title), (board, 1, "| Model | " + " | ".join([*names, "Avg"]) + " |"), (board, 2, "|:---|" + ":---:|" * (len(names) + 1))]
    cells = boards.groupBy("board", "model").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("cells"))  # one entry per task
    every = boards.select("model").distinct().select("model", F.explode(F.array(*[F.lit(b) for b in columns])).alias("board"))
    rows = every.join(cells, ["board", "model"], "left")
    none = F.create_map().cast("map<string,double>")
    line = F.lit(None).cast("string")
    for board, names in columns.items():
        values = [F.coalesce(F.try_element_at(F.coalesce("cells", none), F.lit(n)).cast("string"), F.lit(" ")) for n in [*names, "Avg"]]
        line = F.when(F.col("board") == board, F.concat(F.lit("| "), F.concat_ws(" | ", "model", *values), F.lit(" |"))).otherwise(line)
    number = F.row_number().over(W.partitionBy("board").orderBy("model")) + 2  # a board has as many rows as models were tested
    return stack(spark.createDataFrame(head, "board string, number int, line string"), rows.select("board", number.alias("number"), line.alias("line")))


def f1_over_answers(pred, answers) -> Column:
    return best_of(answers, lambda a: f1_answer(pred, a))
