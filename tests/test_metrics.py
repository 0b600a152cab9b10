"""Hand-computed metrics and scorers."""

import math

import pytest
from pyspark.sql import functions as F

from seekwell.functions import scoring as Q, text as X
from seekwell.operators import evaluation as E


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


L = F.lit


def arr(*items):
    return F.array(*[L(i) for i in items])


@pytest.fixture()
def judged(spark):
    run = spark.createDataFrame([(0, 10, 1), (0, 11, 2), (1, 20, 1), (1, 21, 2), (1, 22, 3), (2, 30, 1)], "qid long, docid long, rank int")
    qrels = spark.createDataFrame([(0, 10), (0, 99), (1, 22), (3, 1)], "qid long, docid long")
    return E.judge(run, qrels), E.label_totals(qrels)


def test_ranking_metrics(judged):
    got = {r.metric: r.value for r in E.mean_metrics(E.query_metrics(*judged, [1, 3])).collect()}
    third = lambda *v: round(sum(v) / 3, 6)
    assert got["mrr@1"] == third(1, 0, 0) and got["mrr@3"] == third(1, 1 / 3, 0)
    assert got["recall@3"] == third(0.5, 1, 0) and got["precision@3"] == third(1 / 3, 1 / 3, 0)
    assert got["map@3"] == third(0.5, 1 / 3, 0)
    assert got["ndcg@3"] == third(1 / (1 + 1 / math.log2(3)), 0.5, 0)


def test_graded_gain(spark):
    run = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "qid long, docid long, rank int")
    qrels = spark.createDataFrame([(0, 1, 1), (0, 2, 3)], "qid long, docid long, grade int")
    got = {r.metric: r.value for r in E.mean_metrics(E.query_metrics(E.judge(run, qrels), E.label_totals(qrels), [2])).collect()}
    assert got["ndcg@2"] == round((1 + 3 / math.log2(3)) / (3 + 1 / math.log2(3)), 6)


def test_rerank_quality_skips_one_sided_queries(spark):
    df = spark.createDataFrame([(0, 1, 0.9, 1), (0, 2, 0.8, 0), (0, 3, 0.7, 1), (1, 1, 0.5, 1), (2, 1, 0.1, 0), (0, 3, 0.1, 1)], "qid long, docid long, score double, rel int")
    r = E.rerank_quality(df).first()
    assert (r.n_queries, r["map"], r.mrr) == (1, round((1 + 2 / 3) / 2, 6), 1.0)


def test_phrase_matches_against_brute_force(spark):
    docs = [(0, "the big red fox"), (1, "a red fox, the"), (2, "fox red"), (3, "Red Fox")]
    phrases = [(0, "red fox"), (1, "the"), (2, "missing"), (3, "fox , the")]
    tok = lambda s: [w for w in s.lower().replace(",", " , ").split()]
    want = sorted((q, d) for q, p in phrases for d, t in docs if any(tok(t)[i:i + len(tok(p))] == tok(p) for i in range(len(tok(t)))))
    out = E.phrase_matches(spark.createDataFrame(docs, "docid long, text string"), spark.createDataFrame(phrases, "qid long, query string"))
    assert sorted(tuple(r) for r in out.select("qid", "docid").collect()) == want


def test_f1_counts_repeats(spark):
    assert value(spark, Q.f1_answer(L("the cat cat sat"), L("cat cat cat"))) == pytest.approx(2 * 2 / 6)
    assert value(spark, Q.f1_answer(L("dog"), L("cat"))) == 0.0
    assert value(spark, Q.f1_answer_zh(L("保险合同。"), L("保险 条款"))) == pytest.approx(2 * 2 / 8)


def test_rouge_2_and_l_differ(spark):
    a, b = arr("a", "x", "b", "c"), arr("a", "b", "c", "d")
    assert value(spark, Q.rouge_n(a, b, 2)) == pytest.approx(2 * 1 / 6)
    assert value(spark, Q.rouge_l(a, b)) == pytest.approx(3 / 4)
    assert value(spark, Q.rouge_l(a, arr("a", "b", "c", "d", "e", "f"), "r")) == pytest.approx(3 / 6)


def test_class_name_inside_another(spark):
    classes = arr("sport", "motor sport", "news")
    assert value(spark, Q.class_score(L("it is motor sport"), L("motor sport"), classes)) == 1.0
    assert value(spark, Q.class_score(L("sport and news"), L("sport"), classes)) == 0.5
    assert value(spark, Q.class_score(L("nothing"), L("sport"), classes)) == 0.0


@pytest.mark.parametrize("pred,label,want", [
    ("B", ["B", "cat"], 1.0), ("  C. because", ["C"], 1.0), ("", ["A"], 0.0), ("the answer is: cat", ["D", "cat"], 1.0),
    ("the answer is: dog", ["D", "cat"], 0.0), ("so maybe D then", ["D"], 1.0), ("the answer:", ["D"], 0.0), ("cat", ["A", "cat"], 1.0)])
def test_choice(spark, pred, label, want):
    assert value(spark, Q.score_choice(L(pred), arr(*label))) == want


@pytest.mark.parametrize("pred,want", [("B. the second", 1.0), ("The answer is: foo", 1.0), ("the error is: B", 1.0), ("answer: bar", 0.0), ("none", 0.0)])
def test_code_debug(spark, pred, want):
    assert value(spark, Q.score_code_debug(L(pred), L("foo"), L("B"))) == want


def test_number_tasks(spark):
    assert value(spark, Q.score_code_run(L("The result is: 42."), L(42))) == 1.0
    assert value(spark, Q.score_code_run(L("42 is it"), L(42))) == 0.0
    assert value(spark, Q.score_math_find(L("it is 3.50 or so"), L(3.5))) == 1.0
    assert value(spark, Q.score_math_calc(L("1, 2, 9"), arr("1", "2", "3"))) == pytest.approx(2 / 3)
    assert value(spark, Q.number_share(L("1 2 2"), L("2"))) == pytest.approx(2 / 3)
    assert value(spark, Q.paragraph_share(L("段落3"), L("段落3"), "zh")) == 1.0


def test_edit_ratio_and_code_line(spark):
    assert value(spark, Q.edit_ratio(L("abcd"), L("bcde"))) == 0.75
    assert value(spark, Q.code_line(L("\n# note\n// no\nx = 1\n"))) == "x = 1"


def test_substring_match(spark):
    assert value(spark, Q.substring_match(L("lives in paris"), arr("Paris")))
    assert value(spark, Q.substring_match(L("Paris it is"), arr("pARIS")))
    assert not value(spark, Q.substring_match(L("PARIS"), arr("Paris")))


def test_reward_is_clipped(spark):
    q = spark.createDataFrame([(0, "x"), (1, ""), (2, "no labels"), (3, "worse")], "qid long, query string")
    qrels = spark.createDataFrame([(0, 1), (3, 1)], "qid long, docid long")
    run = lambda data: spark.createDataFrame(data, "qid long, docid long, rank int")
    low, high = run([(0, 5, 1)]), run([(0, 1, 1)])
    got = {r.qid: r.reward for r in E.rewrite_reward(low, high, q, qrels, 1000).collect()}
    assert got == {0: 2.0, 1: -2.0, 2: 0.0, 3: 0.0}
    got = {r.qid: r.reward for r in E.rewrite_reward(high, low, q, qrels, 1000).collect()}
    assert got[0] == -2.0
    got = {r.qid: r.reward for r in E.rewrite_reward(low, high, q, qrels, 10, "absolute").collect()}
    base = 1 / math.log(17, 3)
    assert got == {0: round((1 / math.log(3, 3) - base) / (1 - base), 3), 1: 0.0, 2: 0.0, 3: 0.0}


def test_spearman_with_ties(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (2.0, 3.0), (4.0, 2.0)], "x double, y double")
    x, y = [1, 2.5, 2.5, 4], [1.5, 1.5, 4, 3]
    mx, my = sum(x) / 4, sum(y) / 4
    want = sum((a - mx) * (b - my) for a, b in zip(x, y)) / math.sqrt(sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))
    assert E.spearman(df, "x", "y").first().spearman == round(want, 6)


def test_average_precision_groups_ties(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 0), (0.5, 1), (0.1, 0)], "s double, r int")
    assert E.average_precision(df, "s", "r").first()[0] == round(0.5 * 1 + 0.5 * 2 / 3, 6)


def test_v_measure_of_equal_partitions(spark):
    df = spark.createDataFrame([(0, "a"), (0, "a"), (1, "b")], "l int, c string")
    assert tuple(E.v_measure(df, "l", "c").first()) == (1.0, 1.0, 1.0)


def test_leaderboard_needs_every_task(spark):
    df = spark.createDataFrame([("m", "a", 0.5), ("m", "CQADupstackX", 0.2), ("m", "CQADupstackY", 0.4), ("n", "a", 0.9)], "model string, task string, value double")
    got = {r.model: r for r in E.leaderboard(df, ["a", "CQADupstack"]).collect()}
    assert got["m"].average == 40.0 and got["n"].average is None


def test_punctuation(spark):
    got = value(spark, X.normalize_punctuation(L("“a”—b­\u0001 ‘c’ ″ … x⁄y\u000bz")))
    assert got == '"a"-b \'c\' \'\' ... x/y z'


def test_tokens_decompose(spark):
    assert value(spark, X.simple_tokens(L("Ab,c é"), lower=True, decompose=True)) == ["ab", ",", "c", "é"]
    assert value(spark, X.space_tokens(L("a  b"))) == ["a", "", "b"]


def test_truncation(spark):
    a = arr(*"abcdefg")
    assert value(spark, X.truncate(a, 3, "tail")) == list("efg")
    assert value(spark, X.truncate(a, 5, "middle")) == list("abfg")
    assert value(spark, X.truncate_left_of_pair(a, arr("x", "y"), 1)) == []


def test_rewrite_message(spark):
    ok = value(spark, X.parse_rewrite(L("sys [INST] Query: old one [/INST] text Rewritten Query: new one")))
    assert (ok.original, ok.rewritten) == ("old one", "new one")
    bad = value(spark, X.parse_rewrite(L("no marker")))
    assert (bad.original, bad.rewritten) == ("", "")


def test_answer_normalisers(spark):
    assert value(spark, X.normalize_answer(L("The  Cat, and an Apple!"))) == "cat and apple"
    assert value(spark, X.normalize_answer_zh(L("保险，A b！"))) == "保险ab"
    assert value(spark, X.contains_chinese(L("abc保")))


def test_reward_by_classes_equals_pairs(spark):
    """Classes stand for all their pairs, repeated ids and several classes included; before, the pairs had to be made."""
    q = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a"), (2, None), (3, "c"), (3, "c")], "qid long, label string")
    d = spark.createDataFrame([(5, "a"), (5, "b"), (5, "a"), (6, "a"), (7, None), (8, "b")], "docid long, label string")
    pairs = q.join(d, "label").select("qid", "docid")
    asked = q.select("qid", F.lit("x").alias("query")).distinct()
    run = lambda data: spark.createDataFrame(data, "qid long, docid long, rank int")
    one = run([(0, 5, 1), (0, 9, 2), (1, 6, 3), (1, 6, 1), (2, 7, 1), (3, 5, 1)])
    two = run([(0, 8, 1), (0, 5, 2), (1, 5, 1), (1, 9, 2), (3, 6, 1)])
    got, want = [sorted(tuple(r) for r in E.rewrite_reward(one, two, asked, rel, 10).collect()) for rel in (E.ClassLabels(q, d), pairs)]
    assert got == want and len(got) == 4
