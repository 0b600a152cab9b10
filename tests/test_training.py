"""Training rows, packing, windows, readers and streams on small fixtures."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from seekwell.operators import hooks as K, packing as P, prompts as M, training as H
from seekwell.plans import jobs as J
from seekwell.sources import files as A


def test_corpus_id_names(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text("\n".join(json.dumps(x) for x in [{"docid": 1, "contents": "a"}, {"id": 2, "contents": "b"}, {"_id": "3", "text": "c"}]))
    assert sorted(tuple(r)[:2] for r in A.read_corpus(spark, str(p)).collect()) == [("1", "a"), ("2", "b"), ("3", "c")]
    p.write_text(json.dumps({"contents": "x"}))
    with pytest.raises(PySparkException):
        A.read_corpus(spark, str(p)).collect()


def test_last_duplicate_wins(spark):
    df = spark.createDataFrame([('[["q", "old"], ["p", "x"], ["q", "new"]]',)], "value string")
    assert {r.question: r.answer for r in A.qa_dict(A.qa_pairs(df)).collect()} == {"q": "new", "p": "x"}


def test_capped_path():
    assert A.parse_capped_path("a/b.json[100]") == ("a/b.json", 100)
    assert A.parse_capped_path("a/b.json") == ("a/b.json", None)


def test_languages():
    assert A.check_languages("en", A.LONG_DOC_LANGUAGES) == ["en"]
    with pytest.raises(ValueError):
        A.check_languages(["en", "xx"], A.OPEN_QA_LANGUAGES)
    assert len(A.OPEN_QA_LANGUAGES) == 26 and len(A.LONG_DOC_LANGUAGES) == 13


def test_train_group_repeats_negatives(spark):
    df = spark.createDataFrame([(0, ["p"], ["a", "b"])], "qid long, pos array<string>, neg array<string>")
    got = df.select(H.train_group(F.col("pos"), F.col("neg"), F.col("qid"), 6).alias("g")).first().g
    assert got[0] == "p" and len(got) == 6 and set(got[1:]) == {"a", "b"}


def test_teacher_takes_a_negative(spark):
    df = spark.createDataFrame([(0, ["p"], ["a", "b"], [0.1, 0.2, 0.9])], "qid long, pos array<string>, neg array<string>, teacher_scores array<double>")
    r = H.choose_positive(df, "teacher").first()
    assert (r.positive, r.positive_score, r.neg, r.neg_scores) == ("b", 0.9, ["a"], [0.2])
    r = H.choose_positive(df, "teacher-pos").first()
    assert (r.positive, r.neg) == ("p", ["a", "b"])


def test_teacher_scores_must_match(spark):
    df = spark.createDataFrame([(["p"], ["a"], [0.1])], "pos array<string>, neg array<string>, teacher_scores array<double>")
    with pytest.raises(PySparkException):
        H.teacher_filter(df).collect()


def test_rows_without_negatives_are_dropped(spark):
    df = spark.createDataFrame([(0, [], [])], "qid long, neg array<string>, neg_scores array<double>")
    assert H.choose_negatives(df, 3).count() == 0


def test_bucket_borders(spark):
    df = spark.createDataFrame([(n,) for n in (0, 499, 500, 999, 7000, 90000)], "n int")
    assert [r[0] for r in df.select(H.length_bucket(F.col("n"))).collect()] == ["0-500", "0-500", "500-1000", "500-1000", "7000-inf", "7000-inf"]


def test_packing_exact_fit_and_remainder(spark):
    df = spark.createDataFrame([("s", 1, "a b c"), ("s", 2, "d"), ("s", 3, "e f g h i"), ("t", 4, "x")], "source string, doc_id long, text string")
    got = P.pack_mixture(df, {"s": 100.0, "t": 0.0}, 100, 4).orderBy("piece").collect()
    assert [r.tokens for r in got] == [["a", "b", "c", "</s>"], ["d", "</s>", "e", "f"], ["g", "h", "i", "</s>"]]
    got = P.pack_mixture(df, {"s": 100.0}, 8, 4).collect()
    assert len(got) == 2


def test_one_document_spans_many_pieces(spark):
    df = spark.createDataFrame([("s", 1, " ".join(str(i) for i in range(103)))], "source string, doc_id long, text string")
    got = P.pack_mixture(df, {"s": 100.0}, 10_000, 10).orderBy("piece").collect()
    assert [t for r in got for t in r.tokens] == [str(i) for i in range(100)]


def test_windows(spark):
    df = spark.createDataFrame([(0, "a b c d e f g")], "doc_id long, text string")
    got = [(r["window"], r.tokens, r.labelled) for r in P.sliding_windows(df, 4, 2).orderBy("window").collect()]
    assert got == [(0, list("abcd"), 4), (1, list("cdef"), 2), (2, list("efg"), 1)]
    got = [(r["window"], r.labelled) for r in P.sliding_windows(df, 4, 0).collect()]
    assert got == [(0, 4)]
    assert P.sliding_windows(df, 7, 2).count() == 1


def test_chat_rows(spark):
    df = spark.createDataFrame([(0, 0, "system", "s"), (0, 1, "user", "hi"), (0, 2, "assistant", "yo"), (1, 0, "user", "a"), (1, 1, "user", "b")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in M.chat_rows(df, 1, 100).collect()}
    assert got[0].prompt == "user: hi\nassistant: yo" and got[0].alternates and not got[1].alternates
    got = {r.conv_id: r for r in M.chat_rows(df, 1, 100, expect_answer=True).collect()}
    assert (got[0].prompt, got[0].answer) == ("user: hi", "yo")
    assert M.chat_rows(df, 1, 3).count() == 0


def test_merge_and_drop_small_sources(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 2 + [("c",)], "source string")
    count = lambda d: {r.source: r["count"] for r in d.groupBy("source").count().collect()}
    assert count(H.merge_small_sources(df, "source", 3, 3)) == {"a": 5, "small": 3}
    assert count(H.merge_small_sources(df, "source", 3, 4)) == {"a": 5}


def test_generation_retries(spark):
    def model():
        state = {"n": 0}

        def ask(prompt):
            state["n"] += 1
            if prompt == "bad" or state["n"] == 1:
                raise RuntimeError
            return prompt.upper()
        return ask

    df = spark.createDataFrame([("ok",), ("bad",)], "p string").coalesce(1)
    assert [r.answer for r in K.generate(df, "p", model).collect()] == ["OK", ""]


def test_unknown_verdict_gets_its_own_route(spark):
    q = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "qid long, query string")
    run = spark.createDataFrame([(i, i, 1.0, 1) for i in range(3)], "qid long, docid long, score double, rank int")
    faq = spark.createDataFrame([(0, "fx", "已解答"), (1, "fy", "不相关"), (2, "fz", "?")], "docid long, question string, answer string")
    verdict = lambda: (lambda prompt: prompt.rsplit("\n", 1)[1])
    got = {r.qid: r.route for r in J.faq_match(q, run, run, faq, verdict).collect()}
    assert got == {0: "answered", 1: "clauses", 2: "unknown"}


def test_instruction_tables():
    assert {f: len(t) for f, t in M.INSTRUCTIONS.items()} == {"by_task": 6, "sentence": 1, "query_passage": 1, "duplicate": 6}


def test_missing_score_is_an_error(spark):
    c = spark.createDataFrame([(0, [1, 2])], "qid long, key_index array<long>")
    s = spark.createDataFrame([(0, 1, 0.5)], "qid long, docid long, score double")
    with pytest.raises(PySparkException):
        H.collate_scores(c, s).collect()
