"""The question turn: every route, one model call per row and stage, whatever happens to the result."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from seekwell.plans.turns import Service, question_turn


def counted(path, name, reply):
    """A model that notes each call in a file of its own."""
    def factory():
        def ask(prompt):
            with open(f"{path}/{name}", "a") as log:
                log.write(prompt.replace("\n", " ") + "\n")
            return reply(prompt)
        return ask
    return factory


def calls(path, name):
    return (path / name).read_text().splitlines() if (path / name).exists() else []


@pytest.fixture()
def parts(spark, tmp_path):
    rows = [(0, "hello"), (1, "known"), (2, "far"), (3, "odd"), (4, "person"), (5, "nohit"), (6, "lost"), (7, "known")]
    questions = spark.createDataFrame(rows, "qid long, query string")
    faq = spark.createDataFrame([(10, "known thing", "the answer"), (11, "far thing", "x"), (12, "odd thing", "y")], "docid long, question string, answer string")
    clauses = spark.createDataFrame([(20, "first clause"), (21, "second clause")], "docid long, text string")
    chance = F.when(F.col("query") == "hello", F.array(F.lit(0.9), F.lit(0.1), F.lit(0.0))).when(F.col("query") == "person", F.array(F.lit(0.1), F.lit(0.1), F.lit(0.8))).when(
        F.col("query") != "lost", F.array(F.lit(0.1), F.lit(0.8), F.lit(0.1)))
    best = {"known": 10, "far": 11, "odd": 12}
    lookup = F.create_map(*[F.lit(x) for kv in best.items() for x in kv])
    faq_search = lambda q: q.select("qid", F.element_at(lookup, F.col("query")).cast("long").alias("docid"), F.lit(1).alias("rank")).filter("docid is not null")
    clause_run = lambda q: q.filter("query = 'FAR'").select("qid", F.lit(21).cast("long").alias("docid"), F.lit(1).alias("rank"), F.lit(1.0).alias("score"))
    verdict = lambda p: "已解答" if "known thing" in p else "不相关" if "far thing" in p else "也许"
    service = Service(lambda q: q.withColumn("probabilities", chance), counted(tmp_path, "chat", lambda p: "hi " + p), faq_search,
                      counted(tmp_path, "judge", verdict), counted(tmp_path, "keywords", str.upper), clause_run, counted(tmp_path, "answer", lambda p: "from " + p.split("\n")[-1]))
    return questions, faq, clauses, service, tmp_path


def test_all_routes(spark, parts):
    questions, faq, clauses, service, path = parts
    history = spark.createDataFrame([(0, "earlier"), (1, "unused")], "qid long, history string")
    out = question_turn(questions, faq, clauses, service, history)
    got = {r.qid: (r.route, r.docids, r.matched, r.answer) for r in out.collect()}
    assert got == {
        0: ("chat", [], None, "hi earlier\nhello"), 1: ("answered", [10], "known thing", "the answer"), 2: ("clauses", [21], None, "from second clause"),
        3: ("unknown", [12], "odd thing", None), 4: ("human", [], None, None), 5: ("clauses", [], None, "from "), 6: ("unknown", [], None, None), 7: ("answered", [10], "known thing", "the answer")}


def test_one_call_per_row(spark, parts):
    questions, faq, clauses, service, path = parts
    out = question_turn(questions, faq, clauses, service)
    for _ in range(3):
        out.count(), out.collect(), out.groupBy("route").count().collect()
    assert [len(calls(path, n)) for n in ("chat", "judge", "keywords", "answer")] == [1, 4, 2, 2]
    assert Counter(calls(path, "keywords")) == {"far": 1, "nohit": 1}


def test_empty_batch(spark, parts):
    questions, faq, clauses, service, path = parts
    assert question_turn(questions.limit(0), faq, clauses, service).count() == 0
    assert not calls(path, "judge")
