"""Phrase containment: equal to a delimited substring test, whatever the layout, parts and skew."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seekwell.operators import evaluation as E, phrases as P

TOKEN = re.compile(r"[^\W_]+|\S")


def tokens(text):
    return TOKEN.findall((text or "").lower())


def padded(text):
    return " " + " ".join(tokens(text)) + " "


def brute(docs, phrases):
    return sorted({(q, d) for d, t in docs for q, p in phrases if tokens(p) and padded(p) in padded(t)})


@pytest.fixture(scope="module")
def data():
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(12)] + ["the"] * 12
    docs = [(f"d{i}", " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))) for i in range(300)] + [("none", None), ("tail", "w1 w2"), ("case", "W1, w2! W3?")]
    phrases = [(i, " ".join(docs[i * 7][1].split()[3:3 + i % 6])) for i in range(30)] + [(100, "the the"), (101, "absent"), (102, ""), (103, None), (104, "w1, W2!"), (104, "w3?")]
    return docs, phrases


def frames(spark, data):
    return (spark.createDataFrame(data[0], "docid string, text string").repartition(5), spark.createDataFrame(data[1], "qid long, query string"))


def test_equals_brute_force_in_any_parts(spark, data, monkeypatch):
    docs, phrases = frames(spark, data)
    want = brute(*data)
    assert len(want) > 100
    assert sorted(map(tuple, P.phrase_matches(docs, phrases).collect())) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    monkeypatch.setattr(P, "BROADCAST_TERM_ROWS", 20)
    try:
        assert sorted(map(tuple, P.phrase_matches(docs, phrases).distinct().collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_text_is_shuffled(spark, data):
    docs, phrases = frames(spark, data)
    plan = P.phrase_matches(docs.coalesce(5), phrases)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("regexp_extract_all") >= 1  # the test's own repartition


def test_token_of_every_document_is_never_the_anchor():
    """A phrase of one rare and one ubiquitous token looks only at the places of the rare one."""
    n = 200_000
    code = np.zeros(n, dtype=np.int64)
    code[::1000] = 1
    phrases = P.Phrases([0, 1], [["hot", "rare"], ["rare", "hot"]])
    hot, rare = phrases.vocabulary.index("hot"), phrases.vocabulary.index("rare")
    code = np.where(code == 1, rare, hot)
    seen = []

    class Watched(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray) and at.dtype != bool:
                seen.append(at.size)
            return super().__getitem__(at)

    found = dict(phrases.found(code.view(Watched), np.arange(n) // 100))
    assert set(found) == {1} and len(found[1]) == 200  # the rare token opens its document
    assert max(seen) <= 200


def test_answer_recall_reads_each_hit_once(spark):
    docs = spark.createDataFrame([(1, "Paris is big"), (2, "the city of Rome"), (3, ""), (4, None)], "docid long, text string")
    run = spark.createDataFrame([(0, 2, 1), (0, 1, 2), (1, 1, 1), (1, 3, 2), (3, 2, 1), (4, 2, 1)], "qid long, docid long, rank int")
    answers = spark.createDataFrame([(0, ["paris", "london"]), (1, ["rome"]), (2, ["x"]), (3, ["City of", None]), (4, ["", "!"])], "qid long, answers array<string>")
    out = E.answer_recall(run, docs, answers, (1, 2)).first()
    assert (out.recall_1, out.recall_2) == (0.2, 0.4)
