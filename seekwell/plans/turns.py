"""One turn of the question service over a batch of questions.

Every stage takes only the rows that are still undecided, is written once to the shared folder, and calls its model once
per row: intent, then small talk or known-question match, then clauses for what the judge found irrelevant. Nothing runs
twice, whatever is done with the result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from seekwell.operators.hooks import generate
from seekwell.plans.jobs import ANSWERED, IRRELEVANT, clause_search, judge_prompt, route_by_intent
from seekwell.scale import cut, stack

Model = Callable[[], Callable[[str], str]]


@dataclass(frozen=True)
class Service:
    """What a turn calls. ``classify`` adds class ``probabilities`` to ``(qid, query)`` rows, the searches map such rows
    to a run, all others are model factories."""

    classify: Callable[[DataFrame], DataFrame]
    chat: Model
    faq_search: Callable[[DataFrame], DataFrame]
    judge: Model
    keywords: Model
    clause_search: Callable[[DataFrame], DataFrame]
    answer: Model


def question_turn(questions: DataFrame, faq: DataFrame, clauses: DataFrame, service: Service, history: DataFrame | None = None) -> DataFrame:
    """``(qid, route, docids, matched, answer)`` for each ``(qid, query)``.

    Routes: ``chat`` (the chat model answers, after the ``(qid, history)`` text if there is one), ``answered`` (the judge
    accepts the best known question of ``faq`` ``(docid, question, answer)``), ``clauses`` (it found it irrelevant, or
    nothing was found: the answer comes from the best ``clauses`` ``(docid, text)``), ``human`` and ``unknown`` (any other
    verdict, or no class), which have no answer.
    """
    asked = cut(route_by_intent(service.classify(questions.select("qid", "query")), "probabilities").select("qid", "query", "route"), "turn-intent")
    ids = faq.select("docid").schema[0].dataType.simpleString()
    nothing = F.array().cast(f"array<{ids}>")

    def decided(rows: DataFrame, route: Column, docids: Column = nothing, matched: Column | None = None, answer: Column | None = None) -> DataFrame:
        text = lambda c: (F.lit(None) if c is None else c).cast("string")
        return rows.select("qid", route.alias("route"), docids.alias("docids"), text(matched).alias("matched"), text(answer).alias("answer"))

    handed_on = decided(asked.filter(~F.coalesce("route", F.lit("unknown")).isin("chat", "consult")), F.coalesce("route", F.lit("unknown")))
    talk = asked.filter("route = 'chat'").withColumn("prompt", F.col("query"))
    if history is not None:
        talk = talk.join(history.select("qid", "history"), "qid", "left").withColumn("prompt", F.concat_ws("\n", "history", "query"))
    talked = cut(decided(generate(talk, "prompt", service.chat), F.lit("chat"), answer=F.col("answer")), "turn-chat")
    matched = cut(_judged(asked.filter("route = 'consult'").select("qid", "query"), faq, service), "turn-match")
    kind = F.when(F.col("verdict") == ANSWERED, "answered").otherwise("unknown")
    done = decided(matched.filter(~_open()), kind, F.array("docid"), F.col("question"), F.when(F.col("verdict") == ANSWERED, F.col("known")))
    rest = clause_search(matched.filter(_open()).select("qid", "query"), service.keywords, service.clause_search, clauses, service.answer)
    searched = cut(decided(rest, F.lit("clauses"), F.coalesce(F.col("docids").cast(f"array<{ids}>"), nothing), answer=F.col("answer")), "turn-clauses")
    return stack(handed_on, talked, done, searched)


def _open() -> Column:
    return F.col("docid").isNull() | (F.col("verdict") == IRRELEVANT)


def _judged(questions: DataFrame, faq: DataFrame, service: Service) -> DataFrame:
    """Each question with its best known question, if any, and the judge's verdict on it."""
    best = service.faq_search(questions).filter("rank = 1").select("qid", "docid")
    known = faq.select("docid", "question", F.col("answer").alias("known"))
    found = questions.join(best, "qid").join(known, "docid").withColumn("prompt", judge_prompt(F.col("query"), F.col("question"), F.col("known")))
    judged = generate(found, "prompt", service.judge, out="verdict").select("qid", "docid", "question", "known", "verdict")
    return questions.join(judged, "qid", "left")
