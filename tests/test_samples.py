"""Scores from losses, benchmark fields, gold answers, options, sorted stride batches."""

import pytest
from pyspark.sql import functions as F

from seekwell.operators import prompts as P, training as H


def test_losses_become_scores_and_are_counted(spark):
    samples = spark.createDataFrame([(1, ["p"], ["n", "m"], None), (2, ["p"], [], ["a", "b"]), (3, [], [], None)], "qid long, pos array<string>, neg array<string>, history array<string>")
    losses = spark.createDataFrame([(1, 2, 3.0), (1, 0, 1.0), (1, 1, 2.0), (2, 1, 0.5), (2, 0, 0.25)], "qid long, place int, loss double")
    got = {r.qid: r.teacher_scores for r in H.collate_losses(samples, losses).collect()}
    assert got == {1: [-1.0, -2.0, -3.0], 2: [-0.25, -0.5], 3: []}
    assert {r.qid: len(r.teacher_scores) for r in H.collate_losses(samples.drop("history").filter("qid = 1"), losses).collect()} == {1: 3}
    with pytest.raises(Exception, match="differ"):
        H.collate_losses(samples, losses.filter("place > 0")).collect()


def test_fields_and_gold(spark):
    rows = [("code_run", "call func_12(-3) then func_1(2)", None), ("math_find", "The Second Largest of the list of", None), ("x", "plain", ["a", "b", "c", "d"]), ("y", None, ["a"])]
    out = P.derived_fields(spark.createDataFrame([(*r, "text") for r in rows], "dataset string, input string, options array<string>, content string")).collect()
    assert (out[0].func, out[0].func_call, out[0].prefix, out[0].context) == ("func_12", "func_12(-3)", None, "text")
    assert out[1].prefix == "What is the second largest of the list in the following list?" and out[1].func is None
    assert (out[2].OPTION_A, out[2].OPTION_D, out[2].question) == ("a", "d", "plain") and out[3].OPTION_B is None and out[3].func is None
    cases = [("code_debug", ["b"], ["a", "b", "c", "d"], ["b", "B"]), ("longbook_choice_eng", ["t", "C"], ["x"], ["t", "C"]), ("code_debug", ["t", "Z"], ["t"], None),
             ("code_debug", ["t"], ["x"], None), ("longbook_qa_eng", ["u", "v", "w"], None, ["u", "v", "w"])]
    df = spark.createDataFrame([c[:3] for c in cases], "task string, answer array<string>, options array<string>")
    assert [r.g for r in df.select(P.gold_answers(F.col("task"), F.col("answer"), F.col("options")).alias("g")).collect()] == [c[3] for c in cases]


def test_options_and_counts(spark):
    df = spark.createDataFrame([(1, ["x", "y"]), (2, []), (3, None)], "id long, options array<string>")
    assert sorted(map(tuple, P.explode_options(df).collect())) == [(1, 0, "x"), (1, 1, "y")]
    assert [r.id for r in P.few_counts(df, "id", [2, 3]).orderBy("id").collect()] == [2, 3] and P.few_counts(df, "id", []).count() == 3


@pytest.mark.parametrize("mode", ["strict", "relaxed"])
def test_sorted_stride_batches(spark, mode):
    df = spark.range(57).select("id", (F.col("id") * 13 % 40 + 1).alias("length"))
    for sort in ("ascend", "descend"):
        rows = H.stride_batches(df, "length", "id", 8, 8, 4, mode, sort=sort).collect()
        order = sorted({(r.batch_order, max(x.strides for x in rows if x.batch_order == r.batch_order)) for r in rows})
        most = [m for _, m in order]
        assert most == sorted(most, reverse=sort == "descend")
        sizes = [sum(r.batch_order == o for r in rows) for o, _ in order]
        assert set(sizes) == {4} if mode == "strict" else sorted(sizes)[1:] == [4] * 14 and sum(sizes) == 57
    shuffled = H.stride_batches(df, "length", "id", 8, 8, 4, mode)
    assert "batch_order" in shuffled.columns
    with pytest.raises(ValueError):
        H.stride_batches(df, "length", "id", 8, 8, 4, mode, sort="up")
