"""Longest common subsequences in the plan, scores by dataset, boards with missing results."""

import random

from pyspark.sql import functions as F

from seekwell.functions import scoring as Q
from seekwell.operators import evaluation as E


def lcs(a, b):
    a, row = [x for x in a or [] if x is not None], None
    row = [0] * (len(a) + 1)
    for y in b or []:
        new = [0]
        for j, x in enumerate(a):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_subsequences_of_any_length(spark):
    rnd = random.Random(1)
    tokens = lambda sizes, letters: [rnd.choice(letters) for _ in range(rnd.choice(sizes))]
    rows = [(tokens([0, 1, 5, 61, 62, 63, 124, 130], "abcdef"), tokens([0, 3, 62, 150], "abcdefg")) for _ in range(120)]
    rows += [(None, ["a"]), (["a"], None), (["a", None, "b"], ["a", "b"]), (["é", "日"] * 40, ["日", "é"] * 40)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>").select(Q.lcs_length(F.col("a"), F.col("b")).alias("n"), F.lit(1))
    assert [r.n for r in df.collect()] == [lcs(a, b) for a, b in rows]
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_summary_task_and_edit_ratio(spark):
    df = spark.createDataFrame([("the cat sat on the mat", ["a cat sat", "the cat on mat"], "kitten", "sitting"), ("", ["x"], "", "")], "p string, a array<string>, l string, g string")
    got = df.select(Q.task_score(F.lit("longbook_sum_eng"), "p", "a").alias("s"), Q.edit_ratio(F.col("l"), F.col("g")).alias("e")).collect()
    assert got[0].s == 0.8 and got[0].e == 0.62 and got[1].s == 0.0 and got[1].e == 1.0


def test_each_dataset_has_its_metric(spark):
    rows = [("hotpotqa", "The Paris", ["paris"], None, 1.0), ("triviaqa", "\nparis\nrome", ["rome", "paris"], None, 1.0), ("qasper", "\nparis\nrome", ["paris"], None, 2 / 3),
            ("multifieldqa_zh", "北京", ["北京市"], None, 0.8), ("gov_report", "a b c", ["a x c"], None, 2 / 3), ("vcsum", "北 京", ["北京"], None, 1.0),
            ("trec", "It is a dog", ["dog"], ["dog", "do", "cat"], 1.0), ("lsht", "dog cat", ["dog"], ["dog", "cat"], 0.5), ("trec", "x", ["dog"], None, 0.0),
            ("passage_retrieval_en", "Paragraph 3 or 4", ["Paragraph 3"], None, 0.5), ("passage_retrieval_zh", "段落7", ["段落7"], None, 1.0), ("passage_count", "5", ["5"], None, 1.0),
            ("lcc", "# note\nabcd", ["bcde"], None, 0.75), ("other", "x", ["x"], None, None), ("hotpotqa", None, ["x"], None, 0.0), ("hotpotqa", "x", [], None, 0.0)]
    df = spark.createDataFrame([r[:4] for r in rows], "dataset string, prediction string, answers array<string>, classes array<string>")
    got = [r.s for r in df.select(E.dataset_score(F.col("dataset"), F.col("prediction"), F.col("answers"), F.col("classes")).alias("s")).collect()]
    assert [g if g is None else round(g, 9) for g in got] == [r[4] if r[4] is None else round(r[4], 9) for r in rows]
    report = E.dataset_report(df.withColumn("length", F.when(F.col("dataset") == "hotpotqa", 5000).otherwise(100)))
    out = {(r.level, r.name, r.bucket): (r.n, r.value) for r in report.collect()}
    assert out["dataset", "hotpotqa", None] == (3, 33.33) and out["length", "hotpotqa", "4-8k"] == (3, 33.33) and ("dataset", "other", None) not in out
    assert out["category", "EN Multi-Doc QA", None] == (3, 33.33) and out["overall", "all", None][0] == 15
    assert E.dataset_report(df.withColumn("length", F.lit(1)).limit(0)).count() == 0


def test_boards_with_missing_tasks(spark):
    rows = [("A", "t1", "m", 0.5), ("A", "CQADupstackX", "m", 0.25), ("A", "CQADupstackY", "m", 0.755), ("A", "t1", "n", 0.1), ("B", "u", "n", 0.33333), ("B", "ignored", "n", 1.0), ("C", "v", "n", 1.0)]
    results = spark.createDataFrame(rows, "type string, task string, model string, value double")
    tasks = {"A": ["t1", "CQADupstack"], "B": ["u"]}
    boards = E.leaderboards(results, tasks)
    got = {(r.board, r.model, r.name): r.value for r in boards.collect()}
    assert got == {("A", "m", "t1"): 50.0, ("A", "m", "CQADupstack"): 50.25, ("A", "m", "Avg"): 50.13, ("A", "n", "t1"): 10.0, ("B", "n", "u"): 33.33, ("B", "n", "Avg"): 33.33,
                   ("Overall", "m", "A"): 50.13, ("Overall", "m", "Avg"): 50.13, ("Overall", "n", "B"): 33.33, ("Overall", "n", "Avg"): 33.33}
    lines = [r.line for r in E.leaderboard_lines(boards, tasks).filter("board = 'A'").orderBy("number").collect()]
    assert lines == ["Task Type: A", "| Model | t1 | CQADupstack | Avg |", "|:---|:---:|:---:|:---:|", "| m | 50.0 | 50.25 | 50.13 |", "| n | 10.0 |   |   |"]
    assert [r.line for r in E.leaderboard_lines(boards, tasks).filter("board = 'Overall'").orderBy("number").collect()][3:] == ["| m | 50.13 |   | 50.13 |", "| n |   | 33.33 | 33.33 |"]
