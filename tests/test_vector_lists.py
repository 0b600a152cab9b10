"""Saved vector lists: one fit, pruned reads, deltas that replace, exact with all lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seekwell.operators import dense as D, vector_lists as V
from seekwell.plans.jobs import batch_retrieve


def key(run):
    return sorted((r.qid, r["rank"], r.docid, r.score) for r in run.collect())


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 8)) * 4
    m = np.round(np.concatenate([c + rng.normal(size=(40, 8)) for c in centers]), 4)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "docid long, embedding array<double>")


def asked(points):
    return points.filter("docid % 9 = 0").withColumnRenamed("docid", "qid")


def test_search_after_load_fits_nothing_and_prunes(spark, points, tmp_path, monkeypatch):
    path = str(tmp_path / "lists")
    built = V.VectorLists.build(points, path, n_lists=12)

    def never(*args, **kwargs):
        raise AssertionError("fitted again")

    monkeypatch.setattr(V, "KMeans", never)
    lists = V.VectorLists.load(spark, path)
    assert lists.n_probe == built.n_probe <= 12 and lists.centroids.shape == (12, 8)
    one = asked(points).limit(1)
    run = lists.search(one, 3, n_probe=1)
    plan = run._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "list#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert plan.count("Exchange") <= 1  # the tasks' top lists only
    exact = D.dense_search(asked(points), points, 5, skip_self=True)
    assert key(lists.search(asked(points), 5, n_probe=12, skip_self=True)) == key(exact)
    assert D.recall_against(lists.search(asked(points), 5, skip_self=True), exact).first().recall >= 0.9


def test_deltas_replace_and_add(spark, points, tmp_path):
    lists = V.VectorLists.build(points.filter("docid < 300").withColumn("embedding", F.reverse("embedding")), str(tmp_path / "d"), n_lists=6)
    assert lists.add(points.filter("docid >= 200")) == 1
    assert lists.add(points.filter("docid < 200")) == 2
    again = V.VectorLists.load(spark, str(tmp_path / "d"))
    assert again.vectors().count() == 480
    assert key(again.search(asked(points), 4, n_probe=6)) == key(D.dense_search(asked(points), points, 4))


def test_cosine_parts_and_text_ids(spark, points, tmp_path, monkeypatch):
    text = points.withColumn("docid", F.concat(F.lit("d"), F.col("docid")))
    lists = V.VectorLists.build(text, str(tmp_path / "c"), n_lists=5, metric="cos")
    q = text.limit(30).withColumnRenamed("docid", "qid")
    want = key(D.dense_search(q, text, 3, "cos"))
    monkeypatch.setattr(V, "BROADCAST_BYTES", 500)
    assert key(lists.search(q, 3, n_probe=5)) == want
    assert key(batch_retrieve(None, V.VectorLists.load(spark, str(tmp_path / "c")), q, 3)) == key(lists.search(q, 3))


def test_ties_empty_sides_and_bounded_fit(spark, points, tmp_path):
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)], "docid long, embedding array<double>")
    lists = V.VectorLists.build(same, str(tmp_path / "t"), n_lists=2)
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, embedding array<double>")
    assert [r.docid for r in lists.search(q, 3).orderBy("rank").collect()] == [0, 1, 2]
    assert lists.search(q.limit(0), 3).count() == 0
    few = V.VectorLists.build(points, str(tmp_path / "f"), n_lists=4, fit_rows=60)
    assert key(few.search(asked(points), 2, n_probe=4)) == key(D.dense_search(asked(points), points, 2))
    nothing = V.VectorLists.build(points.limit(0), str(tmp_path / "e"))
    assert nothing.search(q, 3).count() == 0
    nothing.add(same)
    assert V.VectorLists.load(spark, str(tmp_path / "e")).search(q, 3).count() == 3
