"""The running best of a vector search: arrays of a fixed size, exact with ties, repeats and cells that are no numbers."""

import numpy as np
import pytest
from pyspark.sql import DataFrame

from seekwell.operators import dense as D, vector_lists as V


@pytest.mark.parametrize("kind", ["int", "text"])
def test_running_best_equals_one_sort(kind, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_CELLS", 700)
    rng = np.random.default_rng(4)
    d, q = np.round(rng.normal(size=(900, 3)), 1), np.round(rng.normal(size=(40, 3)), 1)
    d[5], d[6, 0] = np.nan, np.inf
    number = rng.integers(0, 700, 900)  # ids come twice
    ids = number if kind == "int" else np.array([f"d{i:04d}" for i in number], dtype=object)
    qids = ids[:40]
    tops = D.Tops(qids, q, 4, "ip", True)
    for at in range(0, 900, 130):
        tops.add(ids[at:at + 130], d[at:at + 130])
    assert tops.best.shape == tops.ids.shape == (40, 4)
    rows = [r for f in tops.frames() for r in f.itertuples(index=False)]
    with np.errstate(invalid="ignore"):
        scores = np.round(q @ d.T, 6)
    want = []
    for i in range(40):
        order = sorted((-scores[i, j], ids[j]) for j in range(900) if np.isfinite(scores[i, j]) and ids[j] != qids[i])[:4]
        want += [(qids[i], x, -s) for s, x in order]
    assert [(a, b, round(c, 6)) for a, b, c in rows] == [(a, b, round(c, 6)) for a, b, c in want]


def test_many_queries_are_never_collected(spark, tmp_path, monkeypatch):
    """Before, the queries of a saved list search all came to the driver, part by part."""
    m = np.round(np.random.default_rng(5).normal(size=(120, 4)), 3)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "docid long, embedding array<double>")
    lists = V.VectorLists.build(points, str(tmp_path / "l"), n_lists=5)
    asked = points.withColumnRenamed("docid", "qid")
    key = lambda run: sorted((r.qid, r["rank"], r.docid) for r in run.collect())
    all_, some = key(D.dense_search(asked, points, 3)), key(lists.search(asked, 3, n_probe=2))
    monkeypatch.setattr(V, "QUERY_BYTES", 10_000)
    monkeypatch.setattr(V, "BLOCK_ROWS", 9)  # lists of several blocks, too

    def never(self):
        raise AssertionError("collected")

    monkeypatch.setattr(DataFrame, "toPandas", never)
    assert key(lists.search(asked, 3, n_probe=5)) == all_
    assert key(lists.search(asked, 3, n_probe=2)) == some


@pytest.mark.parametrize("metric", ["ip", "cos", "l2"])
def test_few_cells_are_scored_in_full(metric, monkeypatch):
    """Before, every cell was scored in double precision."""
    monkeypatch.setattr(D, "BLOCK_CELLS", 40_000)
    monkeypatch.setattr(D, "BLOCK_WIDTH", 1000, raising=False)
    rng = np.random.default_rng(6)
    d = rng.normal(size=(6000, 8)).astype(np.float32).astype(np.float64)
    d[100:140], d[7], d[8, 0], d[9], d[10, 3] = d[99], np.nan, np.inf, 1e-30, 3e38  # copies, and numbers single precision does not hold well
    q = d[:80].copy()
    m, p = D._prepare(d, metric), D._prepare(q, metric)
    full = []
    scores = D._scores
    monkeypatch.setattr(D, "_scores", lambda a, b, kind: full.append(len(a) * len(b)) or scores(a, b, kind))
    ids = rng.permutation(6000)
    with np.errstate(all="ignore"):
        tops = D.Tops(ids[:80], p, 5, metric, True)
        for at in range(0, 6000, 2500):
            tops.add(ids[at:at + 2500], m[at:at + 2500])
        every = np.round(scores(p, m, metric), 6)
    got = [r for f in tops.frames() for r in f.itertuples(index=False)]
    want = []
    for i in range(80):
        order = sorted((-every[i, j], ids[j]) for j in range(6000) if np.isfinite(every[i, j]) and j != i)[:5]
        want += [(ids[i], x, -s) for s, x in order]
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=2e-6)
    assert sum(full) < 80 * 6000 / 2


def test_huge_and_tiny_numbers_keep_their_order():
    """Products beyond single precision are scored in full."""
    d = np.array([[1e200, 0.0], [2e200, 0.0], [1e-200, 1.0], [3.0, 1e-3], [3.0, 2e-3], [-5e100, 1.0]] * 3)
    for q in ([[1.0, 0.0]], [[1e-200, 1e3]], [[1e30, 1e30]], [[0.0, 0.0]]):
        q = np.array(q)
        tops = D.Tops(np.array([100]), q, 2, "ip", False)
        for at in range(0, 18, 6):
            tops.add(np.arange(at, at + 6), d[at:at + 6])
        order = sorted((-s, i) for i, s in enumerate(np.round((q @ d.T)[0], 6)))[:2]
        assert [(b, c) for f in tops.frames() for _, b, c in f.itertuples(index=False)] == [(i, -s) for s, i in order]


def test_grid_reads_the_corpus_as_a_stream(spark, monkeypatch):
    """Before, a task held a whole block of the corpus beside its queries."""
    m = np.round(np.random.default_rng(7).normal(size=(300, 4)), 3)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "docid long, embedding array<double>")
    asked = points.withColumnRenamed("docid", "qid")
    key = lambda run: sorted((r.qid, r["rank"], r.docid, r.score) for r in run.collect())
    want = key(D.dense_search(asked, points, 3, "l2", skip_self=True))
    monkeypatch.setattr(D, "BROADCAST_BYTES", 1000)
    monkeypatch.setattr(D, "BLOCK_WIDTH", 8, raising=False)
    add = D.Tops.add

    def few(self, ids, d, mine=None):
        if len(ids) > 60:
            raise AssertionError("a whole block")
        add(self, ids, d, mine)

    monkeypatch.setattr(D.Tops, "add", few)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        assert key(D.dense_search(asked, points, 3, "l2", skip_self=True)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_vectors_without_id_beside_others():
    """Before, ids of a later batch that can be missing were put among whole numbers."""
    tops = D.Tops(np.array([100]), np.array([[1.0]]), 3, "ip", True)
    tops.add(np.array([1, 2]), np.array([[1.0], [2.0]]))
    tops.add(np.array([np.nan, 3.0]), np.array([[3.0], [0.5]]))
    f, = tops.frames()
    assert f.score.tolist() == [3, 2, 1] and np.isnan(f.docid[0]) and f.docid.tolist()[1:] == [2, 1]
