"""Queries that read a run more than once search for it once."""

import numpy as np
import pytest

from seekwell.checks import retrieval as C
from seekwell.checks.registry import QUERIES, Tables
from seekwell.operators import dense as D, fusion as X


@pytest.mark.parametrize("name", ["fuse_three_runs", "rerank_by_mode"])
def test_each_run_is_searched_once(name, spark, tmp_path, monkeypatch):
    """Before, the three fused runs took four searches and the reranking three."""
    m = np.round(np.random.default_rng(6).normal(size=(70, 64)), 2)
    m[3] = m[4]  # equal scores
    spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(m)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    t = Tables(spark, str(tmp_path))
    d, s = C.two_runs(t)
    multi = C.multi_scores(t)
    want = X.fuse_runs({"sparse": (s, 0.3, 0.3), "dense": (d, 0.2, 1), "multi": (multi, 0.4, 1)}) if name == "fuse_three_runs" else X.rerank(d, multi, "score", 20)
    rows = lambda run: sorted(map(tuple, run.select("qid", "rank", "docid", "score").collect()))
    want = rows(want)
    calls, search = [], D.dense_search
    monkeypatch.setattr(D, "dense_search", lambda *a, **kw: calls.append(a) or search(*a, **kw))
    got = rows(QUERIES[name](spark, str(tmp_path)))
    assert len(calls) == 2
    assert got == want and len({r[0] for r in got}) == 70
