"""Blocks of postings: bounds skip work and lose nothing."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seekwell.operators import blocks as B, lexical as L


def corpus(spark, n=3000, seed=5):
    """Few documents are about a topic, many mention its words in passing; text ids."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{int(rnd.paretovariate(0.7)) % 500}" for _ in range(rnd.randint(3, 60))]
        if i % 100 == 0:
            words = ["topic", "theme"] * rnd.randint(1, 3) + words[:5]
        rows.append((f"d{i:05d}", " ".join(words)))
    rows += [("empty", ""), ("null", None)]
    return spark.createDataFrame(rows, "docid string, text string").repartition(4)


def queries(spark):
    return spark.createDataFrame([("a", "topic theme w1"), ("b", "w3 w499 topic topic"), ("c", "absent"), ("d", None), ("e", "w7")], "qid string, query string")


def brute(corpus, queries, k, k1, b, norm):
    docs = [(r.docid, (r.text or "").split(" ") if r.text is not None else []) for r in corpus.collect()]
    lengths = {d: len(t) for d, t in docs}
    n, avg = len(docs), sum(lengths.values()) / len(docs) if norm else 1.0
    df = {}
    for _, t in docs:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for q in queries.collect():
        scores = []
        for d, t in docs:
            s = sum(np.log((n - df[x] + 0.5) / (df[x] + 0.5) + 1) * (k1 + 1) * t.count(x) / (t.count(x) + k1 * (1 - b + b * lengths[d] / avg)) for x in ([] if q.query is None else q.query.split(" ")) if x in t)
            if round(s, 6):
                scores.append((-round(s, 6), d))
        out += [(q.qid, d, r + 1) for r, (_, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def chunks(blocks, vocabulary, impact):
    """As eight blocks a task would see them."""
    whole = blocks.toArrow().combine_chunks().to_batches()[0]
    return [B.Chunk(whole.slice(at, 8), pa.array(vocabulary, pa.string()), impact) for at in range(0, len(whole), 8)]


def test_bounds_skip_most_pairs(spark):
    docs = L.build_index(corpus(spark))
    blocks = B.blocks_of_texts(docs.docs, None, size=32)
    sat = L._saturation(0.9, 0.4, 1.0)
    asked = np.array([0, 1]), np.array([5.0, 5.0])
    whole = cut = 0
    for c in chunks(blocks, ["topic", "theme"], sat):
        every, scores, seen = c.search(*asked, 10**9, -np.inf)
        docs_, best, few = c.search(*asked, 3, -np.inf)
        whole, cut = whole + seen, cut + few
        top = sorted(zip(-scores, every))[:3]
        assert sorted(zip(-best, docs_))[:3] == top
        again, _, none = c.search(*asked, 3, float(max(scores)) + 1 if len(scores) else 1.0)
        assert not len(again) and none == 0
    assert cut < whole


@pytest.mark.parametrize("norm", [False, True])
def test_run_with_pilot_equals_brute_force(spark, monkeypatch, norm):
    docs, q = corpus(spark), queries(spark)
    monkeypatch.setattr(B.blocks_of_texts, "__defaults__", (None, None, 16))
    monkeypatch.setattr(B.search_blocks, "__defaults__", (2,))
    run = L.bm25_search(L.build_index(docs), q, 7, 0.82, 0.68, norm)
    assert sorted((r.qid, r.docid, r["rank"]) for r in run.collect()) == brute(docs, q, 7, 0.82, 0.68, norm)


def test_pilot_scores_fewer_pairs(spark):
    """The lower bound of a pilot spares the tasks documents that a first block would still score."""
    index = L.build_index(corpus(spark, 6000))
    blocks = B.blocks_of_texts(index.docs, None, size=32)
    asked = np.array([0, 1]), np.array([5.0, 1.0])
    parts = chunks(blocks, ["topic", "w1"], L._saturation(0.9, 0.4, 1.0))
    alone = [c.search(*asked, 5, -np.inf) for c in parts]
    bound = sorted((s for _, scores, _ in alone for s in scores), reverse=True)[4]
    told = [c.search(*asked, 5, bound) for c in parts]
    assert sum(x[2] for x in told) < sum(x[2] for x in alone)
    assert sorted((s for _, scores, _ in told for s in scores), reverse=True)[:5] == sorted((s for _, scores, _ in alone for s in scores), reverse=True)[:5]


def test_search_of_saved_blocks_moves_no_postings(spark, tmp_path):
    docs, q = corpus(spark, 400), queries(spark)
    index = L.build_index(docs)
    index.save(str(tmp_path / "index"))
    saved = L.LexicalIndex.load(spark, str(tmp_path / "index"))
    run = L.bm25_search(saved, q, 5)
    text = run._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "hashpartitioning(qid" in text  # the tasks' top lists only
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(run) == key(L.bm25_search(index, q, 5))
    assert key(saved.postings) == key(index.postings)


def test_impacts_of_any_sign(spark):
    rnd = random.Random(2)
    d = [(i, f"t{rnd.randint(0, 30)}", rnd.choice([-3.0, -1.0, 0.5, 2.0, 4.0])) for i in range(500) for _ in range(4)]
    d = list({(a, b): (a, b, c) for a, b, c in d}.values())
    q = [(0, "t1", 2.0), (0, "t2", -1.0), (0, "t3", 1.0), (1, "t9", -2.0)]
    dw, qw = spark.createDataFrame(d, "docid long, token string, w double"), spark.createDataFrame(q, "qid long, token string, w double")
    want = []
    for qid in (0, 1):
        s = {}
        for a, t, w in d:
            for x, t2, w2 in q:
                if x == qid and t == t2:
                    s[a] = s.get(a, 0) + w * w2
        want += [(qid, a, r + 1) for r, (_, a) in enumerate(sorted((-v, a) for a, v in s.items() if v)[:6])]
    small = B.blocks_of_postings(dw.select("docid", "token", F.col("w").alias("weight"), F.lit(1).alias("dl")), size=8)
    for target in (dw, L.LexicalIndex.of_blocks(small)):
        assert [(r.qid, r.docid, r["rank"]) for r in L.impact_search(qw, target, 6).orderBy("qid", "rank").collect()] == want


def test_postings_over_many_arrow_batches(spark):
    rows = [(i, f"t{j}", 1, i % 7 + 1) for i in range(40) for j in range(i % 7 + 1)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        df = spark.createDataFrame(rows, "docid long, token string, weight int, dl int")
        blocks = B.blocks_of_postings(df, size=3)
        assert sorted(map(tuple, B.postings_of(blocks).collect())) == sorted(rows)
        assert blocks.agg(F.max(F.size("docid"))).first()[0] == 3
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_sides(spark):
    docs, q = corpus(spark, 20), queries(spark)
    assert L.bm25_search(L.build_index(docs.limit(0)), q, 5).count() == 0
    assert L.bm25_search(L.build_index(docs), q.limit(0), 5).count() == 0
    assert B.Asked.of(pd.DataFrame({"qid": [], "token": [], "w": []})).qids == []


def test_stored_blocks_lie_in_small_row_groups(spark, tmp_path, monkeypatch):
    """A reader holds a row group at once, and a row is a whole block; before, a file was one row group."""
    import glob

    import pyarrow.parquet as pq

    docs = spark.range(3000).select(F.col("id").alias("docid"), F.concat_ws(" ", *[F.md5(F.concat(F.col("id").cast("string"), F.lit(str(i)))) for i in range(12)], F.lit("shared")).alias("text")).coalesce(1)
    monkeypatch.setattr(B, "ROW_GROUP_BYTES", 100_000)
    monkeypatch.setattr(B.blocks_of_texts, "__defaults__", (None, None, 32))
    monkeypatch.setattr(B, "CHUNK_BYTES", 50_000)
    L.build_index(docs).save(str(tmp_path / "i"))
    groups = [pq.ParquetFile(f).metadata.row_group(g).num_rows for f in glob.glob(str(tmp_path / "i/blocks/*.parquet")) for g in range(pq.ParquetFile(f).metadata.num_row_groups)]
    assert sum(groups) >= 94 and max(groups) <= 20
    topics = spark.createDataFrame([(1, "shared"), (2, "nothing")], "qid long, query string")
    saved = L.bm25_search(L.LexicalIndex.load(spark, str(tmp_path / "i")), topics, 5).collect()
    assert sorted((r["rank"], r.docid) for r in saved) == [(i + 1, i) for i in range(5)]


def test_batches_of_blocks_are_searched_in_slices():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([[i] * 100 for i in range(50)])], ["doc"])
    parts = list(B.chunks(iter([batch, batch.slice(0, 0)]), batch.nbytes // 10))
    assert len(parts) >= 10 and max(map(len, parts)) <= 5 and pa.Table.from_batches(parts).to_pydict() == pa.Table.from_batches([batch]).to_pydict()
