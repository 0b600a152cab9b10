"""The pipeline against its stages done by hand on a small table, and every registered query of the subpackage."""

import re

import pytest

import __spark_entry__ as entry
import compare
import corpus_pipeline
from seekwell.llm import decontamination, queries, secrets, simhash

from .test_operators import brute_components, brute_fingerprint


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, folder, name):
    ok, text = compare.compare(spark, compare.database(folder), folder, name, queries.QUERIES[name], queries.SQL[name])
    assert ok, text


def test_all_are_registered():
    names = set(entry.queries())
    assert {*queries.QUERIES, "pipeline"} <= names and len([n for n in names if re.match(r"op\d+_", n)]) == 13
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier"


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    results = []
    for _, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.cut(stage(spark, docs, folder), "test")
        results.append((before, docs))
    for before, after in results[:-1]:
        assert after.columns == before.columns
    judged = {r.doc_id: r.predicted for r in queries.QUERIES["op6_quality_classifier"](spark, folder).collect()}
    assert sorted(r.doc_id for r in results[0][1].collect()) == sorted(d for d, p in judged.items() if p)
    rows = results[1][0].collect()
    least = brute_components([r.doc_id for r in rows], [brute_fingerprint(r.text) for r in rows])
    assert sorted(r.doc_id for r in results[1][1].collect()) == sorted(set(least))
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    dirty = {r.doc_id for r in decontamination.contamination(results[2][0], items).filter("contaminated").collect()}
    assert sorted(r.doc_id for r in results[2][1].collect()) == sorted({r.doc_id for r in results[2][0].collect()} - dirty)
    spans = {r.doc_id: r.spans for r in secrets.find_secrets(results[3][0]).collect()}
    old = {r.doc_id: r.text for r in results[3][0].collect()}
    for r in results[3][1].collect():
        if not spans[r.doc_id]:
            assert r.text == old[r.doc_id]
        else:
            assert "[SECRET]" in r.text and not any(old[r.doc_id][s.start:s.end] in r.text for s in spans[r.doc_id])
    final = results[4][1]
    assert sorted({r.doc_id for r in final.collect()}) == sorted(spans)
    whole = corpus_pipeline.run(spark, folder)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(key).collect())) == sorted(map(tuple, final.select(key).collect()))
    assert simhash.BITS == 4 and simhash.SHINGLE == 4
