"""Large JSON arrays cut at any byte, and the pool of examples of other properties."""

import json
import random

import pytest
from pyspark.sql import functions as F, types as T

from seekwell.operators import prompts as P
from seekwell.scale import scratch_path
from seekwell.sources import files as A
from seekwell.sources.json_arrays import _fragments, json_objects, read_json_array

NASTY = ['plain', 'quote " inside', 'brace { and } and [ ]', 'slash \\ end \\', '\\"{', 'line\nbreak {', 'é日本{', '', '{"docid": "fake"}', ']', '\\\\{\\"']


def array(n, seed, indent=None):
    rnd = random.Random(seed)
    rows = [{"id": i, "contents": " ".join(rnd.choice(NASTY) for _ in range(rnd.randint(0, 6))), "meta": {"deep": [{"x": rnd.choice(NASTY)}, []], "t": None}} for i in range(n)]
    return rows, json.dumps(rows, indent=indent, ensure_ascii=bool(seed % 2))


@pytest.mark.parametrize("size", ["37", "200", "1m"])
@pytest.mark.parametrize("indent", [None, 2])
def test_same_objects_for_any_split(spark, tmp_path, size, indent):
    folder = tmp_path / "arrays"
    folder.mkdir()
    every = []
    for name, n in (("a", 40), ("b", 0), ("c", 1), ("d", 25)):
        rows, text = array(n, len(every) + (indent or 0), indent)
        (folder / f"{name}.json").write_text(text, encoding="utf-8")
        every += [json.dumps(r, sort_keys=True) for r in rows]
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        splits = _fragments(spark, str(folder)).select("file", "start").distinct().count()
        assert splits > 100 if size == "37" else splits >= 4
        got = [json.dumps(json.loads(r.value), sort_keys=True) for r in json_objects(spark, str(folder)).collect()]
        assert sorted(got) == sorted(every)
        corpus = A.read_corpus(spark, str(folder), "json")
        assert sorted((r.docid, r.text) for r in corpus.collect()) == sorted((str(json.loads(x)["id"]), json.loads(x)["contents"]) for x in every)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    rows, text = array(3000, 1)
    (tmp_path / "one.json").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(len(text) // 10))
    try:
        df = read_json_array(spark, str(tmp_path / "one.json"), T.StructType().add("id", "long"))
        tasks = json_objects(spark, str(tmp_path / "one.json")).select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks >= 8 and sorted(r.id for r in df.collect()) == list(range(3000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("limit", [None, 10])
def test_many_properties(spark, monkeypatch, limit):
    """Thousands of properties: no array of the whole pool, and the same rows as a plain inequality join."""
    if limit:
        monkeypatch.setattr(P, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(P, "POOL_BLOCK", 50)
    examples = spark.range(900).select((F.col("id") % 300).cast("string").alias("prop"), F.col("id"))
    examples = examples.unionAll(spark.createDataFrame([("7", 5000 + i) for i in range(200)] + [(None, 9999)], "prop string, id long"))
    queries = spark.createDataFrame([(0, "0"), (1, "7"), (2, "absent"), (3, None), (4, "299")], "qid long, prop string")
    out = P.other_property_examples(queries, examples, 2)
    got = sorted((r.qid, r.prop, r["rank"], r.docid) for r in out.collect())
    pool = P.other_property_examples(spark.createDataFrame([(9, "absent")], "qid long, prop string"), examples, 2).collect()
    assert len(pool) == 600
    assert got == sorted((q.qid, r.prop, r["rank"], r.docid) for q in queries.collect() if q.prop is not None for r in pool if r.prop != q.prop)
    assert P.other_property_examples(queries, examples.limit(0), 2).count() == 0
