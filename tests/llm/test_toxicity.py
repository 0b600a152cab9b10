"""Compression-distance scores: held-out accuracy on planted insults, awkward rows, whole texts."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from seekwell.llm import toxicity

from .fixtures import documents, prose

INSULTS = ("grobblewit", "snarkface", "doltish")


def planted(n=400):
    rnd = random.Random(4)
    rows = []
    for i in range(n):
        words = prose(1000 + i, rnd.randint(60, 300)).split()
        if i % 4 == 0:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(INSULTS))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    return rows


@pytest.fixture(scope="module")
def model():
    return toxicity.fit([(t, y) for i, t, y in planted() if zlib.crc32(str(i).encode()) % 5])


def test_held_out_accuracy(spark, model):
    rows = planted()
    docs = documents(spark, [(i, t) for i, t, _ in rows])
    got = {r.doc_id: r for r in toxicity.classify(docs, model).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_whole_texts_count(model):
    score = model.scorer()
    late = prose(7, 5000) + " you grobblewit and snarkface, doltish " + prose(8, 20)
    assert score([late])[0] > score([prose(7, 5000) + prose(8, 20)])[0]


def test_train_reads_labels_outside_the_hold_out(spark):
    rows = planted()
    docs = documents(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in rows], "doc_id long, toxic int, text string")
    taken = {(r.text, r.y) for r in toxicity.sample(docs, labels).collect()}
    assert taken == {(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5}
    assert toxicity.train(docs, labels) == toxicity.fit(sorted(taken))
    assert toxicity.sample(docs, labels, toxic_bytes=3000).filter("y = 1").agg(F.sum(F.octet_length("text"))).first()[0] <= 3000


def test_awkward_rows(spark, model):
    out = toxicity.classify(documents(spark), model)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == documents(spark).count()
    by_id = {}
    for r in out.collect():
        by_id.setdefault(r.doc_id, set()).add(r.score)
    assert by_id[6] == by_id[7] == by_id[8] and len(by_id[6]) == 1 and by_id[1] == by_id[4]
    empty = documents(spark).limit(0)
    labels = spark.createDataFrame([(1, None), (2, 1), (None, 0)], "doc_id long, toxic int")
    assert toxicity.classify(empty, model).count() == 0
    one_class = toxicity.train(documents(spark), labels)
    assert {r.score for r in toxicity.classify(documents(spark), one_class).collect()} == {1.0}
    assert {r.score for r in toxicity.classify(documents(spark), toxicity.train(empty, labels)).collect()} == {0.5}


def test_windows():
    parts = toxicity.windows("Ab, cd-EF é1 g h")
    assert [p.rstrip(b"\x01").split() for p in parts] == [[b"ab", b"cd", b"ef", "é1".encode()], ["é1".encode(), b"g", b"h"]]
    assert toxicity.windows(None) == toxicity.windows(" .,") == [] and len(toxicity.windows("one")) == 1
