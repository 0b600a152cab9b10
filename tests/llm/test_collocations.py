"""Phrase mining against SQL and brute force, on awkward rows, with and without broadcasts."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from seekwell.llm import collocations as C

from .fixtures import CLASHES, ROWS, rows_of

NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def mixed():
    rnd = random.Random(11)
    words = ["New", "york", "city", "big", "apple", "É", "été", "x#y", "a b", "the"]
    rows = [(i, " ".join(rnd.choice(words[:2] * 3 + words) + rnd.choice(["", "", "", ",", ".\n", "\t", "  ", "\r"]) for _ in range(rnd.randint(0, 40))), rnd.choice(["en", "fr", None, "und"])) for i in range(120)]
    return rows + [(d, t, "en") for d, t in ROWS] + [(900, "same words again and again " * 40, "en")] * 3 + [(None, None, None), (901, "", "de"), (902, "!!! ... \n", "de")]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit(c) for c in (*CLASHES, "piece", "pos", "id", "key", "phrase", "size")})


def from_sql(rows, **options):
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    if rows:
        db.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    cur = db.execute(C.sql(**options))
    names = [d[0] for d in cur.description]
    return sorted((tuple(r[names.index(x)] for x in NAMES) for r in cur.fetchall()), key=repr)


@pytest.mark.parametrize("limit", [C.BROADCAST_BYTES, -1])
def test_against_sql(spark, limit):
    rows = mixed()
    out = C.collocations(frame(spark, rows), top=40, least=4, limit=limit)
    got = rows_of(out)
    assert out.columns == NAMES and got == from_sql(rows, top=40, least=4) and len(got) > 60
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("occurrences_")]


def test_counts_by_hand(spark):
    rows = mixed()
    phrases, n = C.frequent_phrases(frame(spark, rows), least=3)
    want, total = Counter(), Counter()
    for _, text, lang in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    want[lang or "und", " ".join(words[i:i + k]), k] += 1
    assert {(r.lang, r.phrase, r["size"]): r.f for r in phrases.collect()} == {k: v for k, v in want.items() if v >= 3}
    assert {r.lang: r.n for r in n.collect()} == {k: v for k, v in total.items() if v}


def test_no_shuffle_of_positions(spark):
    rows = spark.range(1000).select(F.col("id").alias("piece"), F.lit(0).alias("pos"), F.col("id")).union(spark.range(1000).select("id", F.lit(1), F.col("id") + 1))
    keep = C.Relations(spark, 4)
    name = keep.write(rows, False)
    with C.co_partitioned(spark):
        joined = keep.joined(name)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and joined.count() == 1000
        assert plan.count("Sort [") == 1  # one side is read as it was sorted
    keep.drop(name)


def test_nothing_frequent_and_empty(spark):
    assert C.collocations(frame(spark, mixed()).limit(0)).count() == 0
    assert C.collocations(frame(spark, [(1, "a b c", "en")])).count() == 0
    big = spark.createDataFrame([("en", "x y", 2, 5 * 10**18), ("en", "x", 1, 5 * 10**18), ("en", "y", 1, 10**17)], "lang string, phrase string, size int, f long")
    assert C.scored(big).first()["score"] == 2_000_000 * 5 * 10**18 // (5 * 10**18 + 10**17)
