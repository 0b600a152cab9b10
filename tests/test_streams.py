"""Growing index and rolling history over many micro-batches, in any order and after a restart."""

import random

import pytest
from pyspark.sql import functions as F

from seekwell.operators import blocks as B, lexical as L
from seekwell.scale import scratch_path
from seekwell.streaming import service as St
from seekwell.streaming.growing import GrowingIndex

SPLIT = lambda c: F.split(c, " ")


def key(run):
    return sorted((r.qid, r.docid, r.score, r["rank"]) for r in run.collect())


def test_fifty_batches_in_few_parts(spark, monkeypatch):
    """Every third batch sends an old document again; the index equals a rebuild of the last versions."""
    rnd = random.Random(1)
    index, last = GrowingIndex(spark, scratch_path(spark, "grow")), {}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for b in range(50):
            rows = {f"d{b}": " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9)))}
            if b % 3 == 2:
                rows[f"d{rnd.randrange(b)}"] = " ".join(rnd.choice("xyz") for _ in range(4))
            last |= rows
            index.add(spark.createDataFrame(list(rows.items()), "docid string, text string").coalesce(1), b, SPLIT)
            if b in (6, 21, 49):
                parts = index.parts()
                assert len(parts) <= 3 * (1 + len(bin(b)) // 2) and [p.first for p in parts] == sorted({p.first for p in parts})
                whole = L.build_index(spark.createDataFrame(list(last.items()), "docid string, text string"))
                topics = spark.createDataFrame([(0, "a x"), (1, "h b z"), (2, "none")], "qid long, query string")
                got = index.index()
                assert key(L.bm25_search(got, topics, 8, length_norm=True)) == key(L.bm25_search(whole, topics, 8, length_norm=True))
                assert got.stats.first().n_docs == len(last)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(index.parts()) == 5  # 50 = 3 * 16 + 2


def test_replayed_batch_replaces_itself(spark):
    index = GrowingIndex(spark, scratch_path(spark, "replay"), fanout=2)
    frame = lambda *rows: spark.createDataFrame(list(rows), "docid long, text string")
    index.add(frame((1, "a"), (2, "b")), 0, SPLIT)
    index.add(frame((1, "c"), (1, "a c")), 1, SPLIT)
    before = index.parts()
    index.add(frame((1, "c"), (1, "a c")), 1, SPLIT)  # the batch failed after its last write
    assert index.parts() == before and len(before) == 1
    index.add(frame(), 2, SPLIT)
    assert index.parts() == before
    index.add(frame((2, "c c"), (3, None)), 3, SPLIT)
    got = index.index()
    assert sorted((r.docid, r.token, r.tf) for r in got.postings.collect()) == [(1, "c", 1), (2, "c", 2)]
    assert tuple(got.stats.first())[:2] == (3, 3)


def test_rebuilt_blocks_keep_everything(spark):
    docs = spark.createDataFrame([(i, " ".join(f"t{i % 5}" for _ in range(i % 4))) for i in range(100)] + [(100, None)], "docid long, text string")
    small = B.blocks_of_texts(L.build_index(docs).docs, None, size=7)
    big = B.rebuilt(small.coalesce(1), 50)
    assert sorted(map(tuple, B.postings_of(big).collect())) == sorted(map(tuple, B.postings_of(small).collect()))
    assert B.corpus_counts(big).first()[:2] == B.corpus_counts(small).first()[:2] and big.count() < small.count()
    dead = B.rebuilt(small.withColumn("dead", F.when(F.array_contains("docid", F.lit(0)), F.sequence(F.lit(0), F.size("docid") - 1))))
    gone = set(small.filter(F.array_contains("docid", F.lit(0))).first()["docid"])
    assert {d for r in dead.collect() for d in r.docid} == set(range(101)) - gone


def turns_batch(rows, keep):
    out = {}
    for conv in {c for c, *_ in rows}:
        mine = sorted((t, x) for c, t, x, *_ in rows if c == conv)
        for i, (t, _) in enumerate(mine):
            out[conv, t] = "\n".join(x or "" for _, x in mine[max(0, i - keep + 1):i + 1])
    return out


def run_history(spark, folder, schema, out, check, **options):
    turns = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    St.history_stream(turns, 3, out, check, **options).awaitTermination()
    return {(r.conv_id, r.turn): r.history for r in St.read_history(spark, out).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_history_of_shuffled_batches_and_restart(spark, seed):
    rnd = random.Random(seed)
    rows = [(c, t, f"{c}-{t}" if t != 4 else None) for c in ("a", "b", "c") for t in range(rnd.randint(1, 9))]
    rnd.shuffle(rows)
    folder, out, check = (scratch_path(spark, n) for n in ("turn-files", "turns", "state"))
    schema = "conv_id string, turn long, text string"
    half = len(rows) // 2
    for part in (rows[:half // 2], rows[half // 2:half]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    assert run_history(spark, folder, schema, out, check) == turns_batch(rows[:half], 3)
    changed = [(c, t, "changed") if (c, t) == rows[0][:2] else (c, t, x) for c, t, x in rows]
    for part in (rows[half:] + rows[1:2], [r for r in changed if r[2] == "changed"]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    assert run_history(spark, folder, schema, out, check) == turns_batch(changed, 3)
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_event_time_bounds_the_state(spark):
    """Turns within the allowed delay are put in their place; a conversation that was idle long enough starts anew."""
    schema = "conv_id string, turn long, text string, at timestamp"
    folder, out, check = (scratch_path(spark, n) for n in ("timed-files", "timed", "state"))
    at = lambda minute: F.timestamp_seconds(F.lit(1_700_000_000 + 60 * minute))
    rows = [[("a", 0, 0), ("a", 1, 1), ("a", 3, 3), ("b", 0, 1)], [("a", 2, 2), ("a", 4, 8)], [("b", 1, 200)], [("z", 0, 400)], [("z", 1, 401)], [("a", 9, 402)]]
    for part in rows:
        df = spark.createDataFrame([(c, t, f"{c}{t}", m) for c, t, m in part], "conv_id string, turn long, text string, m long")
        df.withColumn("at", F.timestamp_seconds(1_700_000_000 + 60 * F.col("m"))).drop("m").coalesce(1).write.mode("append").parquet(folder)
    got = run_history(spark, folder, schema, out, check, time="at", late="10 minutes", idle_ms=60 * 60_000)
    assert [got["a", t] for t in range(5)] == ["a0", "a0\na1", "a0\na1\na2", "a1\na2\na3", "a2\na3\na4"]
    assert got["z", 1] == "z0\nz1" and got["a", 9] == "a9"
