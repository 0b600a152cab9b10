"""Helpers several operators of this subpackage share."""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seekwell.scale import cut, scratch_path  # noqa: F401  (re-exported for the operators)

# Fixed patterns of the word definitions: separators of plain words, and everything that is not a normalised word.
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A side is broadcast only when a count of all its bytes stays below this.
BROADCAST_BYTES = 32 * 1024 * 1024


def plain_words(text: Column) -> Column:
    """Words between ASCII white space, unchanged; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def ascii_lower(word: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def sized_broadcast(df: DataFrame, row_bytes: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its measured size is below ``limit``; otherwise as it is, for a shuffled join."""
    total = df.agg(F.coalesce(F.sum(row_bytes), F.lit(0)).alias("bytes")).first()["bytes"]
    return F.broadcast(df) if total <= limit else df


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _k1, _k2): the id and a hash of the text. Rows that agree in both are repeats of one document, so
    the key survives a second scan, which a generated row number need not."""
    return clean_input(docs).withColumns({"_k1": F.col("doc_id"), "_k2": F.xxhash64(F.coalesce("text", F.lit("")))})


def with_row_key(docs: DataFrame) -> DataFrame:
    """(_row, _k1, _k2): whole rows as one column, so that no name can clash, beside their key."""
    return short_batches(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_k1"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_k2"))


def by_key(keyed: DataFrame) -> DataFrame:
    """Rows of :func:`with_row_key` as an operator reads them, with the key in the place of the id: rows that share an
    id are then judged by their own texts."""
    return keyed.select(F.struct("_k1", "_k2").alias("doc_id"), F.col("_row.text").alias("text"))


def same_key(a: DataFrame, b: DataFrame) -> Column:
    return a["_k1"].eqNullSafe(b["_k1"]) & (a["_k2"] == b["_k2"])


# Rows of one Arrow batch: documents can be long, and a batch is held several times on its way to Python.
BATCH_ROWS = 2_000


def short_batches(docs: DataFrame) -> DataFrame:
    """``docs``, after the session was told to hand rows to Python in batches of at most ``BATCH_ROWS``. The setting has
    no other effect and stays, because plans run later than they are made."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(docs.sparkSession.conf.get(name, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        docs.sparkSession.conf.set(name, str(BATCH_ROWS))
    return docs


def clean_input(docs: DataFrame) -> DataFrame:
    """Only the columns an operator reads, so that clashing names of other columns cannot matter, in short batches."""
    return short_batches(docs).select("doc_id", "text")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (columns a, b); the root is the smallest node of the
    component. Alternating large and small stars, each round written to shared storage, so lineage stays short and a
    chain of any length ends after a logarithmic number of rounds. Nothing but two totals reaches the driver."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    e = cut(e, "links")
    before = None
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = large.join(low, "a").select(F.explode(pairs).alias("p")).select("p.a", "p.b").filter("a <> b").distinct()
        e = cut(small, "components")
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def whole_groups(batches, columns: list[str]):
    """Rows of sorted pandas batches, cut only where a group of ``columns`` ends."""
    import pandas as pd

    rest = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        keys = b[columns].to_numpy()
        same = (keys == keys[-1]).all(axis=1)
        end = len(b) - int(same[::-1].cumprod().sum())  # the last group may go on in the next batch
        if end:
            yield b.iloc[:end]
        rest = b.iloc[end:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def squeeze(values: np.ndarray) -> bytes:
    """Integers or floats as compressed byte planes."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes() if len(values) else b""
    return zstandard.ZstdCompressor(level=3).compress(planes)


def unsqueeze(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def merged_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, spans) from (keys, start, size): overlapping spans become one. The rows of one text meet in one task; there
    are fewer than places in the text, for each of its repeats."""
    text = W.partitionBy(*keys).orderBy("start", "size")
    before = F.max(F.col("start") + F.col("size")).over(text.rowsBetween(W.unboundedPreceding, -1))
    fresh = spans.withColumn("_fresh", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
    runs = fresh.withColumn("_run", F.sum("_fresh").over(text)).groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end"))
    return runs.groupBy(*keys).agg(F.collect_list(F.struct("start", (F.col("end") - F.col("start")).alias("size"))).alias("spans"))
