"""Benchmark decontamination: windows of test words, looked up in every document.

The windows of all benchmark items form a hash table that is broadcast when its measured size allows. Each document
row produces its window hashes in generated code, looks them up without a shuffle, and a hit counts only if the words
themselves agree. Of a document only the hits and one carrier row leave the task.

A larger table is joined by hash: documents are cut into words once, only (document, place, hash) meet the hashes of the
table, and the few that agree are verified against the words, so no text is moved for each of its places.

Defined results: null or empty texts have no words and are never contaminated; an item without words has no window;
null item ids still mark words but are not listed; repeated documents are judged each; empty tables give empty
results or no hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seekwell.llm.common import BROADCAST_BYTES, ascii_lower, by_key, clean_input, cut, same_key, sized_broadcast, with_row_key

# A word is a run of digits, Latin letters and everything beyond ASCII; A-Z is lowered after splitting.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10


def words(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAK), ""), ascii_lower)


def window_hash(column: str, at: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(F.col(column), at + i) for i in range(length)])


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: length, hash, words and the ids of all items that have them."""
    items = benchmark.select("item_id", words(F.col("text")).alias("_words")).filter(F.size("_words") > 0)
    size = F.least(F.size("_words"), F.lit(window))
    placed = items.select("item_id", "_words", size.alias("_len"), F.explode(F.sequence(F.lit(0), F.size("_words") - size)).alias("_at"))
    return (placed.select("item_id", "_len", F.slice("_words", F.col("_at") + 1, F.col("_len")).alias("_window"))
            .groupBy("_len", "_window").agg(F.collect_set("item_id").alias("_items"))
            .withColumn("_hash", F.xxhash64(*[F.get("_window", F.lit(i)) for i in range(window)])))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, hit word positions, item ids, and what follows from them."""
    windows = item_windows(benchmark, window)
    lengths = sorted(r[0] for r in windows.select("_len").distinct().collect())  # at most ``window`` numbers
    table = sized_broadcast(windows, F.octet_length(F.array_join("_window", " ")) + 16 * F.size("_items") + 64, limit)
    if table is windows:
        return _shuffled(docs, cut(windows, "windows"), lengths or [window], limit)
    rows = clean_input(docs).select(F.monotonically_increasing_id().alias("_uid"), "doc_id", words(F.col("text")).alias("_words"))
    # missing words at the end of a text are null and skipped by the hash; the comparison of words rejects such hits
    at = rows.select("_uid", "doc_id", "_words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("_words") - 1, F.lit(0)))).alias("_at"))
    probes = [F.struct(F.lit(n).alias("len"), window_hash("_words", F.col("_at"), n).alias("hash")) for n in lengths or [window]]
    if len(probes) == 1:
        at = at.withColumns({"_plen": probes[0]["len"], "_phash": probes[0]["hash"]})
    else:
        at = at.withColumn("_probe", F.explode(F.array(*probes))).withColumns({"_plen": F.col("_probe.len"), "_phash": F.col("_probe.hash")}).drop("_probe")
    hit = (F.col("_phash") == F.col("_hash")) & (F.col("_plen") == F.col("_len")) & (F.slice("_words", F.col("_at") + 1, F.col("_plen")) == F.col("_window"))
    found = at.join(table, hit, "left").filter(F.col("_hash").isNotNull() | (F.col("_at") == 0))
    spans = found.select("_uid", "doc_id", F.size("_words").cast("long").alias("n_words"), "_items",
                         F.when(F.col("_hash").isNotNull(), F.sequence("_at", F.col("_at") + F.col("_len") - 1)).alias("_span"))
    each = spans.groupBy("_uid", "doc_id", "n_words").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_span")))).alias("hit_words"),
        F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_set("_items"))), lambda i: i.cast("string"))).alias("items"))
    return _counted(each)


def _counted(each: DataFrame) -> DataFrame:
    return each.select("doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"), "hit_words", "items")


def _shuffled(docs: DataFrame, table: DataFrame, lengths: list[int], limit: int) -> DataFrame:
    """The same for a table of windows that is too large for every task."""
    rows = cut(clean_input(docs).select(F.monotonically_increasing_id().alias("_uid"), "doc_id", words(F.col("text")).alias("_words")), "words")
    at = rows.filter(F.size("_words") > 0).select("_uid", "_words", F.explode(F.sequence(F.lit(0), F.size("_words") - 1)).alias("_at"))
    probes = [F.struct(F.lit(n).alias("_len"), window_hash("_words", F.col("_at"), n).alias("_hash")) for n in lengths]
    probed = at.select("_uid", "_at", F.explode(F.array(*[F.when(F.col("_at") + n <= F.size("_words"), p) for n, p in zip(lengths, probes)])).alias("p")).filter("p IS NOT NULL").select("_uid", "_at", "p.*")
    # places that agree by hash, written before they fetch the words and meet their items
    agreed = cut(probed.join(table.select("_len", "_hash").distinct(), ["_len", "_hash"], "left_semi"), "agreed")
    near = sized_broadcast(agreed.join(table, ["_len", "_hash"]), F.octet_length(F.array_join("_window", " ")) + 16 * F.size("_items") + 64, limit)
    found = rows.select("_uid", "_words").join(near, "_uid").filter(F.slice("_words", F.col("_at") + 1, F.col("_len")) == F.col("_window"))
    spans = found.select("_uid", "_items", F.sequence("_at", F.col("_at") + F.col("_len") - 1).alias("_span"))
    each = spans.groupBy("_uid").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_span")))).alias("hit_words"),
        F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_set("_items"))), lambda i: i.cast("string"))).alias("items"))
    named = rows.select("_uid", "doc_id", F.size("_words").cast("long").alias("n_words")).join(each, "_uid", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return _counted(named.select("doc_id", "n_words", none("hit_words", "int"), none("items", "string")))


def without_spans(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """``docs`` whose hit words are cut out of the text; separators stay. ``hits``: rows of :func:`contamination` for
    documents with unique ids."""
    found = hits.filter("contaminated").select(F.col("doc_id").alias("_id"), F.col("hit_words").alias("_hit"))
    keyed = with_row_key(docs)
    text = F.col("_row.text")
    gaps = F.split(text, WORD, -1)
    kept = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    pieces = lambda g, w, hit: F.transform(g, lambda s, i: F.concat(s, F.when(F.array_contains(hit, i), F.lit("")).otherwise(F.coalesce(F.get(w, i), F.lit("")))))
    joined = keyed.join(found, F.col("_k1") == F.col("_id"), "left")
    new = F.when(F.col("_hit").isNull(), text).otherwise(F.array_join(pieces(gaps, kept, F.col("_hit")), ""))
    return joined.select(*[(new if c == "text" else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def without_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark window; all columns stay."""
    keyed = with_row_key(docs)
    dirty = contamination(by_key(keyed), benchmark, window).filter("contaminated").select("doc_id._k1", "doc_id._k2").distinct()
    dirty = sized_broadcast(cut(dirty, "dirty"), F.lit(24))  # written, so that measuring it does not scan the texts again
    return keyed.join(dirty, same_key(keyed, dirty), "left_anti").select("_row.*")


def sql() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH b AS (SELECT item_id, regexp_extract_all({lower}, '{word}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(w[i:i+least(len(w), {WINDOW})-1], ' ') AS win, least(len(w), {WINDOW}) AS n
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all({lower}, '{word}') AS w FROM documents),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT uid, i, n, array_to_string(w[i:i+n-1], ' ') AS win FROM (SELECT uid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT uid, i, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
cover AS (SELECT uid, count(DISTINCT p) AS n FROM (SELECT uid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY uid),
its AS (SELECT uid, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT uid, item_id::VARCHAR AS s FROM hits) GROUP BY uid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(cover.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(cover.n, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (uid) LEFT JOIN its USING (uid)"""
