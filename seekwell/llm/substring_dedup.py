"""Substring deduplication of word windows by super-k-mers.

Every window of ``WINDOW`` words has a minimiser: the run of ``GRAM`` words inside it with the smallest hash, the
leftmost of equals. Consecutive windows that share it travel as one packed string (their words joined) to the bucket of
the minimiser, so a window of any document meets its equals in one bucket and almost no word is sent ``WINDOW`` times.
Strings for the same part leave a task as one compressed block. In a bucket equal strings are taken together, the
windows of the different ones are sorted, and each run of equal windows gives the smallest document that has it. A
bucket with one document needs no look at its strings.

A sample of the documents shows which minimisers are hot (above ``HOT`` rows). Their strings take a second exact way
without buckets: every task sends each of its distinct hot strings once, with the smallest document that has it there;
equal strings and equal windows are aggregated; and a second scan of the documents looks its hot strings up in that
table of distinct strings, which is broadcast below a measured size and joined by string and salt beyond. Only hot
strings leave Python on this way, occurrences only in the salted join. The sample chooses the way, never the result.

Defined results: null and empty texts have no words; a document with a null id neither loses words nor takes any from
others; rows that share an id do not take words from each other; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from seekwell.llm.common import BROADCAST_BYTES, clean_input, cut, merged_spans, sized_broadcast, squeeze, unsqueeze

WINDOW, GRAM = 13, 4
# Rows of a hot minimiser; numbers of hot minimisers that every task may hold (8 bytes each); share of the sample.
HOT, MOST_HOT, SAMPLE = 200_000, 1_000_000, 0.02
HELD_STRINGS, SALTS = 100_000, 16
CHUNK_WORDS, BLOCK_WORDS, PART_BYTES = 100_000, 1_000_000, 8 << 20


def word_list(text: str | None) -> list[bytes]:
    """Words between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def runs(words: list[bytes], document: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, minimiser) of the super-k-mers in ``words``; ``document`` tells where texts change."""
    n = len(words) - window + 1
    if n <= 0:
        return (np.zeros(0, dtype=np.int64),) * 3
    codes, distinct = pd.factorize(np.array(words, dtype=object))
    one = np.array([xxhash.xxh64_intdigest(w) for w in distinct], dtype=np.uint64)[codes]
    size = len(one) - gram + 1
    mixed = np.zeros(size, dtype=np.uint64)
    for k in range(gram):
        mixed = (mixed ^ one[k:k + size]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    best, at = mixed[:n].copy(), np.arange(n)
    for k in range(1, window - gram + 1):
        less = mixed[k:k + n] < best
        best[less], at[less] = mixed[k:k + n][less], np.flatnonzero(less) + k
    inside = document[:n] == document[window - 1:window - 1 + n]
    first = np.flatnonzero(inside & np.concatenate([[True], (at[1:] != at[:-1]) | ~inside[:-1] | (document[1:n] != document[:n - 1])]))
    last = np.flatnonzero(inside & np.concatenate([(at[1:] != at[:-1]) | ~inside[1:] | (document[1:n] != document[:n - 1]), [True]]))
    return first, last, best[first].view(np.int64)


def chunk(rows: list[tuple], window: int) -> tuple:
    """(rows, minimisers, owners, first words, packed strings) of the super-k-mers in (doc_id, rep, words) rows."""
    words = [w for _, _, ws in rows for w in ws]
    sizes = np.array([len(ws) for _, _, ws in rows])
    document = np.repeat(np.arange(len(rows)), sizes)
    first, last, mini = runs(words, document, window)
    owner = document[first] if len(first) else np.zeros(0, dtype=np.int64)
    start = first - np.concatenate([[0], sizes.cumsum()[:-1]])[owner]
    return rows, mini, owner, start, [b" ".join(words[a:b]) for a, b in zip(first.tolist(), (last + window).tolist())]


def known_texts(docs: DataFrame) -> DataFrame:
    return clean_input(docs).filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", rep_of("text").alias("rep"), "text")


def chunks(batches: Iterator[pd.DataFrame], window: int) -> Iterator[tuple]:
    """:func:`chunk` of some documents at a time."""
    for b in batches:
        rows, n = [], 0
        for doc_id, rep, text in zip(b["doc_id"], b["rep"], b["text"]):
            rows.append((doc_id, rep, word_list(text)))
            n += len(rows[-1][2])
            if n > CHUNK_WORDS:
                yield chunk(rows, window)
                rows, n = [], 0
        if rows:
            yield chunk(rows, window)


def minimisers(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(mini, n): super-k-mers per minimiser, summed in chunks of documents first."""
    def emitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, mini, *_ in chunks(batches, window):
            mini, n = np.unique(mini, return_counts=True)
            yield pd.DataFrame({"mini": mini, "n": n})

    return known_texts(docs).mapInPandas(emitted, "mini long, n long").groupBy("mini").agg(F.sum("n").alias("n"))


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which ``values`` stand in the sorted array ``ordered``."""
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def hot_strings(docs: DataFrame, hot: Broadcast, window: int) -> DataFrame:
    """(packed, first): the distinct super-k-mers of hot minimisers with the smallest document that has them. A task sends
    a string once, unless it holds more than ``HELD_STRINGS``."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()

    def emitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for rows, mini, owner, _, packed in chunks(batches, window):
            for k in np.flatnonzero(among(mini, hot.value)).tolist():
                doc_id, string = rows[owner[k]][0], packed[k]
                if string not in held or doc_id < held[string]:
                    held[string] = doc_id
            if len(held) > HELD_STRINGS:
                yield pd.DataFrame({"packed": list(held), "first": list(held.values())})
                held = {}
        if held:
            yield pd.DataFrame({"packed": list(held), "first": list(held.values())})

    return known_texts(docs).mapInPandas(emitted, f"packed binary, first {kind}").groupBy("packed").agg(F.min("first").alias("first"))


def hot_places(docs: DataFrame, hot: Broadcast, window: int) -> DataFrame:
    """(packed, doc_id, place) of every super-k-mer of a hot minimiser."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()

    def emitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, mini, owner, start, packed in chunks(batches, window):
            mine = np.flatnonzero(among(mini, hot.value))
            place = np.array([r[1] for r in rows], dtype=np.int64)[owner[mine]] << 32 | start[mine]
            yield pd.DataFrame({"packed": [packed[k] for k in mine.tolist()], "doc_id": [rows[k][0] for k in owner[mine].tolist()], "place": place})

    return known_texts(docs).mapInPandas(emitted, f"packed binary, doc_id {kind}, place long")


def looked_up(docs: DataFrame, hot: Broadcast, table: Broadcast, window: int) -> DataFrame:
    """(doc_id, place, size) of the covered runs, with the table of hot strings in every task."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()

    def emitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, mini, owner, start, packed in chunks(batches, window):
            found = []
            for k in np.flatnonzero(among(mini, hot.value)).tolist():
                doc_id, rep, _ = rows[owner[k]]
                found += covered_runs(doc_id, rep << 32 | int(start[k]), table.value.get(packed[k], ()), window)
            yield pd.DataFrame(found, columns=["doc_id", "place", "size"])

    return known_texts(docs).mapInPandas(emitted, f"doc_id {kind}, place long, size int")


def rep_of(text: str):
    """31 bits that tell rows with one id but different texts apart."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 33).cast("int")


def blocks(docs: DataFrame, parts: int, hot: Broadcast, window: int = WINDOW) -> DataFrame:
    """(part, doc_ids, reps, mini, owner, start, sizes, packed): the super-k-mers of some documents for one part."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    names = ["part", "doc_ids", "reps", "mini", "owner", "start", "sizes", "packed"]

    def emitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []  # (documents, runs) of chunks

        def flush() -> pd.DataFrame:
            ids = [r[0] for rows, *_ in held for r in rows]
            reps = np.array([r[1] for rows, *_ in held for r in rows], dtype=np.int64)
            mini, start, packed = np.concatenate([h[1] for h in held]), np.concatenate([h[3] for h in held]), [x for h in held for x in h[4]]
            at = np.cumsum([0, *[len(h[0]) for h in held[:-1]]])
            owner = np.concatenate([h[2] + lo for h, lo in zip(held, at)])
            held.clear()
            part = (mini.view(np.uint64) >> np.uint64(33)).astype(np.int64) % parts
            keep = np.flatnonzero(~among(mini, hot.value))
            keep = keep[np.argsort(part[keep], kind="stable")]
            cuts, out = np.searchsorted(part[keep], np.arange(parts + 1)).tolist(), []
            for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if b > a:
                    mine = keep[a:b]
                    docs_, local = np.unique(owner[mine], return_inverse=True)
                    strings = [packed[k] for k in mine.tolist()]
                    out.append((p, [ids[k] for k in docs_.tolist()], squeeze(reps[docs_]), squeeze(mini[mine].astype(np.int32)), squeeze(local.astype(np.int32)), squeeze(start[mine].astype(np.int32)),
                                squeeze(np.array([len(x) for x in strings], dtype=np.int32)), zstandard.ZstdCompressor(level=3).compress(b"".join(strings))))
            return pd.DataFrame(out, columns=names)

        rows, n, total = [], 0, 0
        for b in batches:
            for doc_id, rep, text in zip(b["doc_id"], b["rep"], b["text"]):
                rows.append((doc_id, rep, word_list(text)))
                n += len(rows[-1][2])
                if n > CHUNK_WORDS:
                    held.append(chunk(rows, window))
                    total, rows, n = total + n, [], 0
                    if total > BLOCK_WORDS:
                        yield flush()
                        total = 0
        if rows:
            held.append(chunk(rows, window))
        if held:
            yield flush()

    schema = f"part int, doc_ids array<{kind}>, reps binary, mini binary, owner binary, start binary, sizes binary, packed binary"
    return known_texts(docs).mapInPandas(emitted, schema)


def bucket(rows: list[tuple], window: int) -> list[tuple]:
    """(doc_id, place, words) of the covered runs among the (doc_id, place, packed) of one bucket."""
    seen: dict[bytes, list] = {}
    for doc_id, place, packed in rows:
        seen.setdefault(packed, []).append((doc_id, place))
    entries, first = [], []
    for s, (packed, where) in enumerate(seen.items()):
        words, least = packed.split(b" "), min(d for d, _ in where)
        first.append([None] * (len(words) - window + 1))
        entries += [(b" ".join(words[k:k + window]), least, s, k) for k in range(len(words) - window + 1)]
    entries.sort()
    before = least = None
    for win, doc_id, s, k in entries:
        if win != before:
            before, least = win, doc_id
        first[s][k] = least
    found = []
    for s, where in enumerate(seen.values()):
        for doc_id, place in where:
            found += covered_runs(doc_id, place, first[s], window)
    return found


def covered_runs(doc_id, place: int, first, window: int) -> list[tuple]:
    """(doc_id, place, words) of the runs of windows whose smallest document ``first`` lies below ``doc_id``."""
    found, k = [], 0
    while k < len(first):
        if first[k] < doc_id:
            start = k
            while k + 1 < len(first) and first[k + 1] < doc_id:
                k += 1
            found.append((doc_id, place + start, k - start + window))
        k += 1
    return found


def in_buckets(packed: DataFrame, kind: str, window: int) -> DataFrame:
    """(doc_id, place, size) of the covered runs, part by part."""
    def judged(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        ids, sizes = [list(x) for x in f["doc_ids"]], [unsqueeze(x, "i4") for x in f["sizes"]]
        text = [zstandard.ZstdDecompressor().decompress(x) for x in f["packed"]]
        ends = [x.cumsum(dtype=np.int64) for x in sizes]
        mini = np.concatenate([unsqueeze(x, "i4") for x in f["mini"]])
        owner, start = [unsqueeze(x, "i4") for x in f["owner"]], [unsqueeze(x, "i4").astype(np.int64) for x in f["start"]]
        reps = [unsqueeze(x, "i8") for x in f["reps"]]
        block = np.repeat(np.arange(len(f)), [len(x) for x in sizes])
        row = np.concatenate([np.arange(len(x)) for x in sizes])
        document = np.concatenate([x + lo for x, lo in zip(owner, np.cumsum([0, *[len(x) for x in ids[:-1]]]))])
        order = np.argsort(mini, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], mini[order][1:] != mini[order][:-1]]))
        first, last = np.minimum.reduceat(document[order], edge), np.maximum.reduceat(document[order], edge)
        found = []
        for lo, hi in zip(edge[first != last].tolist(), np.append(edge, len(order))[1:][first != last].tolist()):
            rows = []
            for k in order[lo:hi].tolist():
                b, r = block[k], row[k]
                d, end = owner[b][r], int(ends[b][r])
                rows.append((ids[b][d], int(reps[b][d]) << 32 | int(start[b][r]), text[b][end - int(sizes[b][r]):end]))
            found += bucket(rows, window)
        return pd.DataFrame(found, columns=["doc_id", "place", "size"])

    return packed.groupBy("part").applyInPandas(judged, f"doc_id {kind}, place long, size int")


def first_documents(strings: DataFrame, window: int) -> DataFrame:
    """(packed, firsts): for each distinct string the smallest document of each of its windows, in order."""
    named = strings.withColumn("_w", F.split(F.col("packed").cast("string"), " "))
    windows = named.select("packed", "first", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("_w") - window + 1), lambda i: F.array_join(F.slice("_w", i, window), " "))).alias("k", "win"))
    windows = cut(windows, "hot-windows")
    least = windows.groupBy("win").agg(F.min("first").alias("least"))
    rows = windows.join(least, "win").groupBy("packed").agg(F.array_sort(F.collect_list(F.struct("k", "least"))).alias("f"))  # as long as the string
    return rows.select("packed", F.transform("f", lambda x: x["least"]).alias("firsts"))


def without_buckets(docs: DataFrame, hot: Broadcast, window: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, place, size) of the covered runs of hot minimisers."""
    table = cut(first_documents(hot_strings(docs, hot, window), window), "hot")
    size = table.agg(F.coalesce(F.sum(F.octet_length("packed") + 40 * F.size("firsts") + 100), F.lit(0)).alias("bytes")).first()["bytes"]
    if size <= limit:
        held = {bytes(r["packed"]): tuple(r["firsts"]) for r in table.toLocalIterator()}  # below ``limit`` bytes
        return looked_up(docs, hot, docs.sparkSession.sparkContext.broadcast(held), window)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    places = hot_places(docs, hot, window).withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    hit = places.join(salted, ["packed", "_salt"]).select("doc_id", "place", F.posexplode("firsts").alias("k", "least")).filter(F.col("least") < F.col("doc_id"))
    return hit.select("doc_id", (F.col("place") + F.col("k")).alias("place"), F.lit(window).alias("size"))


def covered(docs: DataFrame, window: int = WINDOW, hot: int = HOT, sample: float = SAMPLE, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, rep, spans): runs of words (start, size) to remove, for every text that has any."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    hot = max(hot, size // 32 // MOST_HOT)  # a super-k-mer takes more than 32 bytes of text, so at most MOST_HOT numbers come back
    few = minimisers(docs.sample(sample, seed=11), window).filter(F.col("n") > max(1, hot * sample)).select("mini").collect()
    often = docs.sparkSession.sparkContext.broadcast(np.array(sorted(r["mini"] for r in few), dtype=np.int64))
    found = in_buckets(blocks(docs, max(1, -(-size // PART_BYTES)), often, window), kind, window)
    if few:
        found = found.unionAll(without_buckets(docs, often, window, limit))
    return merged_spans(found.select("doc_id", F.shiftright("place", 32).cast("int").alias("rep"), F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("start"), "size"), ["doc_id", "rep"])


def deduplicated(docs: DataFrame, window: int = WINDOW, with_text: bool = False, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256[, kept]."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    spans = covered(docs, window, **options).withColumnsRenamed({"doc_id": "_id", "rep": "_rep"})
    spans = sized_broadcast_once(spans, options.get("limit", BROADCAST_BYTES))
    keyed = clean_input(docs).withColumn("rep", rep_of("text"))
    joined = keyed.join(spans, (keyed["doc_id"] == spans["_id"]) & (keyed["rep"] == spans["_rep"]), "left").select("doc_id", "text", "spans")

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, text, spans_ in zip(b["doc_id"], b["text"], b["spans"]):
                words = word_list(text)
                n = len(words)
                if spans_ is not None:
                    keep = np.ones(n, dtype=bool)
                    for s in spans_:
                        keep[s["start"]:s["start"] + s["size"]] = False
                    words = [words[k] for k in np.flatnonzero(keep).tolist()]
                kept = b" ".join(words)
                out.append((doc_id, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass"))[:5 if with_text else 4])
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][:5 if with_text else 4])

    return joined.mapInPandas(cut_out, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)


def sized_broadcast_once(spans: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The spans, written once, with a broadcast hint when small."""
    return sized_broadcast(cut(spans, "spans"), 32 + 16 * F.size("spans"), limit)


def sql() -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+') AS w FROM documents),
g AS (SELECT uid, doc_id, i, array_to_string(w[i:i+{WINDOW - 1}], ' ') AS win FROM (SELECT uid, doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
c AS (SELECT DISTINCT uid, p FROM (SELECT uid, unnest(range(i, i + {WINDOW})) AS p FROM (SELECT uid, i, doc_id, min(doc_id) OVER (PARTITION BY win) AS least FROM g) WHERE least < doc_id)),
k AS (SELECT uid, w, i FROM (SELECT uid, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
t AS (SELECT k.uid, string_agg(w[i], ' ' ORDER BY i) AS kept, count(*) AS n FROM k LEFT JOIN c ON k.uid = c.uid AND k.i = c.p WHERE c.p IS NULL GROUP BY k.uid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(t.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (uid)"""
