"""Ranked lexical search over range-maximum sparse tables.

Every document row is cut into terms once and packed: its length and, for the terms some item asks for, their numbers and
occurrences. Counts over the packed rows give the weights. A task then reads packed rows, a block of at most
``BLOCK_POSTINGS`` postings at a time, and builds for the block one posting list per term, ordered by document, with a
sparse table of the places of largest impact over all lists. A search keeps intervals of documents, best bound first:
the bound of an interval is the sum, over the item's terms, of the weight times the largest impact of the term inside the
interval, read from the sparse table in two steps. The best intervals are split at the document of their largest single
contribution: that document is scored exactly, and the two rests go back with bounds of their own. A search ends when no
bound reaches the score of the item's k-th best document so far, which is carried from block to block of a task. Each
task returns at most ``k`` documents per item, and two windows merge them.

Scale: documents are never shuffled, only packed rows are written, and only running top lists leave a task. Items are
taken in blocks of bounded bytes, so the dictionary that every task gets is bounded however many items there are; each
block of items is one pass over the documents.

Defined results: a null text has no terms; rows that share an item_id are one item with all their terms; each document
row counts for itself, so repeated rows rank one after another; equal scores are ordered by doc_id, null first; items
without a match give no row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from seekwell.llm.common import LOWER, UPPER, clean_input, cut

K = 50
BLOCK_POSTINGS, STEP = 1_000_000, 128
# Bytes of item texts of one block of items.
ITEM_BYTES = 4_000_000
SALTS = 64
# A term is a run of digits, letters and everything beyond ASCII; A-Z count as a-z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def pack(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, ids, tfs) for each document with a term: its number of terms, and the numbers and occurrences of those in ``numbers``, as int32."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, lengths, ids, tfs = [], [], [], []
            for at, text in enumerate(b.column("text")):
                words = terms(text.as_py())
                if words:
                    found, times = np.unique(np.array([numbers[w] for w in words if w in numbers], dtype=np.int32), return_counts=True)
                    kept.append(at)
                    lengths.append(len(words))
                    ids.append(found.tobytes())
                    tfs.append(times.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(kept, pa.int64())), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary()), pa.array(tfs, pa.binary())], ["doc_id", "n", "ids", "tfs"])

    return clean_input(docs).mapInArrow(packed, f"doc_id {kind}, n long, ids binary, tfs binary")


def frequencies(packed: DataFrame) -> DataFrame:
    """(id, df): documents per term number, summed inside each task first."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(0, np.int64)
        for b in batches:
            now = np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), np.int32))
            if len(now) > len(sums):
                sums = np.concatenate([sums, np.zeros(len(now) - len(sums), np.int64)])
            sums[:len(now)] += now
        ids = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(sums[ids])], ["id", "df"])

    return packed.select("ids").mapInArrow(counted, "id int, df long").groupBy("id").agg(F.sum("df").alias("df"))


class Block:
    """Posting lists of some documents, one after another by term, and their sparse table of places of largest impact."""

    def __init__(self, ids: list[np.ndarray], tfs: list[np.ndarray], norms: np.ndarray, n_terms: int):
        self.docs = len(ids)
        term = np.concatenate(ids).astype(np.int64) if ids else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(self.docs, dtype=np.int64), [len(x) for x in ids])
        tf = np.concatenate(tfs).astype(np.int64) if tfs else np.zeros(0, np.int64)
        order = np.lexsort((doc, term))
        term, self.doc, tf = term[order], doc[order], tf[order]
        self.key = term * self.docs + self.doc
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 20 * norms[self.doc]) if len(tf) else tf
        self.first = np.searchsorted(term, np.arange(n_terms + 1))
        longest = int(np.diff(self.first).max(initial=1))
        levels = [np.arange(len(term), dtype=np.int32)]
        # places whose span runs past the end of the array hold no valid maximum and are never asked for
        while 2 ** len(levels) <= longest:
            half, low = 2 ** (len(levels) - 1), levels[-1]
            a, b = low[:-half], low[half:]
            levels.append(np.concatenate([np.where(self.impact[a] >= self.impact[b], a, b), low[-half:]]).astype(np.int32))
        self.table = np.stack(levels)
        self.log = np.zeros(longest + 2, dtype=np.int64)
        for i in range(2, longest + 2):
            self.log[i] = self.log[i // 2] + 1

    def best(self, lo: np.ndarray, hi: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For intervals given as ranges of places (rows) in each list (columns): the bound, the document of the largest
        contribution, and which intervals hold any posting."""
        size = hi - lo
        some = size > 0
        level = self.log[np.where(some, size, 1)]
        left = self.table[level, np.where(some, lo, 0)]
        right = self.table[level, np.where(some, hi - (1 << level), 0)]
        place = np.where(self.impact[left] >= self.impact[right], left, right)
        part = np.where(some, w * self.impact[place], -1)
        top = part.argmax(axis=1)
        return np.maximum(part, 0).sum(axis=1), self.doc[place[np.arange(len(place)), top]], some.any(axis=1)

    def search(self, asked: np.ndarray, w: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that contain all documents of the block among the item's best ``k``, given that ``k`` documents
        with scores of at least ``least`` are known from elsewhere (0: none); documents at the border are all kept."""
        docs, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        asked, w = asked[w > 0], w[w > 0]
        lo, hi = self.first[asked][None, :], self.first[asked + 1][None, :]
        kept = (hi > lo)[0]
        asked, w, lo, hi = asked[kept], w[kept], lo[:, kept], hi[:, kept]
        if not len(asked):
            return docs[0], scores[0]
        bound, split, _ = self.best(lo, hi, w)
        high = np.zeros(0, np.int64)  # the k best scores so far
        while len(bound):
            pick = np.argpartition(-bound, STEP)[:STEP] if len(bound) > STEP else np.arange(len(bound))
            a, b, m = lo[pick], hi[pick], split[pick]
            rest = np.ones(len(bound), bool)
            rest[pick] = False
            place = np.searchsorted(self.key, asked[None, :] * self.docs + m[:, None])
            place = np.clip(place, a, b)
            holds = (place < b) & (self.doc[np.minimum(place, len(self.doc) - 1)] == m[:, None])
            score = np.where(holds, w * self.impact[np.minimum(place, len(self.doc) - 1)], 0).sum(axis=1)
            docs.append(m)
            scores.append(score)
            high = np.sort(np.concatenate([high, score]))[-k:]
            if len(high) == k:
                least = max(least, int(high[0]))
            new_lo, new_hi = np.concatenate([a, place + holds]), np.concatenate([place, b])
            new_bound, new_split, some = self.best(new_lo, new_hi, w)
            good = some & (new_bound >= max(least, 1))
            rest &= bound >= least
            lo, hi = np.concatenate([lo[rest], new_lo[good]]), np.concatenate([hi[rest], new_hi[good]])
            bound, split = np.concatenate([bound[rest], new_bound[good]]), np.concatenate([split[rest], new_split[good]])
        docs, scores = np.concatenate(docs), np.concatenate(scores)
        good = scores >= max(least, 1)
        return docs[good], scores[good]


def _order(pair) -> tuple:
    score, doc_id = pair
    return -score, doc_id is not None, doc_id if doc_id is not None else 0


def _searched(packed: DataFrame, items: DataFrame, wanted: list[tuple], weights: np.ndarray, n_docs: int, n_all: int, k: int, block_postings: int) -> DataFrame:
    """(item_id, doc_id, score): at most ``k`` documents per item and task."""
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((items, "item_id"), (packed, "doc_id"))}
    asked = [(item, np.array(ids, np.int64), weights[ids]) for item, ids in wanted]

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: list[list] = [[] for _ in asked]
        held: list[pa.RecordBatch] = []

        def look() -> None:
            rows = pa.Table.from_batches(held)
            ids = [np.frombuffer(x, np.int32) for x in rows.column("ids").to_pylist()]
            tfs = [np.frombuffer(x, np.int32) for x in rows.column("tfs").to_pylist()]
            names = rows.column("doc_id").to_pylist()
            norms = 100 - 50 + (50 * rows.column("n").to_numpy() * n_docs) // n_all
            block = Block(ids, tfs, norms, len(weights))
            for i, (_, mine, w) in enumerate(asked):
                docs, scores = block.search(mine, w, k, tops[i][-1][0] if len(tops[i]) == k else 0)
                if len(docs):
                    tops[i] = sorted(tops[i] + [(s, names[d]) for d, s in zip(docs.tolist(), scores.tolist())], key=_order)[:k]

        postings, kind = 0, None
        for b in batches:
            kind = b.schema
            for at in range(0, len(b), 500):
                part = b.slice(at, 500)
                held.append(part)
                postings += sum(map(len, part.column("ids").to_pylist())) // 4
                if postings >= block_postings:
                    look()
                    held, postings = [], 0
        if held:
            look()
        if kind is not None:
            rows = [(item, d, s) for (item, _, _), top in zip(asked, tops) for s, d in top]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], out[0]), pa.array([r[1] for r in rows], kind.field("doc_id").type), pa.array([r[2] for r in rows], pa.int64())], ["item_id", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    out = [to_arrow_type(items.schema["item_id"].dataType)]
    return packed.mapInArrow(searched, f"item_id {kinds['item_id']}, doc_id {kinds['doc_id']}, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = K, item_bytes: int = ITEM_BYTES, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item with a score above 0."""
    asked = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = asked.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("bytes")).first()["bytes"]
    blocks = max(1, math.ceil(total / item_bytes))
    parts = [_block(docs, asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i) if blocks > 1 else asked, k, block_postings) for i in range(blocks)]
    found = reduce(DataFrame.unionAll, parts).withColumn("_salt", F.spark_partition_id() % SALTS)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    first = found.withColumn("rank", F.row_number().over(W.partitionBy("item_id", "_salt").orderBy(*order))).filter(F.col("rank") <= k)
    best = first.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")


def _block(docs: DataFrame, items: DataFrame, k: int, block_postings: int) -> DataFrame:
    texts: dict = {}
    for r in items.collect():  # one block of items, bounded by ``item_bytes``
        texts.setdefault(r["item_id"], set()).update(terms(r["text"]))
    numbers = {t: i for i, t in enumerate(sorted(set().union(*texts.values())))} if texts else {}
    packed = cut(pack(docs, numbers), "packed")
    sums = packed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")).first()
    df = np.zeros(len(numbers), np.int64)
    for r in frequencies(packed).collect():  # one row per term of the block of items
        df[r["id"]] = r["df"]
    weights = np.array([weight(sums["n"], int(d)) for d in df], dtype=np.int64)
    wanted = [(item, sorted(numbers[t] for t in mine)) for item, mine in texts.items() if mine]
    return _searched(packed, items, wanted, weights, sums["n"], max(sums["all"], 1), k, block_postings)


def sql(k: int = K) -> str:
    found = r"regexp_extract_all(translate(coalesce(text, ''), '%s', '%s'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')" % (UPPER, LOWER)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS uid, doc_id, {found} AS ts FROM documents),
sized AS (SELECT uid, doc_id, len(ts) AS n FROM docs WHERE len(ts) > 0),
totals AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM sized),
asked AS (SELECT DISTINCT item_id, unnest({found}) AS term FROM benchmark),
postings AS (SELECT uid, term, count(*) AS tf FROM (SELECT uid, unnest(ts) AS term FROM docs) GROUP BY uid, term HAVING term IN (SELECT term FROM asked)),
weights AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), totals),
norms AS (SELECT uid, doc_id, 100 - 50 + ((50 * n * big_n) // big_l) AS m FROM sized, totals),
scored AS (SELECT a.item_id, d.uid, d.doc_id, sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * d.m)))::BIGINT AS score
  FROM asked a JOIN weights w USING (term) JOIN postings p USING (term) JOIN norms d USING (uid) GROUP BY a.item_id, d.uid, d.doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored WHERE score > 0)
WHERE rank <= {k}"""
