"""Postings in blocks of documents, searched in place with bounds.

A block is one row: some documents, their lengths, and for every token its postings with the largest weight and the
smallest length among them. From these two a search knows, for any scoring parameters, a bound of what the token can
add in this block. Blocks hold whole documents, so a search needs no shuffle of postings: each task adds up bounds per
(query, block), scores the best blocks first and skips the rest as soon as a bound falls below the query's k-th best
score. Over many blocks a pilot of about ``PILOT`` blocks gives every task a first lower bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from seekwell.operators.ranking import top_k
from seekwell.scale import scratch_path

# Documents of one block.
BLOCK_DOCS = 256
# Bytes of one row group of stored blocks. A row is a whole block, and readers hold the rows of a row group at once, so
# with the usual row groups a task would hold a hundred blocks and more, decoded.
ROW_GROUP_BYTES = 4 * 1024 * 1024
# Bytes of the blocks a search makes ready at a time.
CHUNK_BYTES = 16 * 1024 * 1024
# Blocks that give the first lower bounds; up to twice as many blocks are searched without a pilot.
PILOT = 32
# Scores are rounded to this many digits before they are compared.
DIGITS = 6
_MARGIN = 2e-6

# Weight of a posting in its document, from its stored weight and the document's length; must grow with the first and
# not grow with the second.
Impact = Callable[[np.ndarray, np.ndarray], np.ndarray]


def block_schema(id_type: str) -> str:
    return f"docid array<{id_type}>, dl array<int>, token array<string>, n array<int>, top array<double>, low array<double>, least array<int>, doc array<int>, weight array<double>"


def _block(ids: pa.Array, dl: np.ndarray, token: np.ndarray, names: pa.Array, doc: np.ndarray, weight: np.ndarray) -> list:
    """One row from postings sorted by token number, then document."""
    starts = np.flatnonzero(np.diff(token, prepend=-1)) if len(token) else np.zeros(0, np.int64)
    lengths = dl[doc]
    some = len(starts) > 0
    return [ids, dl.astype(np.int32), names.take(pa.array(token[starts], pa.int64())), np.diff(np.append(starts, len(token))).astype(np.int32),
            np.maximum.reduceat(weight, starts) if some else weight, np.minimum.reduceat(weight, starts) if some else weight,
            np.minimum.reduceat(lengths, starts).astype(np.int32) if some else lengths.astype(np.int32), doc.astype(np.int32), weight]


def _batch(rows: list[list], id_type: pa.DataType) -> pa.RecordBatch:
    """Rows of :func:`_block` as one batch; lists are put together without a Python object per value."""
    kinds = [id_type, pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.float64()]
    columns = []
    for at, kind in enumerate(kinds):
        parts = [r[at] if isinstance(r[at], pa.Array) else pa.array(r[at], kind) for r in rows]
        parts = [p.cast(kind) for p in parts]
        ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(parts) if parts else pa.array([], kind)))
    return pa.RecordBatch.from_arrays(columns, ["docid", "dl", "token", "n", "top", "low", "least", "doc", "weight"])


def blocks_of_texts(docs: DataFrame, vocabulary: list[str] | None = None, stop: list[str] | None = None, size: int = BLOCK_DOCS) -> DataFrame:
    """Blocks of ``(docid, toks)``; the weight is the number of occurrences, the length that of the whole token list.
    With a ``vocabulary`` only its tokens get postings. Documents of similar length share a block, which keeps bounds tight."""
    kind = docs.schema["docid"].dataType
    wanted = docs.sparkSession.sparkContext.broadcast(vocabulary) if vocabulary is not None else None
    id_type = to_arrow_type(kind)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(wanted.value, pa.string()) if wanted is not None else None
        left_out = pa.array(stop, pa.string()) if stop else None
        for b in batches:
            lists = b.column("toks")
            lengths = np.maximum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
            order = np.argsort(lengths, kind="stable")
            for at in range(0, len(b), size):
                mine = order[at:at + size]
                part = lists.take(pa.array(mine))
                coded = pc.list_flatten(part).cast(pa.string()).dictionary_encode()
                names, code = coded.dictionary, pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(len(mine)), lengths[mine])
                use = np.ones(len(names), bool)
                if known is not None:
                    use &= pc.is_in(names, value_set=known).to_numpy(zero_copy_only=False)
                if left_out is not None:
                    use &= ~pc.is_in(names, value_set=left_out).to_numpy(zero_copy_only=False)
                good = (code >= 0) & use[code] if len(names) else np.zeros(len(code), bool)
                key, times = np.unique(code[good] * len(mine) + doc[good], return_counts=True)
                row = _block(b.column("docid").take(pa.array(mine)), lengths[mine], key // len(mine), names, key % len(mine), times.astype(np.float64))
                yield _batch([row], id_type)

    return docs.select("docid", "toks").mapInArrow(build, block_schema(kind.simpleString()))


def blocks_of_postings(postings: DataFrame, size: int = BLOCK_DOCS) -> DataFrame:
    """Blocks of long rows ``(docid, token, weight, dl)``, which are first brought together by document."""
    kind = postings.schema["docid"].dataType
    id_type = to_arrow_type(kind)
    placed = postings.select("docid", "token", F.col("weight").cast("double").alias("weight"), F.col("dl").cast("int").alias("dl")).repartition("docid").sortWithinPartitions("docid")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(table: pa.Table, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(ends) - 1, size):
                cuts = ends[at:at + size + 1]
                t = table.slice(cuts[0], cuts[-1] - cuts[0]).combine_chunks()
                coded = t.column("token").combine_chunks().dictionary_encode()
                names, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
                order = np.lexsort((doc, code))
                first = pa.array(cuts[:-1] - cuts[0])
                ids, dl = t.column("docid").combine_chunks().take(first), t.column("dl").combine_chunks().take(first).to_numpy()
                yield _batch([_block(ids, dl.astype(np.int64), code[order], names, doc[order], t.column("weight").to_numpy()[order])], id_type)

        held = None
        for b in batches:
            table = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            ids = table.column("docid").combine_chunks()
            starts = np.flatnonzero(np.append(True, pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False))) if len(ids) else np.zeros(1, int)
            # the last document may go on in the next batch; only whole blocks leave before the end
            whole = (len(starts) - 1) // size * size
            if whole:
                yield from rows(table, starts[:whole + 1])
            held = table.slice(starts[whole])
        if held is not None and len(held):
            ids = held.column("docid").combine_chunks()
            starts = np.flatnonzero(np.append(True, pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)))
            yield from rows(held, np.append(starts, len(held)))

    return placed.mapInArrow(build, block_schema(kind.simpleString()))


def postings_of(blocks: DataFrame) -> DataFrame:
    """``(docid, token, tf, dl)`` rows of blocks."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                at = {c: b.column(c)[i].values for c in ("docid", "dl", "token", "n", "doc", "weight")}
                token = at["token"].take(pa.array(np.repeat(np.arange(len(at["token"])), at["n"].to_numpy())))
                yield pa.RecordBatch.from_arrays([at["docid"].take(at["doc"]), token, at["weight"].cast(pa.int32()), at["dl"].take(at["doc"])], ["docid", "token", "tf", "dl"])

    kind = blocks.schema["docid"].dataType.elementType.simpleString()
    return blocks.mapInArrow(rows, f"docid {kind}, token string, tf int, dl int")


def write_blocks(blocks: DataFrame, path: str) -> DataFrame:
    """Store blocks (and columns beside them) in row groups that a task can hold, and read them back."""
    options = {"parquet.block.size": str(ROW_GROUP_BYTES), "parquet.page.size.row.check.min": "2", "parquet.page.size.row.check.max": "16"}
    blocks.write.mode("overwrite").options(**options).parquet(path)
    return blocks.sparkSession.read.schema(blocks.schema).parquet(path)


def cut_blocks(blocks: DataFrame, name: str = "blocks") -> DataFrame:
    """:func:`write_blocks` below the shared folder."""
    return write_blocks(blocks, scratch_path(blocks.sparkSession, name))


def chunks(batches: Iterator[pa.RecordBatch], size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of blocks in slices of about ``size`` bytes, one block at least."""
    for b in batches:
        step = max(1, len(b) * (size or CHUNK_BYTES) // max(b.nbytes, 1))
        for at in range(0, len(b), step):
            yield b.slice(at, step)


def term_counts(blocks: DataFrame) -> DataFrame:
    """``(token, df)``: documents per token."""
    return blocks.select(F.inline(F.arrays_zip("token", "n"))).groupBy("token").agg(F.sum("n").cast("long").alias("df"))


def corpus_counts(blocks: DataFrame) -> DataFrame:
    """One row ``(n_docs, n_tokens, n_blocks)``."""
    tokens = F.aggregate("dl", F.lit(0).cast("long"), lambda a, x: a + x)
    return blocks.select(F.size("docid").alias("_d"), tokens.alias("_t")).agg(
        F.coalesce(F.sum("_d"), F.lit(0)).cast("long").alias("n_docs"), F.coalesce(F.sum("_t"), F.lit(0)).cast("long").alias("n_tokens"), F.count(F.lit(1)).alias("n_blocks"))


class Chunk:
    """Blocks of one Arrow batch, ready to be searched for the tokens of ``vocabulary``."""

    def __init__(self, b: pa.RecordBatch, vocabulary: pa.Array, impact: Impact):
        flat = {c: pc.list_flatten(b.column(c)) for c in ("docid", "token", "doc", "weight")}
        num = lambda c: pc.list_flatten(b.column(c)).to_numpy(zero_copy_only=False)
        size = lambda c: pc.list_value_length(b.column(c)).to_numpy(zero_copy_only=False).astype(np.int64)
        self.blocks, self.ids = len(b), flat["docid"]
        docs_before = np.cumsum(np.append(0, size("docid")))
        code = pc.fill_null(pc.index_in(flat["token"], value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        n, block = num("n").astype(np.int64), np.repeat(np.arange(len(b)), size("token"))
        start = np.cumsum(np.append(0, n))[:-1]
        bound_high, bound_low = impact(num("top"), num("least").astype(np.float64)), num("low")
        order = np.argsort(code, kind="stable")[int((code < 0).sum()):]  # by token, then block
        self.first = np.searchsorted(code[order], np.arange(len(vocabulary) + 1))
        self.block, self.start, self.count = block[order], start[order], n[order]
        self.high = np.maximum(bound_high[order], 0)
        self.low = np.minimum(bound_low[order], 0)
        self.doc = flat["doc"].to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(docs_before[:-1], size("doc"))
        self.weight = impact(flat["weight"].to_numpy(zero_copy_only=False), num("dl").astype(np.float64)[self.doc])
        self.size = int(docs_before[-1])

    def search(self, tokens: np.ndarray, w: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, how many were scored): all documents of this chunk that can be among the best ``k``, given that
        ``k`` documents with scores of at least ``least`` exist. A document without a shared token never comes back."""
        lens = self.first[tokens + 1] - self.first[tokens]
        entry = np.repeat(self.first[tokens] - np.cumsum(np.append(0, lens[:-1])), lens) + np.arange(lens.sum())
        weight = np.repeat(w, lens)
        if not len(entry):
            return np.zeros(0, np.int64), np.zeros(0), 0
        bound = np.bincount(self.block[entry], np.where(weight > 0, weight * self.high[entry], weight * self.low[entry]), self.blocks)
        hit = np.bincount(self.block[entry], minlength=self.blocks) > 0
        ranked = np.flatnonzero(hit)[np.argsort(-bound[hit], kind="stable")]
        docs, scores, seen, at, step = [], [], 0, 0, 1
        best = np.zeros(0)
        while at < len(ranked):
            mine = ranked[at:at + step]
            mine = mine[bound[mine] >= least - _MARGIN]
            if not len(mine):
                break
            at, step = at + step, step * 2
            chosen = np.zeros(self.blocks, bool)
            chosen[mine] = True
            use = chosen[self.block[entry]]
            e, we = entry[use], weight[use]
            n = self.count[e]
            place = np.repeat(self.start[e] - np.cumsum(np.append(0, n[:-1])), n) + np.arange(n.sum())
            doc = self.doc[place]
            total = np.bincount(doc, np.repeat(we, n) * self.weight[place], self.size)
            found = np.flatnonzero(np.bincount(doc, minlength=self.size))
            score = np.round(total[found], DIGITS)
            seen += len(found)
            good = (score != 0) & (score >= least)
            docs.append(found[good])
            scores.append(score[good])
            best = np.concatenate([best, score[good]])
            if len(best) >= k:
                best = np.partition(best, len(best) - k)[-k:]
                least = max(least, float(best.min()))
        docs, scores = (np.concatenate(docs), np.concatenate(scores)) if docs else (np.zeros(0, np.int64), np.zeros(0))
        good = scores >= least
        return docs[good], scores[good], seen


@dataclass
class Asked:
    """Queries as numbers: ``qids``, their token numbers and weights, and a lower bound of the k-th score each."""

    qids: list
    vocabulary: list[str]
    tokens: list[np.ndarray]
    weights: list[np.ndarray]
    least: np.ndarray

    @staticmethod
    def of(terms: pd.DataFrame) -> "Asked":
        """From rows (qid, token, w), which may name a token of a query more than once."""
        terms = terms[terms["w"].notna()].groupby(["qid", "token"], as_index=False, sort=True)["w"].sum()
        code, vocabulary = pd.factorize(terms["token"])
        cuts = np.flatnonzero(np.append(True, terms["qid"].to_numpy()[1:] != terms["qid"].to_numpy()[:-1])) if len(terms) else np.zeros(0, int)
        split = lambda a: np.split(a, cuts[1:]) if len(cuts) else []
        qids = terms["qid"].iloc[cuts].tolist()
        return Asked(qids, vocabulary.tolist(), split(code.astype(np.int64)), split(terms["w"].to_numpy(np.float64)), np.full(len(qids), -np.inf))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Best ``k``, equal scores by id."""
    if len(scores) > k:
        good = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[good], scores[good]
    by_id = np.argsort(ids, kind="stable")
    order = by_id[np.argsort(-scores[by_id], kind="stable")][:k]
    return ids[order], scores[order]


def _local_tops(blocks: DataFrame, asked: Asked, qid_type, impact: Impact, k: int) -> DataFrame:
    """``(qid, docid, score)``: each task's best ``k`` per query."""
    kind = blocks.schema["docid"].dataType.elementType
    shared = blocks.sparkSession.sparkContext.broadcast(asked)
    q_type, d_type = to_arrow_type(qid_type), to_arrow_type(kind)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        vocabulary = pa.array(q.vocabulary, pa.string())
        tops: list = [None] * len(q.qids)
        for b in chunks(batches):
            chunk = Chunk(b, vocabulary, impact)
            names = chunk.ids.to_numpy(zero_copy_only=False)
            for i, (tokens, w) in enumerate(zip(q.tokens, q.weights)):
                least = q.least[i] if tops[i] is None or len(tops[i][1]) < k else max(q.least[i], tops[i][1][-1])
                docs, scores, _ = chunk.search(tokens, w, k, least)
                if len(docs):
                    ids = names[docs]
                    if tops[i] is not None:
                        ids, scores = np.concatenate([tops[i][0], ids]), np.concatenate([tops[i][1], scores])
                    tops[i] = _best(ids, scores, k)
        some = [i for i, t in enumerate(tops) if t is not None]
        if some:
            qid = pa.array(q.qids, q_type).take(pa.array(np.repeat(some, [len(tops[i][1]) for i in some])))
            yield pa.RecordBatch.from_arrays([qid, pa.array(np.concatenate([tops[i][0] for i in some]), d_type), pa.array(np.concatenate([tops[i][1] for i in some]))], ["qid", "docid", "score"])

    return blocks.mapInArrow(search, f"qid {qid_type.simpleString()}, docid {kind.simpleString()}, score double")


def search_blocks(blocks: DataFrame, n_blocks: int, terms: pd.DataFrame, qid_type, impact: Impact, k: int, pilot: int = PILOT) -> DataFrame:
    """Top ``k`` per query ``(qid, docid, score, rank)`` by the sum of ``w`` times impact over shared tokens.

    ``terms`` are the rows (qid, token, w) of one bounded block of queries."""
    asked = Asked.of(terms)
    if n_blocks > 2 * pilot and asked.qids:
        some = blocks.filter(F.pmod(F.xxhash64("docid"), F.lit(n_blocks // pilot)) == 0)
        first = top_k(_local_tops(some, asked, qid_type, impact, k), "qid", "score", k).filter(F.col("rank") == k).select("qid", "score").collect()
        known = {r["qid"]: r["score"] for r in first}  # one number per query of the block
        asked.least = np.array([known.get(q, -np.inf) for q in asked.qids])
    return top_k(_local_tops(blocks, asked, qid_type, impact, k), "qid", "score", k)


def rebuilt(blocks: DataFrame, size: int = BLOCK_DOCS) -> DataFrame:
    """``blocks`` put together into blocks of about ``size`` documents, without the documents whose places an array
    column ``dead`` names (null: none). Each task joins neighbours only; nothing moves."""
    kind = blocks.schema["docid"].dataType.elementType
    id_type = to_arrow_type(kind)
    names = [f.split()[0] for f in block_schema("x").split(", ")]

    def joined(rows: list[dict]) -> pa.RecordBatch | None:
        ids, lengths, tokens, docs, weights, before = [], [], [], [], [], 0
        for r in rows:
            dl, doc = r["dl"].to_numpy(), r["doc"].to_numpy().astype(np.int64)
            keep = np.ones(len(dl), bool)
            keep[r["dead"]] = False
            place = np.cumsum(keep) - 1 + before
            token = r["token"].take(pa.array(np.repeat(np.arange(len(r["token"])), r["n"].to_numpy())))
            alive = keep[doc]
            ids.append(r["docid"].filter(pa.array(keep)))
            lengths.append(dl[keep])
            tokens.append(token.filter(pa.array(alive)))
            docs.append(place[doc[alive]])
            weights.append(r["weight"].to_numpy()[alive])
            before += int(keep.sum())
        if not before:
            return None
        coded = pa.concat_arrays(tokens).cast(pa.string()).dictionary_encode()
        code, doc = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(docs)
        order = np.lexsort((doc, code))
        return _batch([_block(pa.concat_arrays(ids), np.concatenate(lengths).astype(np.int64), code[order], coded.dictionary, doc[order], np.concatenate(weights)[order])], id_type)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for i in range(len(b)):
                row = {c: b.column(c)[i].values for c in ("docid", "dl", "token", "n", "doc", "weight")}
                row["dead"] = np.array(b.column("dead")[i].as_py() or [], dtype=np.int64)
                held.append(row)
                n += len(row["docid"]) - len(row["dead"])
                if n >= size:
                    made, held, n = joined(held), [], 0
                    if made is not None:
                        yield made
        made = joined(held) if held else None
        if made is not None:
            yield made

    rows = blocks if "dead" in blocks.columns else blocks.withColumn("dead", F.lit(None).cast("array<int>"))
    return rows.select(*names, "dead").mapInArrow(build, block_schema(kind.simpleString()))
