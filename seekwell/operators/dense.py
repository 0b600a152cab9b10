"""Exact and approximate nearest neighbours over array columns."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seekwell.functions.vectors import mix, vec_cos, vec_dot, vec_l2
from seekwell.operators.ranking import top_k
from seekwell.scale import BROADCAST_BYTES, scratch_path, stack

# Vectors of one block of lists, which a task holds, and corpus vectors of one block of the grid, which a task reads as a stream.
BLOCK_ROWS, STREAM_ROWS = 100_000, 400_000
# Cells of one score block, which bounds the memory of a task, and corpus vectors of one block.
BLOCK_CELLS, BLOCK_WIDTH = 2_000_000, 8192
# Bytes of the queries a task holds, with their vectors and running best.
QUERY_BYTES = 32 * 1024 * 1024
# Scores are compared after rounding to this many digits; nothing further below the border can round up to it.
DIGITS, _MARGIN = 6, 2e-6


def _matrix(column) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64) if len(column) else np.zeros((0, 1))


def _prepare(m: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cos":
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(norm == 0, 1, norm)
    return m


def _scores(q: np.ndarray, d: np.ndarray, metric: str) -> np.ndarray:
    """Larger is better; L2 is negated. Not rounded."""
    if metric == "l2":
        sq = (q * q).sum(1)[:, None] + (d * d).sum(1)[None, :] - 2 * q @ d.T
        return -np.sqrt(np.maximum(sq, 0))
    return q @ d.T


def _borders(scores: np.ndarray, k: int) -> np.ndarray:
    """A lower bound of the ``k``-th best cell of each row: the ``k``-th best of the largest cells of many runs of columns."""
    width = scores.shape[1]
    if width <= k:
        return np.full(len(scores), -np.inf)
    runs = width // max(1, width // (8 * k))
    cells = scores[:, :width // runs * runs].reshape(len(scores), runs, -1)
    most = cells.max(axis=2)
    if not (most < np.inf).all():  # cells that are no numbers count for nothing
        most = np.where(np.isfinite(cells), cells, -np.inf).max(axis=2)
    return np.partition(most, runs - k, axis=1)[:, runs - k]


def _single(m: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return m.astype(np.float32)


def _places(marks: np.ndarray) -> np.ndarray:
    """Flat places of the marked cells, few among many: eight are read at once."""
    flat = marks.ravel()
    even = len(flat) // 8 * 8
    eights = np.flatnonzero(flat[:even].view(np.uint64))
    some = (eights[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([some[flat[some]], even + np.flatnonzero(flat[even:])])


class Tops:
    """Running best ``k`` of each query, equal scores by id, in arrays of a fixed size: the ``n`` best found so far lie
    first, best first. Once a query has ``k``, products in single precision, with a bound of their error, tell which cells
    can still be among them; only those are scored in full."""

    def __init__(self, qids: np.ndarray, q: np.ndarray, k: int, metric: str, skip_self: bool):
        self.qids, self.q, self.k, self.metric, self.skip_self = qids, q, k, metric, skip_self
        self.ids, self.best, self.n = None, np.full((len(qids), k), -np.inf), np.zeros(len(qids), np.int64)
        # the nearest by L2 have the largest product less half the square of the corpus vector
        wide = np.hstack([q, np.ones((len(q), 1))]) if metric == "l2" else q
        self.single, self.norm, self.square = _single(wide), np.sqrt((wide * wide).sum(1)), (q * q).sum(1)

    def add(self, ids: np.ndarray, d: np.ndarray, mine: np.ndarray | None = None) -> None:
        """Take in vectors ``d`` for all queries, or for those at the places ``mine``."""
        places = np.arange(len(self.qids)) if mine is None else mine
        if not len(ids) or not len(places):
            return
        kind = ids.dtype if ids.dtype.kind in "iuf" else np.dtype(object)
        if self.ids is None:
            self.ids = np.zeros((len(self.qids), self.k), kind)
        elif self.ids.dtype != kind:  # vectors without an id make other ids numbers that can be missing
            self.ids = self.ids.astype(np.promote_types(self.ids.dtype, kind))
        width = min(BLOCK_CELLS, max(BLOCK_WIDTH, 16 * self.k))
        first = width if self.n.any() else max(1, width // 4)  # the first block is scored in full
        order = np.argsort(ids, kind="stable")
        own = self._own(ids[order]) if self.skip_self else None
        edges = [0, *range(first, len(ids), width), len(ids)]
        for left, right in zip(edges, edges[1:]):
            part = order[left:right]
            self._add_part(places, ids[part], d[part], left, own)

    def _own(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """For each query the range of places that have its id."""
        if (ids.dtype == object) != (self.qids.dtype == object):
            return None  # ids of other types are never equal
        return np.searchsorted(ids, self.qids, "left"), np.searchsorted(ids, self.qids, "right")

    def _add_part(self, places: np.ndarray, ids: np.ndarray, d: np.ndarray, left: int, own) -> None:
        square = (d * d).sum(1)
        wide = np.hstack([d, square[:, None] / -2]) if self.metric == "l2" else d
        use = np.isfinite(d).all(1)  # others are no hits
        single, norm, most = _single(wide).T, np.sqrt((wide * wide).sum(1).max(where=use, initial=0)), square.max(where=use, initial=0)
        step = max(1, BLOCK_CELLS // len(ids))
        for i in range(0, len(places), step):
            at = places[i:i + step]
            # numbers that single precision does not hold, and queries without k hits, are scored in full
            small = (self.best[at, self.k - 1] > -np.inf) & (self.norm[at] * norm < 1e30) & (self.norm[at] < 1e30) & (norm < 1e30)
            for rows, near in ((at[~small], False), (at[small], True)):
                if not len(rows):
                    continue
                if near and (found := self._near(rows, single, norm, most)) is not None:
                    row, column = found
                    value = self._exact(rows[row], d, column, square)
                else:
                    row, column, value = self._full(rows, d, left, own)
                self._keep(rows, ids, row, column, value, left, own)

    def _near(self, at: np.ndarray, single: np.ndarray, norm: float, most: float) -> tuple[np.ndarray, np.ndarray] | None:
        """Rows and columns of the cells that can be among the best; None if these are many."""
        border = self.best[at, self.k - 1]
        border = border - _MARGIN - 1e-15 * np.abs(border)
        error = (len(single) + 4) * 2.0 ** -23 * self.norm[at] * norm
        if self.metric == "l2":
            square = self.square[at]
            error += (len(single) + 4) * 2.0 ** -50 * (square + most + border * border)
            border = (square - border * border) / 2
        least = np.nextafter(_single(border - error), np.float32(-np.inf))
        found = _places(self.single[at] @ single >= least[:, None])
        if len(found) > len(at) * single.shape[1] // 32:
            return None
        return np.divmod(found, single.shape[1])

    def _exact(self, row: np.ndarray, d: np.ndarray, column: np.ndarray, square: np.ndarray) -> np.ndarray:
        """Scores of single cells."""
        dot = np.einsum("ij,ij->i", self.q[row], d[column])
        if self.metric == "l2":
            return -np.sqrt(np.maximum(self.square[row] + square[column] - 2 * dot, 0))
        return dot

    def _full(self, at: np.ndarray, d: np.ndarray, left: int, own) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, columns and scores of the cells that can be among the best, from the scores of all cells."""
        scores = _scores(self.q[at], d, self.metric)
        if own is not None:
            low, high = (np.clip(x[at] - left, 0, len(d)) for x in own)
            for row in np.flatnonzero(high > low):
                scores[row, low[row]:high[row]] = -np.inf
        known = self.best[at, self.k - 1]  # -inf until k are known
        border = known if np.isfinite(known).all() else np.maximum(known, _borders(scores, self.k))
        row, column = np.divmod(np.flatnonzero(scores >= (border - _MARGIN - 1e-15 * np.abs(border))[:, None]), scores.shape[1])
        return row, column, scores[row, column]

    def _keep(self, at: np.ndarray, ids: np.ndarray, row: np.ndarray, column: np.ndarray, value: np.ndarray, left: int, own) -> None:
        """Rank cells among the best so far."""
        value, last = np.round(value, DIGITS), self.best[at, self.k - 1][row]
        use = np.isfinite(value) & (value >= last)
        tie = np.flatnonzero(use & (value == last))
        use[tie] = ~(ids[column[tie]] >= self.ids[at[row[tie]], self.k - 1])
        if own is not None:
            low, high = (x[at][row] - left for x in own)
            use &= (column < low) | (column >= high)
        row, column, value = row[use], column[use], value[use]
        if not len(row):
            return
        # the best so far of the rows that have something new, and the new cells, as one list to be ranked
        hit = np.unique(row)
        n = self.n[at[hit]]
        old_row, old_place = np.repeat(hit, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        every_id = np.concatenate([self.ids[at[old_row], old_place], ids[column]])
        every, rows = np.concatenate([self.best[at[old_row], old_place], value]), np.concatenate([old_row, row])
        by_id = np.argsort(every_id, kind="stable")
        order = by_id[np.lexsort((-every[by_id], rows[by_id]))]
        rows = rows[order]
        starts = np.searchsorted(rows, np.arange(len(at)))
        place = np.arange(len(rows)) - starts[rows]
        keep = place < self.k
        rows, place, order = rows[keep], place[keep], order[keep]
        self.ids[at[rows], place], self.best[at[rows], place] = every_id[order], every[order]
        self.n[at[hit]] = np.bincount(rows, minlength=len(at))[hit]

    def frames(self) -> Iterator[pd.DataFrame]:
        """(qid, docid, score) of all queries, a bounded number of rows at a time."""
        step = max(1, BLOCK_CELLS // 8 // self.k)
        for at in range(0, len(self.qids) if self.ids is not None else 0, step):
            n = self.n[at:at + step]
            row, place = np.repeat(np.arange(at, at + len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pd.DataFrame({"qid": self.qids[row], "docid": self.ids[row, place], "score": self.best[row, place]})


def query_bytes(dims, k: int):
    """Bytes a task holds for one query of ``dims`` cells (a number or a Column): its vector and its best ``k``, which are
    written out once."""
    return dims * 8 + 48 * k + 64


def _run_schema(q: DataFrame, c: DataFrame) -> str:
    kind = lambda df, name: df.schema[name].dataType.simpleString()
    return f"qid {kind(q, 'qid')}, docid {kind(c, 'docid')}, score double"


def dense_search(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "ip", skip_self: bool = False) -> DataFrame:
    """Exact top ``k`` by inner product, cosine or (ascending) L2.

    ``queries`` is ``(qid, embedding)``, ``corpus`` is ``(docid, embedding)``. Queries that stay below a bound, with
    their best ``k``, travel to every task, and the corpus is scanned in place without a shuffle. More queries are cut into
    blocks and paired with corpus blocks. Both ways a task reads the corpus vectors as a stream and holds a running top ``k``
    in arrays of a fixed size.
    """
    q = queries.select("qid", "embedding")
    c = corpus.select("docid", "embedding")
    size = _held(q, k)
    best = _scan(q, c, k, metric, skip_self) if size <= min(QUERY_BYTES, BROADCAST_BYTES) else _grid(q, c, size, k, metric, skip_self)
    run = top_k(best, "qid", "score", k)
    return run.withColumn("score", -F.col("score")) if metric == "l2" else run


def _held(q: DataFrame, k: int) -> int:
    return q.agg(F.coalesce(F.sum(query_bytes(F.greatest(F.coalesce(F.size("embedding"), F.lit(0)), F.lit(0)).cast("long"), k)), F.lit(0)).alias("bytes")).first()["bytes"]


def _scan(q: DataFrame, c: DataFrame, k: int, metric: str, skip_self: bool) -> DataFrame:
    local = q.toPandas().sort_values("qid")
    shared = q.sparkSession.sparkContext.broadcast(
        (local["qid"].to_numpy(), _prepare(_matrix(local["embedding"]), metric)))

    def search(batches):
        tops = Tops(*shared.value, k, metric, skip_self)
        for pdf in batches:
            tops.add(pdf["docid"].to_numpy(), _prepare(_matrix(pdf["embedding"]), metric))
        yield from tops.frames()

    return c.mapInPandas(search, _run_schema(q, c))


def _grid(q: DataFrame, c: DataFrame, size: int, k: int, metric: str, skip_self: bool) -> DataFrame:
    """Hash blocks of queries, which hold ``size`` bytes in all, against hash blocks of the corpus, one task per pair. A task
    holds its queries and reads the vectors as they come. There are enough pairs for all cores."""
    q_blocks = max(1, math.ceil(size / min(QUERY_BYTES, BROADCAST_BYTES)))
    cores = q.sparkSession.sparkContext.defaultParallelism
    c_blocks = max(1, math.ceil(c.count() / STREAM_ROWS), math.ceil(3 * cores / q_blocks))
    block = lambda key, n: F.pmod(F.xxhash64(key, "embedding"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select("qid", F.col("embedding").alias("q"), block("qid", q_blocks).alias("qb"), each(c_blocks).alias("cb"), F.lit(0).alias("side"))
    right = c.select("docid", F.col("embedding").alias("d"), block("docid", c_blocks).alias("cb"), each(q_blocks).alias("qb"), F.lit(1).alias("side"))
    met = stack(left, right).withColumn("pair", F.col("qb") * c_blocks + F.col("cb")).drop("qb", "cb")
    dealt = met.repartitionById(q_blocks * c_blocks, "pair").sortWithinPartitions("pair", "side")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
        for batch in batches:
            pair, side = (batch.column(x).to_numpy() for x in ("pair", "side"))
            edges = [0, *(np.flatnonzero(np.diff(2 * pair + side)) + 1), len(pair)]
            for at, end in zip(edges, edges[1:]):
                if end > at:
                    yield pair[at], side[at], batch.slice(at, end - at)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(runs(batches), lambda x: x[0]):
            tops, asked, waiting = None, [], []

            def add() -> None:
                pdf = pa.Table.from_batches(waiting).to_pandas()
                tops.add(pdf["docid"].to_numpy(), _prepare(_matrix(pdf["d"]), metric))
                waiting.clear()

            for _, side, rows in group:
                if side == 0:
                    asked.append(rows.select(["qid", "q"]))
                elif asked:
                    if tops is None:
                        pdf = pa.Table.from_batches(asked).to_pandas()
                        tops = Tops(pdf["qid"].to_numpy(), _prepare(_matrix(pdf["q"]), metric), k, metric, skip_self)
                    waiting.append(rows.select(["docid", "d"]))
                    if sum(x.num_rows for x in waiting) >= 4 * BLOCK_WIDTH:
                        add()
            if waiting:
                add()
            if tops is not None:
                kind = pa.schema([rows.schema.field("qid"), rows.schema.field("docid"), pa.field("score", pa.float64())])
                for pdf in tops.frames():
                    yield pa.RecordBatch.from_pandas(pdf, kind, preserve_index=False)

    return dealt.mapInArrow(search, _run_schema(q, c))


def mix_search(q1: DataFrame, q2: DataFrame, corpus: DataFrame, ratio: float, k: int, skip_self: bool = False) -> DataFrame:
    """Search with ``ratio * q1 + (1 - ratio) * q2``."""
    mixed = q1.join(q2.select("qid", F.col("embedding").alias("_other")), "qid").select(
        "qid", mix("embedding", "_other", ratio).alias("embedding"))
    return dense_search(mixed, corpus, k, skip_self=skip_self)


def dense_search_approx(queries: DataFrame, corpus: DataFrame, k: int, n_lists: int | None = None, n_probe: int | None = None,
                        seed: int = 42, skip_self: bool = False, max_iter: int = 20) -> DataFrame:
    """One search over vector lists that are built for it below the shared folder. Keep a
    :class:`seekwell.operators.vector_lists.VectorLists` to search more than once."""
    from seekwell.operators.vector_lists import VectorLists

    lists = VectorLists.build(corpus, scratch_path(corpus.sparkSession, "lists"), n_lists, "ip", seed, max_iter)
    return lists.search(queries, k, n_probe, skip_self)


def recall_against(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of exact hits that the approximate run also returned."""
    found = exact.join(approx.select("qid", "docid").withColumn("_hit", F.lit(1)), ["qid", "docid"], "left")
    return found.agg(F.count(F.lit(1)).alias("n_exact"), F.round(F.avg(F.coalesce("_hit", F.lit(0))), 6).alias("recall"))


def score_pairs_dense(pairs: DataFrame, metric: str = "ip") -> DataFrame:
    """Score rows that carry both vectors as ``q`` and ``d``."""
    fn = {"ip": vec_dot, "cos": vec_cos, "l2": vec_l2}[metric]
    return pairs.withColumn("score", F.round(fn("q", "d"), 6))
