"""Saved vector lists: an inverted file of vectors, built once and searched many times.

A folder holds the centroids with the number of lists to probe (one small file), the vectors partitioned by their nearest centroid below a delta, and the
ids each delta replaced. A search assigns every query to its nearest lists, reads only the partitions of probed lists
(partition pruning, no vector is shuffled) and keeps one running top k per task. More queries than a task may hold are
cut into blocks that meet blocks of lists. New vectors join as a further delta
without a new fit; a vector that is added again replaces its earlier version.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructType

from seekwell.operators.dense import BLOCK_CELLS, BLOCK_ROWS, QUERY_BYTES, Tops, _held, _matrix, _prepare, _run_schema, dense_search
from seekwell.operators.ranking import top_k
from seekwell.scale import BROADCAST_BYTES

# Vectors the centroids are fitted on, at most; all vectors get a list.
FIT_ROWS = 200_000
# Vectors whose true neighbours choose, at the build, how many lists a search probes unless it is told otherwise: the
# fewest lists that hold this share of the neighbours of these vectors.
CALIBRATION_ROWS, CALIBRATION_K, RECALL = 256, 10, 0.92
# Vectors of one file of a list.
FILE_ROWS = 500_000


def nearest_lists(centroids: np.ndarray, metric: str):
    """A pandas UDF from vectors and a number to that many nearest lists. With ``ip`` and ``cos`` nearest means the largest
    product with the centroid's direction, as scores are compared later."""
    c = centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12) if metric == "cos" else centroids

    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series, count: pd.Series) -> pd.Series:
        if not len(vectors) or not c.shape[1]:
            return pd.Series([[0]] * len(vectors), dtype=object)
        m = _prepare(_matrix(vectors), metric)
        n, out = min(int(count.iloc[0]), len(c)), []
        step = max(1, BLOCK_CELLS // 4 // len(c))  # the more lists, the fewer vectors at a time
        for at in range(0, len(m), step):
            far = (c * c).sum(1)[None, :] - 2 * m[at:at + step] @ c.T
            if n == 1:
                out += far.argmin(axis=1)[:, None].astype(np.int32).tolist()
                continue
            part = np.argpartition(far, n - 1, axis=1)[:, :n] if n < len(c) else np.tile(np.arange(len(c)), (len(far), 1))
            order = np.take_along_axis(part, np.argsort(np.take_along_axis(far, part, 1), axis=1, kind="stable"), 1)
            out += order.astype(np.int32).tolist()
        return pd.Series(out)

    return nearest


@dataclass
class VectorLists:
    """An inverted file below ``path``."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    metric: str
    n_probe: int

    @staticmethod
    def build(corpus: DataFrame, path: str, n_lists: int | None = None, metric: str = "ip", seed: int = 42, max_iter: int = 20, fit_rows: int = FIT_ROWS) -> "VectorLists":
        """Fit centroids on at most ``fit_rows`` vectors (those with the smallest id hashes), write them and every vector of
        ``(docid, embedding)``. There are as many lists as the square root of the corpus unless ``n_lists`` is given."""
        if metric not in ("ip", "cos"):
            raise ValueError(f"unknown metric {metric!r}")
        spark = corpus.sparkSession
        points = corpus.select("docid", "embedding")
        total = points.count()
        n_lists = n_lists or max(2, math.isqrt(total))
        if total > fit_rows:
            share = 1.2 * fit_rows / total
            points_fit = points.filter(F.pmod(F.xxhash64("docid"), F.lit(1_000_000)) < int(math.ceil(share * 1_000_000)))
        else:
            points_fit = points
        if total:
            model = KMeans(k=n_lists, seed=seed, maxIter=max_iter, featuresCol="f").fit(points_fit.select(array_to_vector("embedding").alias("f")))
            centroids = np.array(model.clusterCenters())
        else:
            centroids = np.zeros((1, 0))  # one list for whatever comes later
        lists = VectorLists(spark, path, centroids, metric, len(centroids))
        lists._write(points, 0, "overwrite")
        lists.n_probe = lists._calibrated()
        rows = [(i, c.tolist(), metric, lists.n_probe) for i, c in enumerate(centroids)]
        spark.createDataFrame(rows, "list int, centroid array<double>, metric string, n_probe int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        return lists

    @staticmethod
    def load(spark: SparkSession, path: str) -> "VectorLists":
        rows = sorted(spark.read.parquet(f"{path}/centroids").collect(), key=lambda r: r["list"])  # one row per list
        return VectorLists(spark, path, np.array([r["centroid"] for r in rows]), rows[0]["metric"], rows[0]["n_probe"])

    def _calibrated(self) -> int:
        """The fewest lists that hold ``RECALL`` of the true neighbours of some stored vectors, from one exact search."""
        stored = self.vectors()
        some = stored.orderBy(F.xxhash64("docid"), "docid").limit(CALIBRATION_ROWS).select(F.col("docid").alias("qid"), "embedding")
        order = nearest_lists(self.centroids, self.metric)("embedding", F.lit(len(self.centroids)))
        true = dense_search(some, stored, CALIBRATION_K, self.metric, skip_self=True).select("qid", "docid")
        # at most CALIBRATION_ROWS times CALIBRATION_K pairs, so both broadcasts are bounded
        near = stored.select("docid", "list").join(F.broadcast(true), "docid").join(F.broadcast(some.withColumn("_lists", order)), "qid")
        ranks = near.groupBy(F.array_position("_lists", F.col("list")).alias("rank")).count().collect()  # one row per list
        total, seen = sum(r["count"] for r in ranks), 0
        for rank, n in sorted((r["rank"], r["count"]) for r in ranks):
            seen += n
            if seen >= RECALL * total:
                return int(rank)
        return len(self.centroids)

    def _deltas(self) -> list[int]:
        return sorted(r["delta"] for r in self.spark.read.parquet(f"{self.path}/deltas").select("delta").collect())  # one row per delta

    def _write(self, points: DataFrame, delta: int, mode: str) -> None:
        placed = points.withColumn("list", nearest_lists(self.centroids, self.metric)("embedding", F.lit(1))[0])
        # one file for each list, as a search opens them all; a list that holds most vectors is split over many tasks
        dealt = placed.hint("rebalance", "list")
        dealt.write.mode("overwrite").partitionBy("list").option("maxRecordsPerFile", FILE_ROWS).parquet(f"{self.path}/lists/delta={delta}")
        row = [(delta, points.schema.json())]
        self.spark.createDataFrame(row, "delta int, kinds string").coalesce(1).write.mode(mode).parquet(f"{self.path}/deltas")

    def add(self, corpus: DataFrame) -> int:
        """Write ``(docid, embedding)`` as the next delta; ids that are there already are replaced. Nothing is fitted again."""
        delta = self._deltas()[-1] + 1
        points = corpus.select("docid", "embedding")
        self._write(points, delta, "append")
        return delta

    def vectors(self) -> DataFrame:
        """``(docid, embedding, list, delta)``, the newest version of each id."""
        deltas = self._deltas()
        kinds = self.spark.read.parquet(f"{self.path}/deltas").filter("delta = 0").first()["kinds"]
        schema = StructType.fromJson(json.loads(kinds)).add("list", IntegerType()).add("delta", IntegerType())
        stored = self.spark.read.schema(schema).option("basePath", f"{self.path}/lists").parquet(*[f"{self.path}/lists/delta={d}" for d in deltas])
        if len(deltas) == 1:
            return stored
        # only ids of later deltas can replace anything; they are far fewer than the first build
        newest = stored.filter(F.col("delta") > 0).groupBy("docid").agg(F.max("delta").alias("_newest"))
        return stored.join(newest, "docid", "left").filter(F.col("_newest").isNull() | (F.col("delta") == F.col("_newest"))).drop("_newest")

    def search(self, queries: DataFrame, k: int, n_probe: int | None = None, skip_self: bool = False) -> DataFrame:
        """Top ``k`` of ``(qid, embedding)`` among the vectors of each query's ``n_probe`` nearest lists; unless
        given, the number that the build measured."""
        n_probe = min(n_probe or self.n_probe, len(self.centroids))
        every = n_probe == len(self.centroids)
        q = queries.select("qid", "embedding")
        size = _held(q, k) + (0 if every else 16 * n_probe * q.count())
        asked = q if every else q.withColumn("lists", nearest_lists(self.centroids, self.metric)("embedding", F.lit(n_probe)))
        best = self._scan(asked, k, skip_self) if size <= min(QUERY_BYTES, BROADCAST_BYTES) else self._grid(asked, size, k, skip_self)
        return top_k(best, "qid", "score", k)

    def _scan(self, asked: DataFrame, k: int, skip_self: bool) -> DataFrame:
        """Each task's best ``k`` per query; ``asked`` is small enough for every task."""
        local = asked.toPandas()
        if len(local):
            local = local.sort_values("qid")
        wanted = _by_list(local)
        metric = self.metric
        shared = self.spark.sparkContext.broadcast((local["qid"].to_numpy(), _prepare(_matrix(local["embedding"]), metric), wanted))
        stored = self.vectors()
        probed = stored if wanted is None or len(wanted) == len(self.centroids) else stored.filter(F.col("list").isin(sorted(wanted)))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qids, m, by_list = shared.value
            tops = Tops(qids, m, k, metric, skip_self)
            for pdf in batches:
                _add_lists(tops, pdf, by_list)
            yield from tops.frames()

        return probed.select("docid", "embedding", "list").mapInPandas(scan, _run_schema(asked, stored))

    def _grid(self, asked: DataFrame, size: int, k: int, skip_self: bool) -> DataFrame:
        """Hash blocks of queries, which hold ``size`` bytes in all, against blocks of lists, one task group per pair. A query
        goes only to blocks that hold a list it asked for; a list of more than ``BLOCK_ROWS`` vectors is several blocks."""
        stored = self.vectors()
        limit = min(QUERY_BYTES, BROADCAST_BYTES)
        q_blocks = max(1, math.ceil(size / limit))
        counts = {r["list"]: r["count"] for r in stored.groupBy("list").count().collect()}  # one row per list
        least = math.ceil(2 * self.spark.sparkContext.defaultParallelism / q_blocks)
        rows = max(1, min(BLOCK_ROWS, math.ceil(sum(counts.values()) / least)))
        first, parts, n_blocks, held = np.zeros(len(self.centroids), np.int32), np.ones(len(self.centroids), np.int32), 1, 0
        for x in range(len(self.centroids)):
            n = counts.get(x, 0)
            if held and held + n > rows:
                n_blocks, held = n_blocks + 1, 0
            first[x], parts[x] = n_blocks - 1, max(1, math.ceil(n / rows))
            n_blocks, held = n_blocks + int(parts[x]) - 1, rows if parts[x] > 1 else held + n

        @F.pandas_udf("array<int>")
        def blocks_of(lists: pd.Series) -> pd.Series:
            return pd.Series([sorted({b for x in row for b in range(first[x], first[x] + parts[x])}) for row in lists], dtype=object)

        @F.pandas_udf("int")
        def block_of(lists: pd.Series, salt: pd.Series) -> pd.Series:
            at = lists.to_numpy()
            return pd.Series(first[at] + salt.to_numpy() % parts[at])

        targets = blocks_of("lists") if "lists" in asked.columns else F.sequence(F.lit(0), F.lit(n_blocks - 1))
        left = asked.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(q_blocks))).withColumn("cb", F.explode(targets))
        right = stored.select("docid", "embedding", "list", block_of("list", F.pmod(F.xxhash64("docid"), F.lit(1 << 30))).alias("cb"),
                              F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))).alias("qb"))
        metric = self.metric

        def pair(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
            tops = Tops(lp["qid"].to_numpy(), _prepare(_matrix(lp["embedding"]), metric), k, metric, skip_self)
            if len(lp) and len(rp):
                _add_lists(tops, rp, _by_list(lp))
            found = list(tops.frames())
            return pd.concat(found) if found else pd.DataFrame({"qid": lp["qid"][:0], "docid": rp["docid"][:0], "score": np.zeros(0)})

        return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(pair, _run_schema(asked, stored))


def _by_list(queries: pd.DataFrame) -> dict[int, np.ndarray] | None:
    """The places of the queries that asked for each list; None if all asked for all."""
    if "lists" not in queries.columns:
        return None
    asked = np.array(queries["lists"].tolist(), dtype=np.int32)
    if not asked.size:
        return {}
    flat = asked.reshape(-1)
    order = np.argsort(flat, kind="stable")
    names, starts = np.unique(flat[order], return_index=True)
    return {int(x): places for x, places in zip(names, np.split((order // asked.shape[1]).astype(np.int32), starts[1:]))}


def _add_lists(tops: Tops, rows: pd.DataFrame, by_list: dict[int, np.ndarray] | None) -> None:
    """Take in the vectors of each list for the queries that asked for it."""
    for x, mine in rows.groupby("list", sort=False):
        places = None if by_list is None else by_list.get(int(x))
        if by_list is None or places is not None:
            tops.add(mine["docid"].to_numpy(), _prepare(_matrix(mine["embedding"]), tops.metric), places)
