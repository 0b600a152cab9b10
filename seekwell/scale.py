"""Sizing, salting and ordering helpers shared by the operators.

Everything that depends on data size lives here: the checks that allow a broadcast,
the deterministic buckets that replace single-task windows, and the shared folder
used when lineage has to be cut.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

# A broadcast side may hold at most this many bytes, whatever the cluster.
BROADCAST_BYTES = 64 * 1024 * 1024
# Short term rows (two ids and a weight) that stay below the byte bound.
BROADCAST_TERM_ROWS = 400_000
# Rows one salted group may hold before it is split further.
ROWS_PER_SALT = 1_000_000
# Upper bound for the number of keys treated as hot.
MAX_HOT_KEYS = 10_000


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the cluster's shared checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="seekwell-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` once to shared storage and read it back, so later stages neither
    recompute it nor depend on the executors that produced it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_TERM_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows and its text stays below the byte
    bound. Reads no more than ``max_rows`` + 1 rows."""
    text = [F.octet_length(name) for name, kind in df.dtypes if kind == "string"]
    size = sum((F.coalesce(t, F.lit(0)) for t in text), F.lit(16 * len(df.columns)))
    seen = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return seen["n"] <= max_rows and seen["bytes"] <= BROADCAST_BYTES


def stack(*frames: DataFrame) -> DataFrame:
    """Union by name, safe to aggregate afterwards.

    Spark 4.1 lets a union keep the hash partitioning its inputs share. Adaptive
    execution may merge the partitions of each input differently, and a following
    aggregate by the same key then sees one group in two tasks. The setting is switched
    off, so the aggregate shuffles again.
    """
    frames[0].sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def spread(scan: DataFrame) -> DataFrame:
    """Deal the rows of a scan out to all cores when the files give fewer splits than cores.
    A large input has more splits than cores and is left where it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def seeded(seed, *cols) -> Column:
    """Reproducible pseudo-random order key, equal on every engine with md5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols]))


def hash_rank(df: DataFrame, parts: list[str], key: str, tie: list[str], out: str) -> DataFrame:
    """1-based rank by the hex digest ``key`` inside ``parts``.

    Leading hex digits split every group into even buckets, at least 16 for each shuffle
    partition, so a group that holds most of the table is still ranked by many tasks: bucket
    counts give the offset, a window inside the bucket gives the rest.
    """
    digits = max(3, math.ceil(math.log(16 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 16)))
    b = df.withColumn("_bucket", F.conv(F.substring(key, 1, digits), 16, 10).cast("long"))
    return _offset_totals(b, parts, [key, *tie], {out: F.lit(1)})


def running_totals(df: DataFrame, parts: list[str], order: str, values: dict[str, Column], tie: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Inclusive running sums by ``order`` (then ``tie``), of any sortable type, inside ``parts``.

    Two passes: totals per range bucket, then a window inside the bucket, so that one large
    group is still summed by many tasks. Ranges run over ``parts``, ``order`` and ``tie``
    together, so equal order values spread as far as ``tie`` tells them apart. There are two
    buckets per shuffle partition unless ``buckets`` is given. The bucketed rows are written
    once: both passes read the same buckets and the input is computed once.
    """
    if buckets is None:
        buckets = max(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 16)
    keys = [*parts, order, *(tie or [])]
    ranged = df.repartitionByRange(buckets, *keys).withColumn("_bucket", F.spark_partition_id())
    return _offset_totals(cut(ranged, "ranges"), parts, [order, *(tie or [])], values)


def running_total(df: DataFrame, parts: list[str], order: str, value: Column, out: str) -> DataFrame:
    """One running sum, see :func:`running_totals`."""
    return running_totals(df, parts, order, {out: value})


def _offset_totals(b: DataFrame, parts: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    names = list(values)
    b = b.withColumns({f"_v_{n}": v for n, v in values.items()})
    keys = [*parts, "_bucket"]
    totals = b.groupBy(*keys).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    before = W.partitionBy(*parts).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"_o_{i}") for i, k in enumerate(keys)],
                            *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in names])
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = b.withColumns({f"_in_{n}": F.sum(f"_v_{n}").over(inside) for n in names})
    on = None
    for i, k in enumerate(keys):
        eq = F.col(k).eqNullSafe(F.col(f"_o_{i}"))
        on = eq if on is None else on & eq
    out = ranked.join(offsets, on).withColumns({n: F.col(f"_in_{n}") + F.col(f"_before_{n}") for n in names})
    return out.drop("_bucket", *[f"{p}_{n}" for n in names for p in ("_v", "_in", "_before")], *[f"_o_{i}" for i in range(len(keys))])


def top_rows(df: DataFrame, parts: list[str], order: list, n: int, out: str = "rank") -> DataFrame:
    """First ``n`` rows per group with their rank.

    Below the session's group-limit threshold the rank filter becomes a group limit inside
    each task, so a task ships at most ``n`` rows per group. From there on the engine plans
    none, and a first window over hash salts takes its place: a group is ranked by many tasks,
    and only ``n`` rows per salt meet in the last one.
    """
    spark = df.sparkSession
    if n >= int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        plain = [c for c, kind in df.dtypes if not any(x in kind for x in ("map<", "variant"))]
        salts = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")) // 4, 4), 64)
        local = W.partitionBy(*parts, "_salt").orderBy(*order)
        df = (df.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(salts))).withColumn("_local", F.row_number().over(local))
              .filter(F.col("_local") <= n).drop("_salt", "_local"))
    w = W.partitionBy(*parts).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= n)


def seeded_place(seed, *cols) -> Column:
    """A seeded start below 2^60, so that every place of any corpus can be drawn."""
    return F.conv(F.substring(seeded(seed, *cols), 1, 15), 16, 10).cast("long")
