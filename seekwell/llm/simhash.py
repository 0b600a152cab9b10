"""SimHash near-duplicates with pivot distance tables.

Every distinct fingerprint gets its row of the table: Hamming distances to many reference fingerprints. By the
triangle inequality two fingerprints at most ``bits`` apart differ by at most ``bits`` in every coordinate.

* Coordinates relative to the zero reference, for the references with a single bit set, are one bit each; a whole
  block of them is equal exactly if the masked fingerprints are equal. With ``bits`` + e blocks at least e blocks agree
  in a linked pair, so equality of e blocks is an exact join key. e grows with the number of fingerprints, which keeps
  buckets small.
* Inside a bucket rows are sorted by the distance to the first dense reference, and a row meets only the following
  ones whose coordinate is within ``bits``. Pairs are dropped by their largest coordinate difference over the other
  references; survivors are verified by their Hamming distance.
* A bucket returns the links of a spanning forest, never all its pairs. Buckets above ``HOT`` rows are cut into chunks
  that meet pairwise in tasks of their own.

Copies share one fingerprint and are never paired. Defined results: null and empty texts have fingerprint zero and are
linked like any other; a null id never is the smallest unless the whole component has none; repeated rows are
returned each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from seekwell.llm.common import by_key, clean_input, components, cut, same_key, sized_broadcast, whole_groups, with_row_key

SHINGLE, BITS, SEED = 4, 4, 42
HOT = 16_384
REFERENCES = np.array([xxhash.xxh64_intdigest(str(i), seed=7) for i in range(16)], dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the lower-cased (A-Z) words of a whole text, signed as the engine stores it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(len(words) - shingle + 1, 1)
    if n == 1:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed=SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        line, digest = b" ".join(words), xxhash.xxh64_intdigest
        starts = [0, *ends[:n - 1].tolist()]
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist(), strict=True)]
    ones = np.zeros(64, dtype=np.int64)
    raw = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    for lo in range(0, n, 65_536):
        ones += np.unpackbits(raw[lo:lo + 65_536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` (any id type) with the column ``fp`` in place of the text."""
    def mapped(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([fingerprint(v, shingle) for v in t], dtype="int64")

    return clean_input(docs).select("doc_id", F.pandas_udf(mapped, "long")(F.col("text")).alias("fp"))


def block_masks(blocks: int, equal: int) -> list[int]:
    """Signed masks that keep ``equal`` of ``blocks`` nearly even blocks of the 64 bits, one for each choice."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    each = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(each, equal)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def bucket_links(fps: np.ndarray, group: np.ndarray, bits: int) -> np.ndarray:
    """Index pairs of a spanning forest of the links inside each group. Rows are sorted by group, then by the distance
    to the first reference."""
    table = np.bitwise_count(fps[:, None] ^ REFERENCES[None, :]).astype(np.int8)
    root, links = np.arange(len(fps)), []
    left, lag = np.arange(len(fps)), 0
    while len(left):
        lag += 1
        left = left[left + lag < len(fps)]
        left = left[(group[left] == group[left + lag]) & (table[left + lag, 0] - table[left, 0] <= bits)]
        a, b = left, left + lag
        for p in range(1, table.shape[1]):  # largest coordinate difference, reference by reference
            near = np.abs(table[a, p] - table[b, p]) <= bits
            a, b = a[near], b[near]
            if not len(a):
                break
        near = (np.bitwise_count(fps[a] ^ fps[b]) <= bits) & (root[a] != root[b])
        for x, y in zip(a[near].tolist(), b[near].tolist()):
            rx, ry = x, y
            while root[rx] != rx:
                rx = root[rx]
            while root[ry] != ry:
                ry = root[ry]
            if rx != ry:
                root[max(rx, ry)] = min(rx, ry)
                links.append((x, y))
        if near.any():
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return np.array(links, dtype=np.int64).reshape(-1, 2)


def links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` whose components are those of all pairs within ``bits``."""
    n = distinct.count()
    equal = 2 if n <= 1 << 24 else 3 if n <= 1 << 30 else 4
    masks = block_masks(bits + equal, equal)
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])
    keyed = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    hot = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("t", "key", F.ceil(F.col("n") / (HOT // 2)).alias("chunks"))
    own, other = F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1))), F.col("other")
    dealt = keyed.join(hot, ["t", "key"], "left").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("chunks", F.lit(1)) - 1)))
    # signed distance from the first reference, so that rows of a bucket arrive in the order of that coordinate
    first = int(REFERENCES[:1].view(np.int64)[0])
    dealt = dealt.select("t", "key", F.least("own", other).alias("lo"), F.greatest("own", other).alias("hi"), "fp", F.bit_count(F.col("fp").bitwiseXOR(F.lit(first))).alias("d"))
    place = ["t", "key", "lo", "hi"]
    ordered = dealt.repartition(*place).sortWithinPartitions(*place, "d").drop("d")

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def of(b: pd.DataFrame) -> pd.DataFrame:
            k = b[place].to_numpy()
            group = np.concatenate([[0], (k[1:] != k[:-1]).any(axis=1).cumsum()])
            fps = b["fp"].to_numpy()
            at = bucket_links(fps.view(np.uint64), group, bits)
            return pd.DataFrame({"a": fps[at[:, 0]], "b": fps[at[:, 1]]})

        yield from map(of, whole_groups(batches, place))

    return ordered.mapInPandas(found, "a long, b long")


def near_groups(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fp, component_id (smallest id of its component)."""
    slim = cut(with_fingerprints(docs, shingle), "fingerprints")
    distinct = cut(slim.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    stars = components(links(distinct.select("fp"), bits))
    known = cut(stars.join(distinct, stars["node"] == distinct["fp"]).select("node", "root", "first"), "members")
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    named = known.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    # written, so that the last join is between two plain shuffles, of which a skewed one can be split
    whole = cut(distinct.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")), "named")
    return slim.join(whole, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of every near-duplicate component, the one with the smallest id; all columns stay."""
    keyed = with_row_key(docs)
    groups = cut(near_groups(by_key(keyed), bits, shingle), "groups")
    drop = groups.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id._k1", "doc_id._k2").distinct()
    drop = sized_broadcast(drop, F.lit(24))
    kept = keyed.join(drop, same_key(keyed, drop), "left_anti")
    again = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").count().filter("count > 1").select("doc_id._k1", "doc_id._k2")
    if again.isEmpty():
        return kept.select("_row.*")
    again = sized_broadcast(again, F.lit(24))
    once = kept.join(again, same_key(kept, again), "left_semi").dropDuplicates(["_k1", "_k2"])
    return kept.join(again, same_key(kept, again), "left_anti").unionAll(once).select("_row.*")
