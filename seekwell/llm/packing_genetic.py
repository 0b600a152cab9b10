"""Best-fit packing of tokenised documents with a grouping genetic algorithm on islands.

1. Documents become pieces of at most ``capacity`` tokens; a full piece is a sequence of its own. The slim piece table
   (no ids unless asked for) is written once, so all later steps read the same row numbers.
2. Open pieces are dealt to shards of about ``SHARD`` pieces by a hash. Each shard is evolved by several islands, one
   task each: crossover takes whole well-filled bins of one parent into the other, drops the bins that hold the same
   pieces, and puts the displaced pieces back best-fit, largest first. Between epochs every island receives the best
   solution of its neighbour in the ring (a join), and at the end the best island of each shard stays.
3. Badly filled bins of all shards are pooled, dealt anew as whole bins and evolved again, starting from their present
   packing, so the number of sequences can only fall.

Defined results: a null or empty text is the end token alone; null ids are carried along; repeated rows are packed
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from seekwell.llm.common import clean_input, cut
from seekwell.llm.tokens import encode_all, vocabulary_path

CAPACITY, END_ID = 2048, 0
SHARD, ISLANDS, EPOCHS, POPULATION, GENERATIONS = 2_000, 2, 2, 4, 16
GOOD_FILL = 0.985  # bins below this share are pooled for the second round


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of whole texts followed by the end token."""
    path = path or vocabulary_path()
    kind = docs.select("doc_id").schema[0].dataType.simpleString()

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:6 if with_ids else 5]
        for b in batches:
            rows = []
            for doc_id, ids in zip(b["doc_id"], encode_all(b["text"], path, END_ID.to_bytes(4, "little"))):
                for k, lo in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[lo:lo + 4 * capacity]
                    rows.append((doc_id, k, lo // 4, len(part) // 4, zlib.crc32(part), part)[:len(names)])
            yield pd.DataFrame(rows, columns=names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return clean_input(docs).mapInPandas(cut_up, schema)


def best_fit(order, sizes, capacity: int, bins: list[list[int]], loads: list[int]) -> None:
    """Put the items of ``order`` into ``bins``: each where it leaves the least room, or into a new bin."""
    rooms: dict[int, list[int]] = {}
    mask = 0  # bit r is set while a bin with room r is listed
    for b, load in enumerate(loads):
        rooms.setdefault(capacity - load, []).append(b)
        mask |= 1 << (capacity - load)
    for i in order:
        size = sizes[i]
        open_ = mask >> size
        if open_:
            room = (open_ & -open_).bit_length() - 1 + size
            stack = rooms[room]
            b = stack.pop()
            if not stack:
                mask &= ~(1 << room)
            bins[b].append(i)
            loads[b] += size
        else:
            room, b = capacity, len(bins)
            bins.append([i])
            loads.append(size)
        rooms.setdefault(room - size, []).append(b)
        mask |= 1 << (room - size)


def crossover(taken: list[list[int]], other: list[list[int]], sizes, capacity: int, rng: random.Random) -> list[list[int]]:
    """Whole well-filled bins of ``other`` injected into ``taken``."""
    fills = sorted(((sum(sizes[i] for i in b), k) for k, b in enumerate(other)), reverse=True)
    good = [k for _, k in fills[:max(1, len(fills) // 2)]]
    injected = [list(other[k]) for k in rng.sample(good, rng.randint(1, max(1, len(good) // 3)))]
    inside = {i for b in injected for i in b}
    bins, displaced = injected, []
    for b in taken:
        if inside.isdisjoint(b):
            bins.append(list(b))
        else:
            displaced += [i for i in b if i not in inside]
    loads = [sum(sizes[i] for i in b) for b in bins]
    # the emptiest bins are opened as well, else room scattered over them could never be joined
    for k in sorted(range(len(bins)), key=loads.__getitem__)[:rng.randint(1, 4)][::-1]:
        displaced += bins[k]
        bins[k] = []
    loads = [sum(sizes[i] for i in b) for b in bins if b]
    bins = [b for b in bins if b]
    best_fit(sorted(displaced, key=lambda i: (-sizes[i], i)), sizes, capacity, bins, loads)
    return bins


def evolve(sizes: list[int], seeds: list[list[list[int]]], capacity: int, rng: random.Random, generations: int = GENERATIONS) -> list[list[int]]:
    """The best grouping of one island after some generations; never worse than the best of ``seeds``."""
    fitness = lambda bins: (len(bins), -sum(sum(sizes[i] for i in b) ** 2 for b in bins))
    least = -(-sum(sizes) // capacity)
    people = list(seeds)
    while len(people) < POPULATION:
        noise = 0.0 if not people else 0.2
        order = sorted(range(len(sizes)), key=lambda i: (-sizes[i] * (1 - noise * rng.random()), i))
        bins: list[list[int]] = []
        best_fit(order, sizes, capacity, bins, [])
        people.append(bins)
    ranked = sorted(((fitness(p), k, p) for k, p in enumerate(people)))
    count = len(ranked)
    for _ in range(generations):
        if ranked[0][0][0] <= least:
            break
        mother, father = rng.sample(ranked, 2)
        child = crossover(mother[2], father[2], sizes, capacity, rng)
        count += 1
        ranked = sorted([*ranked, (fitness(child), count, child)])[:POPULATION]
    return ranked[0][2]


def _round(items: DataFrame, capacity: int, islands: int, epochs: int, seed: int) -> DataFrame:
    """items (shard, uid, length, own) -> (shard, uid, length, bin); ``own`` is a present packing or null."""
    def island(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("uid", ignore_index=True)
        sizes = rows["length"].tolist()
        seeds = []
        for name in ("own", "guest"):
            if rows[name].notna().all():
                seeds.append([g.tolist() for g in rows.groupby(name).indices.values()])
        best = evolve(sizes, seeds, capacity, random.Random(f"{seed} {key}"))
        place = [0] * len(sizes)
        for k, b in enumerate(best):
            for i in b:
                place[i] = k
        squares = sum(sum(sizes[i] for i in b) ** 2 for b in best)
        return pd.DataFrame({"shard": key[0], "island": key[1], "uid": rows["uid"], "length": rows["length"], "own": place, "n_bins": len(best), "squares": squares})

    schema = "shard long, island int, uid long, length long, own long, n_bins long, squares long"
    state = items.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("guest", F.lit(None).cast("long"))
    for epoch in range(epochs):
        out = cut(state.groupBy("shard", "island").applyInPandas(island, schema), "islands")
        if epoch + 1 < epochs:
            elite = out.select("shard", ((F.col("island") + 1) % islands).alias("island"), "uid", F.col("own").alias("guest"))
            state = out.select("shard", "island", "uid", "length", "own").join(elite, ["shard", "island", "uid"])
            seed += 1
    best = out.groupBy("shard").agg(F.min_by("island", F.struct("n_bins", -F.col("squares"), "island")).alias("island"))
    return out.join(best, ["shard", "island"]).select("shard", "uid", "length", F.col("own").alias("bin"))


def pack(items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """(uid, sequence_id, offset) for items (uid, length) with unique ids and lengths below ``capacity``."""
    number = F.struct("shard", "bin")
    dealt = lambda df, key: df.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(max(1, -(-df.count() // shard)))))
    first = _round(dealt(items.select("uid", "length"), "uid").withColumn("own", F.lit(None).cast("long")), capacity, islands, epochs, 1)
    first = cut(first.withColumn("filled", F.sum("length").over(W.partitionBy(number))), "packed")  # a bin holds at most ``capacity`` items
    good = F.col("filled") >= int(GOOD_FILL * capacity)
    wide = F.shiftleft(F.col("shard"), 32) + F.col("bin")
    pool = first.filter(~good).select("uid", "length", wide.alias("own"))
    second = _round(dealt(pool, "own"), capacity, islands, epochs, 101)
    both = first.filter(good).select("uid", "length", (2 * wide).alias("sequence_id")).unionAll(second.select("uid", "length", (2 * wide + 1).alias("sequence_id")))
    before = W.partitionBy("sequence_id").orderBy("uid").rowsBetween(W.unboundedPreceding, -1)
    return both.select("uid", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))


def packed_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    table = cut(pieces(docs, path, capacity, with_ids).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    full = table.filter(F.col("length") >= capacity).select("*", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed = pack(table.filter(F.col("length") < capacity).select("uid", "length"), capacity)
    return full.unionByName(table.filter(F.col("length") < capacity).join(placed, "uid")).drop("uid")
