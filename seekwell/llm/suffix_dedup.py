"""Suffix-array deduplication of long byte strings.

Strings of ``LENGTH`` bytes that start at two places are equal in their minimiser, the 32-byte gram inside with the
smallest hash. So the steps are:

1. Every text is cut into runs of windows that share a minimiser (slim rows: minimiser, document key, place, size).
2. Minimisers that occur once cannot hold a repeated string. For the others the run's bytes are fetched, and equal
   runs are counted in every task, so a run travels at most once from each.
3. Runs of a minimiser meet in one shard. The shard's suffix array is built by induced sorting: suffixes are
   classified, leftmost-smaller substrings are sorted and named, the named string is sorted recursively (each level on
   substrings twice as long), and the order is induced in linear time. Prefixes shared with the predecessor are computed in text order (permuted). A string is
   repeated if it shares ``LENGTH`` bytes with a neighbour, or if its run occurs more than once.
4. The answers go back to all places of the run by its 128-bit hash, and the covered bytes are cut out.

Grams above ``HOT`` places are hot: they are ranked behind all others and the runs are cut again, so that a common
line does not gather its many contexts in one shard. Runs that hold hot grams alone are copies and meet in step 2.

Defined results: a null text has no bytes; null ids are carried along; repeated rows count as places of their own, so
long texts that are repeated vanish; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from seekwell.llm.common import cut, keyed_texts, merged_spans, same_key, sized_broadcast, whole_groups

LENGTH, GRAM = 200, 32
HOT = 500_000
CHUNK_BYTES, SHARD_BYTES = 1 << 20, 1 << 21
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def raw_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from every place, by doubling."""
    h, size = _BYTE[data], 1
    while size < GRAM:
        h = h[:-size] * _MULTIPLY + h[size:]
        h ^= h >> np.uint64(31)
        size *= 2
    return (h * _MULTIPLY) >> np.uint64(1)


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest of the ``width`` values from every place."""
    at, size = np.arange(len(values)), 1

    def join(shift: int) -> np.ndarray:
        left, right = at[:len(at) - shift], at[shift:]
        return np.where(values[left] <= values[right], left, right)

    while 2 * size <= width:
        at = join(size)
        size *= 2
    return join(width - size) if width > size else at


def runs(data: np.ndarray, document: np.ndarray, hot: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, minimiser) of the runs of windows that share a minimiser inside a document."""
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, dtype=np.int64),) * 3
    h = gram_hashes(data)
    if len(hot):
        h = h + (np.isin(h, hot).astype(np.uint64) << np.uint64(63))
    at = leftmost_least(h, length - GRAM + 1)[:n]
    inside = document[:n] == document[length - 1:]
    edge = (at[1:] != at[:-1]) | (document[1:n] != document[:n - 1])
    first = np.flatnonzero(inside & np.concatenate([[True], edge | ~inside[:-1]]))
    last = np.flatnonzero(inside & np.concatenate([edge | ~inside[1:], [True]]))
    return first, last, h[at[first]].view(np.int64)


def places(keyed: DataFrame, hot: np.ndarray, length: int = LENGTH) -> DataFrame:
    """(anchor, _k1, _k2, at, size) of the runs of all texts; size counts bytes."""
    kind = dict(keyed.dtypes)["_k1"]

    def emitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def of(rows: list) -> pd.DataFrame:
            sizes = np.array([len(r[2]) for r in rows])
            document = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
            start = np.concatenate([[0], sizes.cumsum()[:-1]])
            first, last, anchor = runs(np.frombuffer(b"".join(r[2] for r in rows), dtype=np.uint8), document, hot, length)
            owner = document[first] if len(first) else np.zeros(0, dtype=np.int64)
            return pd.DataFrame({"anchor": anchor, "_k1": [rows[k][0] for k in owner.tolist()], "_k2": np.array([r[1] for r in rows], dtype=np.int64)[owner],
                                 "at": first - start[owner], "size": last - first + length})

        for b in batches:
            rows, n = [], 0
            for k1, k2, text in zip(b["_k1"], b["_k2"], b["text"]):
                rows.append((k1, k2, raw_bytes(text)))
                n += len(rows[-1][2])
                if n > CHUNK_BYTES:
                    yield of(rows)
                    rows, n = [], 0
            if rows:
                yield of(rows)

    long_enough = keyed.filter(F.octet_length("text") >= length).select("_k1", "_k2", "text")
    return long_enough.mapInPandas(emitted, f"anchor long, _k1 {kind}, _k2 long, at int, size int")


def sorted_places(names: np.ndarray, span: int = 1) -> np.ndarray:
    """Places of a named string by the order of its suffixes. ``names`` rank substrings of ``span`` names; if two are
    equal, substrings twice as long are ranked from them and sorted in turn. The last name is unlike all others."""
    order = np.argsort(names, kind="stable")
    if (names[order][1:] != names[order][:-1]).all():
        return order
    after = np.concatenate([names[span:] + 1, np.zeros(min(span, len(names)), dtype=np.int64)])
    _, longer = np.unique(names * (int(names.max()) + 2) + after, return_inverse=True)
    return sorted_places(longer, 2 * span)


class Shard:
    """Suffix array of many strings, with the work of the first level done bucket by bucket in numpy.

    Symbols: 0 ends the text, 1..m end the strings and are all different, bytes follow. The two passes of an induction
    run over blocks: whatever a bucket already holds is taken at once, its predecessors are dealt to their buckets in
    stable order, and those that fall into the same bucket form its next block.
    """

    def __init__(self, strings: list[bytes]):
        self.m = m = len(strings)
        sizes = np.array([len(x) for x in strings])
        self.starts = np.concatenate([[0], (sizes + 1).cumsum()[:-1]])
        text = np.zeros(int(sizes.sum()) + m + 1, dtype=np.int32)
        ends = self.starts + sizes
        inside = np.ones(len(text) - 1, dtype=bool)
        inside[ends] = False
        text[:-1][inside] = np.frombuffer(b"".join(strings), dtype=np.uint8).astype(np.int32) + (m + 1)
        text[ends] = np.arange(1, m + 1)
        self.first = np.concatenate([[len(text) - 1], ends])  # every end symbol occurs once, so its place is known
        self.text, n = text, len(text)
        # a suffix has the order of the next place where neighbours differ
        step = np.sign(text[1:] - text[:-1])
        place = np.where(step != 0, np.arange(n - 1), n)
        place = np.minimum.accumulate(place[::-1])[::-1]
        self.smaller = np.concatenate([np.append(step, 1)[np.minimum(place, n - 1)] > 0, [True]])
        self.leftmost = np.flatnonzero(self.smaller[1:] & ~self.smaller[:-1]) + 1
        counts = np.bincount(text, minlength=m + 257)
        self.ends = counts.cumsum()
        self.begins = self.ends - counts

    def _deal(self, block: np.ndarray, pointers: np.ndarray, out: np.ndarray, smaller: bool) -> None:
        j = block - 1
        j = j[j >= 0]
        j = j[self.smaller[j] == smaller]
        if not len(j):
            return
        symbol = self.text[j]
        order = np.argsort(symbol, kind="stable")
        j, symbol = j[order], symbol[order]
        first = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
        each = np.diff(first, append=len(j))
        rank = np.arange(len(j)) - np.repeat(first, each)
        if smaller:
            out[pointers[symbol] - 1 - rank] = j
            pointers[symbol[first]] -= each
        else:
            out[pointers[symbol] + rank] = j
            pointers[symbol[first]] += each

    def induce(self, order: np.ndarray) -> np.ndarray:
        """All suffixes in order, from the leftmost-smaller ones in ``order``."""
        m, out = self.m, np.full(len(self.text), -1, dtype=np.int64)
        symbol = self.text[order]
        stable = np.argsort(symbol, kind="stable")
        number = np.bincount(symbol, minlength=m + 257)
        slot = np.repeat(self.ends - number, number) + np.arange(len(order)) - np.repeat(number.cumsum() - number, number)
        out[slot] = order[stable]
        out[:m + 1] = self.first
        head = self.begins.copy()
        self._deal(out[:m + 1], head, out, False)
        used = [c for c in range(m + 1, m + 257) if self.ends[c] > self.begins[c]]
        for c in used:
            at = self.begins[c]
            while at < head[c]:
                at, lo = head[c], at
                self._deal(out[lo:at], head, out, False)
            self._deal(out[self.ends[c] - number[c]:self.ends[c]], head, out, False)
        tail = self.ends.copy()
        for c in used[::-1]:
            at = self.ends[c]
            while at > tail[c]:
                at, hi = tail[c], at
                self._deal(out[at:hi][::-1], tail, out, True)
            self._deal(out[self.begins[c]:head[c]][::-1], tail, out, True)
        return out

    def _named(self, order: np.ndarray) -> tuple[np.ndarray, int]:
        """Equal leftmost-smaller substrings get equal numbers, in their order."""
        n = len(self.text)
        following = np.full(n, n - 1)
        following[self.leftmost[:-1]] = self.leftmost[1:]
        size = following[order] - order + 1
        same = size[1:] == size[:-1]
        pairs, k = np.flatnonzero(same), 0
        while len(pairs):
            equal = self.text[order[pairs] + k] == self.text[order[pairs + 1] + k]
            same[pairs[~equal]] = False
            k += 1
            pairs = pairs[equal]
            pairs = pairs[size[pairs] > k]
        names = np.concatenate([[0], (~same).cumsum()])
        by_place = np.zeros(n, dtype=np.int64)
        by_place[order] = names
        return by_place[self.leftmost], int(names[-1]) + 1

    def suffix_array(self) -> np.ndarray:
        is_leftmost = np.zeros(len(self.text), dtype=bool)
        is_leftmost[self.leftmost] = True
        first = self.induce(self.leftmost)
        first = first[is_leftmost[first]]
        if len(first) < 2:
            return self.induce(first)
        names, n = self._named(first)
        if n < len(names):
            first = self.leftmost[sorted_places(names)]
        return self.induce(first)

    def shared(self, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Permuted common prefixes: for each place the symbols shared with the suffix before it in ``order``, and that
        suffix. Where the symbols to the left agree as well, a prefix is one shorter than that of the place before;
        only the other places are compared, eight symbols at a time."""
        n, text = len(self.text), self.text
        previous = np.full(n, -1, dtype=np.int64)
        previous[order[1:]] = order[:-1]
        here = np.arange(n)
        before = np.where((here > 0) & (previous > 0), text[here - 1] == text[previous - 1], False)
        before[0] = False
        places = np.flatnonzero(~before & (previous >= 0))
        low = np.where(text > self.m, text - self.m - 1, 0).astype(np.uint64)
        padded = np.concatenate([low, np.zeros(8, dtype=np.uint64)])
        eight = np.zeros(n, dtype=np.uint64)
        for k in range(8):
            eight |= padded[k:k + n] << np.uint64(8 * k)
        # words that hold an end are never taken as equal: the last steps go symbol by symbol
        end = np.concatenate([text <= self.m, np.ones(8, dtype=bool)])
        ends_in = np.concatenate([[0], end.cumsum()])
        safe = (ends_in[8:8 + n] - ends_in[:n]) == 0
        size = np.zeros(len(places), dtype=np.int64)
        todo = np.arange(len(places))
        while len(todo):
            a, b = places[todo] + size[todo], previous[places[todo]] + size[todo]
            todo = todo[safe[a] & safe[b] & (eight[a] == eight[b])]
            size[todo] += 8
        todo = np.arange(len(places))
        while len(todo):
            a, b = places[todo] + size[todo], previous[places[todo]] + size[todo]
            todo = todo[text[a] == text[b]]
            size[todo] += 1
        out = np.zeros(n, dtype=np.int64)
        out[places] = size
        last = np.maximum.accumulate(np.where(~before, here, 0))
        return np.where(before, out[last] - (here - last), out), previous


def repeated_windows(strings: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each string: which of its windows occur elsewhere in ``strings``."""
    shard = Shard(strings)
    shared, previous = shard.shared(shard.suffix_array())
    long = shared >= length
    hit = long.copy()
    hit[previous[long]] = True
    return [hit[at:at + len(x) - length + 1] for at, x in zip(shard.starts.tolist(), strings)]


def intervals(hit: np.ndarray) -> list[tuple[int, int]]:
    """(start, number) of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [(a, b - a) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


def run_hashes() -> dict:
    return {"h1": F.xxhash64("run"), "h2": F.xxhash64(F.lit(1), "run")}


def in_shards(distinct: DataFrame, length: int = LENGTH) -> DataFrame:
    """(h1, h2, spans) of the runs with repeated windows; distinct: (anchor, run, n), a run once from each task."""
    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard: list[tuple] = []

        def sort_shard() -> pd.DataFrame:
            found = [(h1, h2, spans) for (h1, h2, _), hit in zip(shard, repeated_windows([x[2] for x in shard], length)) if (spans := intervals(hit))]
            shard.clear()
            return pd.DataFrame(found, columns=["h1", "h2", "spans"])

        size = 0
        for b in whole_groups(batches, ["anchor"]):
            anchor, n = b["anchor"].to_numpy(), b["n"].to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1], [True]]))
            rows, whole = list(zip(b["run"], b["h1"].tolist(), b["h2"].tolist(), n.tolist())), []
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
                times: dict[bytes, int] = {}
                hashes = {}
                for run, h1, h2, k in rows[lo:hi]:
                    times[run] = times.get(run, 0) + k
                    hashes[run] = (h1, h2)
                whole += [(*hashes[run], [(0, len(run) - length + 1)]) for run, k in times.items() if k > 1]
                if len(times) > 1 and min(times.values()) == 1:
                    shard += [(*hashes[run], run) for run in times]
                    size += sum(map(len, times))
                    if size > SHARD_BYTES:
                        yield sort_shard()
                        size = 0
            yield pd.DataFrame(whole, columns=["h1", "h2", "spans"])
        if shard:
            yield sort_shard()

    ordered = distinct.repartition("anchor").sortWithinPartitions("anchor").withColumns(run_hashes())
    found = ordered.mapInPandas(judged, "h1 long, h2 long, spans array<struct<at:int,windows:int>>")
    # a run that occurs more than once is whole; its spans from the array are parts of that
    return found.groupBy("h1", "h2").agg(F.max_by("spans", F.aggregate("spans", F.lit(0), lambda n, s: n + s["windows"])).alias("spans"))


def covered(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(_k1, _k2, spans): bytes (start, size) to remove, for every text that has any."""
    keyed = keyed_texts(docs).select("_k1", "_k2", "text")
    rows = cut(places(keyed, np.zeros(0, dtype=np.uint64), length), "places")
    counts = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    often = np.array(sorted(r["anchor"] for r in counts.filter(F.col("n") > hot).select("anchor").collect()), dtype=np.int64)  # at most all places / hot numbers
    if len(often):
        rows = cut(places(keyed, often.view(np.uint64), length), "places")
        counts = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    shared = rows.join(counts.filter("n > 1").select("anchor"), "anchor", "left_semi")
    wanted = shared.groupBy("_k1", "_k2").agg(F.collect_set(F.struct("anchor", "at", "size")).alias("_runs"))  # fewer than the text has bytes
    kind = dict(keyed.dtypes)["_k1"]

    def fetched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, n = [], 0
            for k1, k2, text, runs_ in zip(b["_k1"], b["_k2"], b["text"], b["_runs"]):
                data = raw_bytes(text)
                for r in runs_:
                    run = data[r["at"]:r["at"] + r["size"]]
                    out.append((r["anchor"], k1, k2, r["at"], run))
                    n += len(run)
                if n > 8 * CHUNK_BYTES:
                    yield pd.DataFrame(out, columns=["anchor", "_k1", "_k2", "at", "run"])
                    out, n = [], 0
            yield pd.DataFrame(out, columns=["anchor", "_k1", "_k2", "at", "run"])

    def combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        times: dict[tuple, int] = {}
        size = 0

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([(*k, n) for k, n in times.items()], columns=["anchor", "run", "n"])
            times.clear()
            return out

        for b in batches:
            for text, runs_ in zip(b["text"], b["_runs"]):
                data = raw_bytes(text)
                for r in runs_:
                    key = (r["anchor"], data[r["at"]:r["at"] + r["size"]])
                    size += 0 if key in times else r["size"]
                    times[key] = times.get(key, 0) + 1
                if size > 32 * CHUNK_BYTES:
                    yield flush()
                    size = 0
        yield flush()

    texts = keyed.filter(F.octet_length("text") >= length)
    with_runs = texts.join(wanted.withColumnsRenamed({"_k1": "_w1", "_k2": "_w2"}), F.col("_k1").eqNullSafe(F.col("_w1")) & (F.col("_k2") == F.col("_w2")))
    with_runs = with_runs.select("_k1", "_k2", "text", "_runs")
    occurrences = with_runs.mapInPandas(fetched, f"anchor long, _k1 {kind}, _k2 long, at int, run binary").withColumns(run_hashes())
    distinct = with_runs.mapInPandas(combined, "anchor long, run binary, n long")
    answers = in_shards(distinct, length)
    hit = occurrences.select("h1", "h2", "_k1", "_k2", "at").join(answers, ["h1", "h2"]).select("_k1", "_k2", "at", F.explode("spans").alias("s"))
    spans = hit.select("_k1", "_k2", (F.col("at") + F.col("s.at")).alias("start"), (F.col("s.windows") + (length - 1)).alias("size"))
    return merged_spans(spans, ["_k1", "_k2"])


def deduplicated(docs: DataFrame, length: int = LENGTH, with_bytes: bool = False, **options) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    spans = sized_broadcast(cut(covered(docs, length, **options), "spans"), 32 + 16 * F.size("spans"))
    keyed = keyed_texts(docs)
    joined = keyed.join(spans, same_key(keyed, spans), "left").select("doc_id", "text", "spans")

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][:6 if with_bytes else 5]
        for b in batches:
            out = []
            for doc_id, text, spans_ in zip(b["doc_id"], b["text"], b["spans"]):
                data = raw_bytes(text)
                kept, at, n = [], 0, 0
                for s, size in sorted((x["start"], x["size"]) for x in spans_) if spans_ is not None else ():
                    if s > at or not n:
                        kept.append(data[at:s])
                        n += 1
                    at = max(at, s + size)
                left = b"".join([*kept, data[at:]])
                out.append((doc_id, len(data), len(data) - len(left), n, hashlib.sha256(left).hexdigest(), left)[:len(names)])
            yield pd.DataFrame(out, columns=names)

    return joined.mapInPandas(cut_out, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes)
