"""Katz backoff language model over word pairs.

P(w | h) is the discounted pair count over the count of h if the pair was seen in training, else the backoff weight of
h times P(w); P(w) is the discounted word count, and what the discounts free goes to the class of unseen words.
Discounts are Good-Turing's for counts up to ``LIMIT``, from smoothed counts of counts. A backoff weight is the mass
the seen pairs of h leave, over the mass their words leave, so every context sums to one exactly.

Texts are read once and become batches: distinct word hashes and the tokens as numbers into them. All tables are
partitioned, and what moves is packed arrays, each distinct word or pair of a batch once:

1. word counts are summed by hash range; every batch gets the numbers and counts of its words back;
2. pair counts are summed by context; every batch gets the counts of its pairs back, and the sums over all seen pairs
   of a context where it has to back off. Contexts with more than ``HOT`` tokens are dealt by pair instead, and their
   sums (at most ``MOST_HOT`` rows by the choice of the border) are added up and sent to every task;
3. every batch adds up the logarithms for its documents.

Only totals (token and type counts, counts of counts) and the sums of hot contexts reach the driver.

Defined results: a null or empty text is its end token alone; a null id counts as the empty text in the hold-out hash;
repeated rows are learned from and scored each; without training documents every token has probability one, as the
class of unseen words is all there is; an empty table gives an empty result; other columns are ignored. Words are told
apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.taskcontext import TaskContext

from seekwell.llm.common import clean_input, cut, squeeze, unsqueeze

LIMIT = 5
HIGH = 0.999  # what larger counts keep, so that a context of frequent pairs alone can back off as well
BATCH_TOKENS, PART_ENTRIES = 400_000, 1_000_000
HOT, MOST_HOT = 1_000_000, 20_000
BEGIN = -1  # the context before the first word


def discounts(low: list[int]) -> np.ndarray:
    """Factors for counts 0..LIMIT and, last, all above, from the counts of counts 1..LIMIT+1; index 0 is unused. The
    counts of counts are replaced by their log-linear fit before Good-Turing's formula (Gale and Sampson: each is first
    spread over the gap to its neighbours). A slope below -1 puts every factor between 0 and 1. Without counts 1 or 2, or
    with a flatter fit, there is no such estimate and a constant is taken off each count instead."""
    n, r = np.array(low, dtype=float), np.arange(1, LIMIT + 1)
    slope = 0.0
    if n[0] and n[1]:
        at = np.flatnonzero(n) + 1
        below = np.concatenate([[0], at[:-1]])
        above = np.concatenate([at[1:], [2 * at[-1] - below[-1]]])
        x, y = np.log(at), np.log(2 * n[at - 1] / (above - below))
        slope = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
    if slope < -1:
        tail = (LIMIT + 1) ** (slope + 1)
        d = (((r + 1) / r) ** (slope + 1) - tail) / (1 - tail)
    else:
        d = (r - (n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5)) / r
    return np.concatenate([[1.0], d, [HIGH]])


@dataclass(frozen=True)
class Words:
    """Totals of the word table and the probabilities that follow."""

    tokens: int
    types: int
    documents: int
    low: tuple

    @property
    def _mass(self) -> tuple[np.ndarray, float, float]:
        d = discounts(list(self.low))
        small = [r * self.low[r - 1] for r in range(1, LIMIT + 1)]
        freed = (sum((1 - d[r + 1]) * m for r, m in enumerate(small)) + (1 - HIGH) * (self.tokens - sum(small))) / self.tokens if self.tokens else 1.0
        unseen = max(freed, 1 / (self.tokens + self.types + 1))
        return d, unseen, (1 - unseen) / (1 - freed) if freed < 1 else 0.0

    def probability(self, counts: np.ndarray) -> np.ndarray:
        d, unseen, scale = self._mass
        share = counts * d[np.minimum(counts, LIMIT + 1)] * (scale / max(self.tokens, 1))
        return np.where(counts > 0, share, unseen)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def batches(docs: DataFrame, tokens: int = BATCH_TOKENS) -> DataFrame:
    """(batch, doc_ids, held, sizes, codes, words, trained, n): texts as numbers into the sorted hashes of their words."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = TaskContext.get().partitionId() << 24

        def of(rows: list) -> pd.DataFrame:
            nonlocal at
            at += 1
            sizes = np.array([len(r[2]) for r in rows])
            codes, distinct = pd.factorize(np.array([w for r in rows for w in r[2]], dtype=object))
            hashes, order = np.unique(np.array([xxhash.xxh64_intdigest(w) for w in distinct], dtype=np.uint64), return_inverse=True)
            codes = order[codes].astype(np.int32)
            train = np.repeat(~np.array([r[1] for r in rows]), sizes)
            trained = np.bincount(codes[train], minlength=len(hashes)).astype(np.int64)
            return pd.DataFrame([(at, [r[0] for r in rows], [r[1] for r in rows], squeeze(sizes), squeeze(codes), squeeze(np.diff(hashes, prepend=np.uint64(0))), squeeze(trained), len(hashes))],
                                columns=["batch", "doc_ids", "held", "sizes", "codes", "words", "trained", "n"])

        rows, n = [], 0
        for f in frames:
            for doc_id, held, text in zip(f["doc_id"], f["held"], f["text"]):
                words = (text or "").encode("utf-8", "surrogatepass").lower().split()
                words.append(b"")  # the end; no word is empty
                rows.append((doc_id, held, words))
                n += len(words)
                if n >= tokens:
                    yield of(rows)
                    rows, n = [], 0
        if rows:
            yield of(rows)

    read = clean_input(docs).select("doc_id", held_out(F.col("doc_id")).alias("held"), "text")
    return read.mapInPandas(packed, f"batch long, doc_ids array<{kind}>, held array<boolean>, sizes binary, codes binary, words binary, trained binary, n long")


def word_counts(table: DataFrame, parts: int) -> DataFrame:
    """(batch, part, ids, counts) for every batch; rows of batch -1 hold the totals of a part."""
    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        borders = np.array([(k << 64) // parts for k in range(1, parts)], dtype=np.uint64)
        for f in frames:
            for batch, words, trained in zip(f["batch"], f["words"], f["trained"]):
                h, c = unsqueeze(words, "u8").cumsum(dtype=np.uint64), unsqueeze(trained, "i8")
                cuts = [0, *np.searchsorted(h, borders).tolist(), len(h)]
                yield pd.DataFrame([(p, batch, squeeze(h[a:b]), squeeze(c[a:b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a],
                                   columns=["part", "batch", "words", "trained"])

    def summed(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        part, h, c = key[0], [unsqueeze(w, "u8") for w in f["words"]], [unsqueeze(t, "i8") for t in f["trained"]]
        _, at = np.unique(np.concatenate(h), return_inverse=True)
        total = np.zeros(int(at.max()) + 1, dtype=np.int64)
        np.add.at(total, at, np.concatenate(c))
        rank = np.empty(len(total), dtype=np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(total))  # common words get small numbers
        out, lo = [], 0
        for batch, x in zip(f["batch"], h):
            mine = at[lo:lo + len(x)]
            out.append((batch, part, squeeze(rank[mine] * parts + part), squeeze(total[mine]), 0, 0, None))
            lo += len(x)
        low = np.bincount(total[total <= LIMIT + 1], minlength=LIMIT + 2)[1:].tolist()
        out.append((-1, part, None, None, int(total.sum()), int((total > 0).sum()), low))
        return pd.DataFrame(out, columns=["batch", "part", "ids", "counts", "tokens", "types", "low"])

    dealt = table.select("batch", "words", "trained").mapInPandas(split, "part int, batch long, words binary, trained binary")
    return dealt.groupBy("part").applyInPandas(summed, "batch long, part int, ids binary, counts binary, tokens long, types long, low array<long>")


@dataclass
class Pairs:
    """The distinct pairs of a batch, in the order in which they are sent to the parts."""

    document: np.ndarray  # of each token
    pair: np.ndarray  # of each token, -1 if its context is unknown
    word_count: np.ndarray  # of each token
    part: np.ndarray  # from here on of each pair
    context: np.ndarray
    context_count: np.ndarray
    word: np.ndarray
    count: np.ndarray  # of the pair's word
    trained: np.ndarray


def pairs_of(row, words: Words, parts: int, hot: int) -> Pairs:
    sizes, codes = unsqueeze(row.sizes, "i8"), unsqueeze(row.codes, "i4").astype(np.int64)
    ids = np.concatenate([unsqueeze(x["ids"], "i8") for x in row.known])
    counts = np.concatenate([unsqueeze(x["counts"], "i8") for x in row.known])
    n = len(ids)
    start = np.concatenate([[0], sizes.cumsum()[:-1]])
    before = np.concatenate([[n], codes[:-1]])
    before[start] = n
    train = np.repeat(~np.array(row.held, dtype=bool), sizes)
    context_counts = np.concatenate([counts, [words.documents]])
    distinct, at = np.unique(before * (n + 1) + codes, return_inverse=True)
    trained = np.bincount(at[train], minlength=len(distinct)).astype(np.int64)
    left, right = distinct // (n + 1), distinct % (n + 1)
    known = np.flatnonzero(context_counts[left] > 0)
    left, right = left[known], right[known]
    context, word = np.concatenate([ids, [BEGIN]])[left], ids[right]
    mixed = (context.view(np.uint64) ^ np.where(context_counts[left] > hot, word * 31 + 1, 0).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    part = ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((word, context, part))
    place = np.full(len(distinct), -1)
    place[known[order]] = np.arange(len(order))
    return Pairs(np.repeat(np.arange(len(sizes)), sizes), place[at], counts[codes], part[order], context[order], context_counts[left][order], word[order], counts[right][order], trained[known][order])


def heads(context: np.ndarray) -> np.ndarray:
    """Where a new context starts in sorted pairs."""
    return np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, dtype=np.int64)


def pair_counts(joined: DataFrame, words: Words, parts: int, hot: int) -> DataFrame:
    """Counts for the pairs of every batch and sums over the contexts it backs off from; rows of batch -1 hold totals
    and the sums of hot contexts."""
    def sent(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples():
                p = pairs_of(row, words, parts, hot)
                cuts = np.searchsorted(p.part, np.arange(parts + 1)).tolist()
                out = []
                for q, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    if b > a:
                        first = heads(p.context[a:b])
                        need = np.minimum.reduceat(p.trained[a:b], first) == 0
                        out.append((q, row.batch, *map(squeeze, (p.context[a:b][first], first, p.context_count[a:b][first], need, p.word[a:b], p.count[a:b], p.trained[a:b]))))
                yield pd.DataFrame(out, columns=["part", "batch", "contexts", "first", "context_counts", "need", "words", "counts", "trained"])

    def summed(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        get = lambda name, kind: [unsqueeze(x, kind) for x in f[name]]
        contexts, first, seen, need = get("contexts", "i8"), get("first", "i8"), get("context_counts", "i8"), get("need", "?")
        word, count, trained = get("words", "i8"), get("counts", "i8"), get("trained", "i8")
        context = np.concatenate([np.repeat(c, np.diff(a, append=len(w))) for c, a, w in zip(contexts, first, word)])
        all_words = np.concatenate(word)
        order = np.lexsort((all_words, context))
        new = np.concatenate([[True], (context[order][1:] != context[order][:-1]) | (all_words[order][1:] != all_words[order][:-1])])
        at = np.empty(len(order), dtype=np.int64)
        at[order] = new.cumsum() - 1
        total = np.zeros(int(new.sum()), dtype=np.int64)
        np.add.at(total, at, np.concatenate(trained))
        context, share = context[order][new], words.probability(np.concatenate(count)[order][new])
        edge = heads(context)
        owner = np.repeat(np.arange(len(edge)), np.diff(edge, append=len(context)))
        sums = np.stack([np.bincount(owner, weights=v, minlength=len(edge)) for v in (*[(total == r).astype(float) for r in range(1, LIMIT + 1)], share * (total > 0))], axis=1)
        names = context[edge]
        out, lo = [], 0
        for batch, c, wanted, w in zip(f["batch"], contexts, need, word):
            mine = sums[np.searchsorted(names, c[wanted])]
            out.append((batch, key[0], squeeze(total[at[lo:lo + len(w)]]), squeeze(mine[:, :LIMIT].astype(np.int64).T.reshape(-1)), squeeze(mine[:, LIMIT]), None, None))
            lo += len(w)
        counts_of = dict(zip(np.concatenate(contexts).tolist(), np.concatenate(seen).tolist()))
        large = [(c, s.tolist()) for c, s in zip(names.tolist(), sums) if counts_of[c] > hot]
        low = np.bincount(total[total <= LIMIT + 1], minlength=LIMIT + 2)[1:].tolist()
        out.append((-1, key[0], None, None, None, low, large))
        return pd.DataFrame(out, columns=["batch", "part", "totals", "low_types", "shares", "low", "large"])

    dealt = joined.mapInPandas(sent, "part int, batch long, contexts binary, first binary, context_counts binary, need binary, words binary, counts binary, trained binary")
    return dealt.groupBy("part").applyInPandas(summed, "batch long, part int, totals binary, low_types binary, shares binary, low array<long>, large array<struct<context:long,sums:array<double>>>")


def backoff(low_types: np.ndarray, context_count: np.ndarray, shares: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Backoff weights: mass the seen pairs leave over mass their words leave."""
    small = low_types * np.arange(1, LIMIT + 1)
    freed = ((small * (1 - d[1:LIMIT + 1])).sum(axis=1) + (1 - HIGH) * (context_count - small.sum(axis=1))) / context_count
    return freed / np.maximum(1 - shares, 1e-300)


def score(docs: DataFrame, batch_tokens: int = BATCH_TOKENS, part_entries: int = PART_ENTRIES, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    table = cut(batches(docs, batch_tokens), "batches")
    entries = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.size(F.filter("held", lambda h: ~h))), F.lit(0)).alias("docs")).first()
    parts = max(1, -(-entries["n"] // part_entries))
    known = cut(word_counts(table, parts), "words")
    all_parts = known.filter("batch = -1").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types"), *[F.sum(F.get("low", F.lit(r))).alias(f"n{r}") for r in range(LIMIT + 1)]).first()
    words = Words(all_parts["tokens"] or 0, all_parts["types"] or 0, entries["docs"], tuple(all_parts[f"n{r}"] or 0 for r in range(LIMIT + 1)))
    hot = max(hot, words.tokens // MOST_HOT)
    # each list is as long as the batch has parts
    per_batch = known.filter("batch >= 0").groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("part", "ids", "counts"))).alias("known"))
    joined = table.select("batch", "doc_ids", "held", "sizes", "codes").join(per_batch, "batch")
    pair_parts = max(1, 4 * parts)
    found = cut(pair_counts(joined.drop("doc_ids"), words, pair_parts, hot), "pairs")
    totals = found.filter("batch = -1")
    low = totals.agg(*[F.coalesce(F.sum(F.get("low", F.lit(r))), F.lit(0)) for r in range(LIMIT + 1)]).first()
    d = discounts(list(low))
    parted = totals.select(F.explode("large").alias("x")).groupBy("x.context").agg(*[F.sum(F.get("x.sums", F.lit(r))).alias(f"s{r}") for r in range(LIMIT + 1)])
    large = {r["context"]: [r[f"s{k}"] for k in range(LIMIT + 1)] for r in parted.collect()}  # at most MOST_HOT rows
    returned = found.filter("batch >= 0").groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("part", "totals", "low_types", "shares"))).alias("pairs"))
    whole = joined.join(returned, "batch", "left")

    def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples():
                p = pairs_of(row, words, pair_parts, hot)
                logs = np.log10(words.probability(p.word_count))
                if len(p.part):
                    back = list(row.pairs)
                    total = np.concatenate([unsqueeze(x["totals"], "i8") for x in back])
                    types = np.concatenate([unsqueeze(x["low_types"], "i8").reshape(LIMIT, -1).T for x in back])
                    shares = np.concatenate([unsqueeze(x["shares"], "f8") for x in back])
                    first = np.flatnonzero(np.concatenate([[True], (p.context[1:] != p.context[:-1]) | (p.part[1:] != p.part[:-1])]))
                    need = first[np.minimum.reduceat(p.trained, first) == 0]
                    for k, c in enumerate(p.context[need].tolist()):
                        if c in large:
                            types[k], shares[k] = large[c][:LIMIT], large[c][LIMIT]
                    weight = np.ones(len(first))
                    weight[np.searchsorted(first, need)] = backoff(types, p.context_count[need], shares, d)
                    weight = np.repeat(weight, np.diff(first, append=len(p.part)))
                    seen = total * d[np.minimum(total, LIMIT + 1)] / p.context_count
                    value = np.where(total > 0, seen, weight * words.probability(p.count))
                    paired = p.pair >= 0
                    logs[paired] = np.log10(value)[p.pair[paired]]
                yield by_document(row, p, logs)

    def by_document(row, p: Pairs, logs: np.ndarray) -> pd.DataFrame:
        n = len(row.doc_ids)
        add = lambda v: np.bincount(p.document, weights=v, minlength=n)
        base = np.log10((p.word_count + 1) / (words.tokens + words.types + 1))
        return pd.DataFrame({"doc_id": list(row.doc_ids), "held_out": list(row.held), "n_tokens": np.bincount(p.document, minlength=n), "n_known": add(p.word_count > 0).astype(np.int64),
                             "train_tokens": words.tokens, "base_score": add(base), "score": add(logs)})

    return whole.mapInPandas(added, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
