"""Which documents contain a phrase as a run of tokens.

Texts are tokenised once and stay where they are; phrases travel, in parts of bounded size. A task gives the phrases'
tokens numbers, finds the places of each number in a batch of documents, and anchors every phrase at its rarest token of
the batch: the anchor's places, shifted by its offset, are the possible starts, and each further token keeps the starts
whose shifted place holds it. A token that stands in every document costs nothing unless it is a phrase's rarest one, and
no token's documents ever meet in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from seekwell.functions.text import simple_tokens
from seekwell.scale import BROADCAST_BYTES, BROADCAST_TERM_ROWS, cut


class Phrases:
    """Phrases as token numbers, one after another."""

    def __init__(self, qids: list, tokens: list[list[str]]):
        self.qids = qids
        self.vocabulary = sorted({t for ts in tokens for t in ts})
        number = {t: i for i, t in enumerate(self.vocabulary)}
        self.code = np.array([number[t] for ts in tokens for t in ts], dtype=np.int64)
        self.start = np.cumsum([0, *map(len, tokens)])[:-1].astype(np.int64)
        self.size = np.array([len(ts) for ts in tokens], dtype=np.int64)

    def found(self, code: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(phrase, documents) for token numbers ``code`` (-1: no phrase has the token) of the documents ``doc``."""
        counts = np.bincount(code[code >= 0], minlength=len(self.vocabulary))
        if not len(self.code) or not counts.any():
            return
        order = np.argsort(code, kind="stable")[len(code) - counts.sum():]
        first = np.cumsum(np.append(0, counts))
        rare = np.minimum.reduceat(counts[self.code], self.start)
        for p in np.flatnonzero(rare > 0):
            mine = self.code[self.start[p]:self.start[p] + self.size[p]]
            anchor = int(counts[mine].argmin())
            places = order[first[mine[anchor]]:first[mine[anchor] + 1]] - anchor
            places = places[(places >= 0) & (places + len(mine) <= len(code))]
            for at, token in enumerate(mine):
                if at != anchor:
                    places = places[code[places + at] == token]
                    if not len(places):
                        break
            places = places[doc[places] == doc[places + len(mine) - 1]] if len(places) else places
            if len(places):
                yield int(p), np.unique(doc[places])


def phrase_matches(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """``(qid, docid)`` where the text of ``(docid, text)`` contains all tokens of ``(qid, query)`` as one run.

    A phrase without tokens is contained nowhere. With several phrases of one ``qid`` a document is returned once.
    """
    texts = docs.select("docid", simple_tokens("text", lower=True).alias("toks"))
    asked = phrases.select("qid", simple_tokens("query", lower=True).alias("toks")).filter(F.size("toks") > 0)
    size = asked.agg(F.coalesce(F.sum(F.size("toks")), F.lit(0)).alias("n"), F.coalesce(F.sum(F.octet_length(F.array_join("toks", " ")) + 24), F.lit(0)).alias("bytes")).first()
    n = max(1, math.ceil(size["n"] / BROADCAST_TERM_ROWS), math.ceil(size["bytes"] / BROADCAST_BYTES))
    if n == 1:
        return _scan(texts, asked)
    texts = cut(texts, "tokens")  # tokenised once, whatever the number of parts
    parts = [_scan(texts, asked.filter(F.pmod(F.xxhash64("qid"), F.lit(n)) == i)) for i in range(n)]
    return reduce(DataFrame.unionAll, parts)


def _scan(texts: DataFrame, part: DataFrame) -> DataFrame:
    rows = part.select("qid", "toks").toArrow().to_pylist()  # one bounded part of the phrases
    shared = texts.sparkSession.sparkContext.broadcast(Phrases([r["qid"] for r in rows], [r["toks"] for r in rows]))
    q_kind, d_kind = part.schema["qid"].dataType, texts.schema["docid"].dataType
    q_type = to_arrow_type(q_kind)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        known, qids = pa.array(phrases.vocabulary, pa.string()), pa.array(phrases.qids, q_type)
        for b in batches:
            lists = b.column("toks")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            code = pc.fill_null(pc.index_in(pc.list_flatten(lists), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            hits = {}
            for p, docs in phrases.found(code, np.repeat(np.arange(len(b)), sizes)):
                hits.setdefault(phrases.qids[p], [p, []])[1].append(docs)
            if hits:
                docs = [np.unique(np.concatenate(d)) for _, d in hits.values()]
                which = np.repeat([p for p, _ in hits.values()], [len(d) for d in docs])
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(which)), b.column("docid").take(pa.array(np.concatenate(docs)))], ["qid", "docid"])

    return texts.mapInArrow(search, f"qid {q_kind.simpleString()}, docid {d_kind.simpleString()}")
