"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a text are computed inside the tasks from whole texts. The trees are fitted on at most ``max_rows``
labelled rows (those with the smallest id hashes, so the choice does not depend on the layout of the data), which is
the only thing that reaches the driver. The fitted trees are flat arrays in heap order; a batch of documents walks
all trees at once with array indexing.

Defined results: a null or empty text has all statistics zero and still gets a score; a null id counts as the empty
text in the hold-out hash; labelled rows with a null label are not learned from; of rows that share id and label one
is learned from; without labels of both classes every score is the share of label 1 (0.5 without labels); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from seekwell.llm.common import clean_input, short_batches
from seekwell.llm.quality_rules import STOP_WORDS

MAX_TRAINING_ROWS = 20_000
TREES, DEPTH, RATE, BINS, PENALTY, LEAST_CHILD = 80, 4, 0.15, 64, 1.0, 2.0
THRESHOLD = 0.3
_STOPS = frozenset(STOP_WORDS)
_SYMBOLS = np.frombuffer(b"#*$%&|<>~^_=+@\\", dtype=np.uint8)
STATISTICS = ("n_words", "n_bytes", "mean_word", "longest_word", "distinct_share", "repeat_share", "stop_share", "upper_share", "digit_share",
              "symbol_share", "bar_share", "mark_share", "point_share", "beyond_ascii_share", "n_lines", "words_per_line", "repeated_line_share", "top_byte_share", "capital_words")


def statistics(text: str | None) -> list[float]:
    """The numbers in ``STATISTICS`` for one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(STATISTICS)
    words = text.split()
    n, size = max(len(words), 1), len(raw)
    seen = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    lines = [x for x in text.split("\n") if x]
    repeats = sum(map(str.__eq__, words, words[1:])) if len(words) > 1 else 0
    return [len(words), size, sum(map(len, words)) / n, max(map(len, words), default=0), len(set(words)) / n, repeats / n,
            sum(map(_STOPS.__contains__, words)) / n, seen[65:91].sum() / size, seen[48:58].sum() / size, seen[_SYMBOLS].sum() / size, seen[124] / size,
            seen[33] / size, (seen[46] + seen[44]) / size, seen[128:].sum() / size, len(lines), n / max(len(lines), 1),
            1 - len(set(lines)) / max(len(lines), 1), np.delete(seen, 32).max() / size, sum(w[:1].isupper() for w in words) / n]


@dataclass(frozen=True)
class Trees:
    """Complete binary trees in heap order: inner nodes first, then 2**depth leaves each."""

    feature: np.ndarray  # (trees, inner)
    border: np.ndarray  # (trees, inner)
    leaf: np.ndarray  # (trees, leaves)
    start: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        total = np.full(len(x), self.start)
        trees = np.arange(len(self.feature))[None, :]
        for lo in range(0, len(x), 4096):
            part = x[lo:lo + 4096]
            rows, node = np.arange(len(part))[:, None], np.zeros((len(part), len(self.feature)), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (part[rows, self.feature[trees, node]] > self.border[trees, node])
            total[lo:lo + 4096] += self.leaf[trees, node - (2**self.depth - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosted trees for the logistic loss; splits are searched in histograms of at most ``BINS`` bins."""
    n, width = x.shape if len(x) else (0, len(STATISTICS))
    share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if n else 0.5
    start, inner, leaves = float(np.log(share / (1 - share))), 2**depth - 1, 2**depth
    if n == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)), start, depth)
    borders = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(width)]
    codes = np.stack([np.searchsorted(b, x[:, f], side="left") for f, b in enumerate(borders)])  # bin <= b: value <= borders[b]
    out = np.full(n, start)
    feature, border, leaf = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-out))
        g, h, node = y - p, p * (1 - p), np.zeros(n, dtype=np.int64)
        for level in range(depth):
            width_l, first = 2**level, 2**level - 1
            local = node - first
            best, choice = np.full(width_l, 1e-9), np.full((width_l, 2), -1)
            for f in range(width):
                key = local * BINS + codes[f]
                sums = [np.bincount(key, weights=v, minlength=width_l * BINS).reshape(width_l, BINS).cumsum(axis=1) for v in (g, h)]
                (gl, hl), (ga, ha) = sums, (s[:, -1:] for s in sums)
                gain = gl**2 / (hl + PENALTY) + (ga - gl) ** 2 / (ha - hl + PENALTY) - ga**2 / (ha + PENALTY)
                gain[(hl < LEAST_CHILD) | (ha - hl < LEAST_CHILD)] = 0
                gain[:, len(borders[f]):] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(width_l), at]
                better = top > best
                best[better], choice[better] = top[better], np.stack([np.full(width_l, f), at], axis=1)[better]
            right = np.zeros(n, dtype=bool)
            for k, (f, b) in enumerate(choice):
                if f >= 0:
                    feature[t, first + k], border[t, first + k] = f, borders[f][b]
                    mine = local == k
                    right[mine] = codes[f][mine] > b
            node = 2 * node + 1 + right
        local = node - inner
        leaf[t] = RATE * np.bincount(local, weights=g, minlength=leaves) / (np.bincount(local, weights=h, minlength=leaves) + PENALTY)
        out += leaf[t][local]
    return Trees(feature, border, leaf, start, depth)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAINING_ROWS) -> Trees:
    """Trees for ``label`` from at most ``max_rows`` labelled rows outside the hold-out."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("y").isNotNull() & ~held_out(F.col("doc_id"), 5, 0)).distinct()
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)
    # at most ``max_rows`` pairs of numbers, so the broadcast is bounded
    rows = clean_input(docs).join(F.broadcast(picked), "doc_id")

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "x": [statistics(t) for t in b["text"]]})

    one = rows.mapInPandas(measured, f"doc_id {dict(docs.dtypes)['doc_id']}, y int, x array<double>").groupBy("doc_id", "y").agg(F.min("x").alias("x"))
    got = sorted((r["x"], r["y"]) for r in one.collect())
    return fit(np.array([r[0] for r in got], dtype=float).reshape(len(got), len(STATISTICS)), np.array([r[1] for r in got], dtype=float))


def classify(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: its score and the decision."""
    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array([statistics(t) for t in b["text"]], dtype=float).reshape(len(b), len(STATISTICS))
            yield b.drop(columns="text").assign(score=model.score(x))

    rows = clean_input(docs).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "text")
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    out = rows.mapInPandas(scored, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text scores below ``threshold``; all columns stay, whatever their types."""
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(model.score(np.array([statistics(v) for v in t], dtype=float).reshape(len(t), len(STATISTICS))))

    return short_batches(docs).filter(F.pandas_udf(scored, "double")(F.col("text")) >= threshold)
