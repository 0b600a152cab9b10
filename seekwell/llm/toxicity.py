"""Toxicity by compression distance: is a window shorter when toxic text may be quoted?

Two zstandard dictionaries are trained: one on windows of ordinary documents, one on windows of toxic documents. A
toxic document is mostly ordinary text, so its dictionary is trained in rounds: each round trains on the toxic
documents that earlier rounds do not explain and keeps the trained words that stand in toxic windows many times more
often than in ordinary ones. Every document is cut into overlapping windows of four words, and each window is compressed twice: after
the ordinary dictionary, and after the toxic one followed by the ordinary one. The ordinary bytes stand at the same
distance both times, so the lengths differ only where the toxic dictionary helps. How often a document's windows gain
2 to 6 bytes, and how much the best one gains, is turned into a probability by a logistic curve calibrated on labelled
documents that no dictionary has seen.

Scale: training reads a bounded sample of labelled rows (those with the smallest id hashes, at most ``TOXIC_BYTES`` and
``ORDINARY_BYTES`` of text), which is all that reaches the driver; the model is some 100 KB. Scoring is one pass over
the documents without any shuffle, one batch of texts at a time.

Defined results: a null or empty text has no windows and still gets a score; a null id counts as the empty text in the
hold-out hash; labelled rows with a null label are not learned from; of rows that share id, label and text one is learned
from; without labels of both classes every score is the share of label 1 (0.5 without labels); an empty table gives an
empty result; other columns are ignored; equal texts get equal scores.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seekwell.llm.common import clean_input

HOLD_OUT, HOLD_OUT_PART = 5, 0
TOXIC_BYTES, ORDINARY_BYTES, MAX_ROWS = 6_000_000, 16_000_000, 20_000
WORDS, STRIDE = 4, 3
ORDINARY_SIZE, TOXIC_SIZE, MOST_SAMPLES, ROUNDS = 96 * 1024, 16 * 1024, 150_000, 6
LEVEL, LEAST_WORD, EXPLAINED, TIMES_MORE = 9, 4, 3, 30
GAINS = (2, 3, 4, 5, 6)
THRESHOLD = 0.5
# A long run after each window: a block is only stored compressed when that saves some bytes, which the run always does.
TAIL = b" " + b"\x01" * 32
# Letters and digits stay (A-Z in lower case), all beyond ASCII stays, the rest becomes a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def windows(text: str | None) -> list[bytes]:
    """Overlapping windows of a whole text, each between blanks."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    return [b" " + b" ".join(words[i:i + WORDS]) + TAIL for i in range(0, max(len(words) - WORDS + STRIDE, 1), STRIDE)] if words else []


def measure(content: bytes):
    """A function from windows to their compressed lengths after ``content``."""
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(level=LEVEL)
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress
    return lambda parts: np.fromiter((len(press(p)) for p in parts), np.int64, len(parts))


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary of at most ``size`` bytes; with too few samples for training, their own bytes."""
    samples = samples[::-(-len(samples) // MOST_SAMPLES)] if samples else samples
    try:
        return zstandard.train_dictionary(size, samples, k=32, d=6).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def curve(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Weights (first the constant) of a logistic curve, by Newton's method."""
    x, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        bend = (x * (p * (1 - p))[:, None]).T @ x / len(y) + penalty * np.eye(len(w))
        w = w + np.linalg.solve(bend, x.T @ (y - p) / len(y) - penalty * w)
    return w


@dataclass(frozen=True)
class Model:
    """Both dictionaries, the weights of the curve, and the score where nothing could be learned."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    share: float

    def scorer(self):
        """A function from texts to probabilities."""
        if not self.weights:
            return lambda texts: np.full(len(texts), self.share)
        plain, both, w = measure(self.ordinary), measure(self.toxic + self.ordinary), np.array(self.weights)
        return lambda texts: 1 / (1 + np.exp(-np.clip(w[0] + np.array([features(windows(t), plain, both) for t in texts]).reshape(len(texts), len(GAINS) + 2) @ w[1:], -30, 30)))


def features(parts: list[bytes], plain, both) -> list[float]:
    """Best gain, number of windows that gain so much each, number of windows (logarithms of counts)."""
    gain = plain(parts) - both(parts)
    return [float(np.clip(gain.max(initial=0), 0, 8)), *np.log1p([(gain >= g).sum() for g in GAINS]).tolist(), float(np.log1p(len(gain)))]


def _fresh(texts: list[str]) -> list[list[bytes]]:
    """Windows of each text that no earlier text has, without their tails, so that copies count once."""
    seen: set[bytes] = set()
    out = []
    for t in texts:
        mine = {w[:-len(TAIL)] + b" " for w in windows(t)} - seen
        seen |= mine
        out.append(sorted(mine))
    return out


def _support(parts: Iterable[list[bytes]]) -> tuple[Counter, int]:
    counts, n = Counter(), 0
    for ws in parts:
        n += len(ws)
        for w in ws:
            counts.update(set(w.split()))
    return counts, n


def fit(rows: list[tuple[str, int]]) -> Model:
    """The model for (text, label) rows. Three of ten texts, chosen by their checksum, only calibrate."""
    labels = [y for _, y in rows]
    share = sum(labels) / len(labels) if rows else 0.5
    learn, check = [], []
    for t, y in rows:
        (check if zlib.crc32(t.encode("utf-8", "surrogatepass")) % 10 < 3 else learn).append((t, y))
    toxic, ordinary = _fresh([t for t, y in learn if y]), _fresh([t for t, y in learn if not y])
    if not any(toxic) or not any(ordinary) or len({y for _, y in check}) < 2:
        return Model(b"", b"", (), share)
    base = trained([w for ws in ordinary for w in ws], ORDINARY_SIZE)
    (in_toxic, n_toxic), (in_ordinary, n_ordinary) = _support(toxic), _support(ordinary)
    least = int(np.clip(len(toxic) // 60, 2, 8))
    plain, left, kept, content = measure(base), toxic, [], b""
    for _ in range(ROUNDS):
        samples = [w for ws in left for w in ws]
        told = set(trained(samples, TOXIC_SIZE).split()) - set(kept) if samples else set()
        fresh = sorted(u for u in told if len(u) >= LEAST_WORD and in_toxic[u] >= least and in_toxic[u] * n_ordinary > TIMES_MORE * (in_ordinary[u] + 0.5) * n_toxic)
        if not fresh:
            break
        kept += fresh
        content = b" " + b" ".join(kept) + b" "
        both = measure(content + base)
        tailed = ([w[:-1] + TAIL for w in ws] for ws in left)
        left = [ws for ws, t in zip(left, tailed) if t and (plain(t) - both(t)).max() < EXPLAINED]
    both = measure(content + base)
    x = np.array([features(windows(t), plain, both) for t, _ in check])
    return Model(base, content, tuple(curve(x, np.array([y for _, y in check], dtype=float)).tolist()), share)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HOLD_OUT == HOLD_OUT_PART


def sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", toxic_bytes: int = TOXIC_BYTES, ordinary_bytes: int = ORDINARY_BYTES) -> DataFrame:
    """(text, y): labelled rows outside the hold-out, smallest id hashes first, up to ``MAX_ROWS`` rows and the given
    bytes of each class."""
    known = labels.select("doc_id", (F.col(label) != 0).cast("int").alias("y")).filter(F.col("y").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    first = known.withColumn("_at", F.row_number().over(W.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id"))).filter(F.col("_at") <= MAX_ROWS).drop("_at")
    # at most twice MAX_ROWS pairs of numbers, so the broadcast is bounded; the window below runs over their rows only
    rows = clean_input(docs).join(F.broadcast(first), "doc_id").filter(F.col("text").isNotNull())
    size = rows.select("doc_id", "y", F.xxhash64("doc_id").alias("_at"), F.xxhash64("text").alias("_text"), F.octet_length("text").alias("_size")).distinct()
    before = W.partitionBy("y").orderBy("_at", "doc_id", "_text").rowsBetween(W.unboundedPreceding, W.currentRow)
    taken = size.withColumn("_sum", F.sum("_size").over(before)).filter(F.col("_sum") <= F.when(F.col("y") == 1, toxic_bytes).otherwise(ordinary_bytes)).select("doc_id", "y", "_text")
    keyed = rows.withColumn("_text", F.xxhash64("text"))
    return keyed.join(F.broadcast(taken), ["doc_id", "y", "_text"]).select("text", "y").distinct()


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """The model for ``label`` from a bounded sample of the labelled rows."""
    return fit(sorted((r["text"], r["y"]) for r in sample(docs, labels, label).collect()))


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = model.scorer()
        for b in batches:
            yield b.drop(columns="text").assign(score=score(b["text"].tolist()))

    rows = clean_input(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    out = rows.mapInPandas(scored, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
