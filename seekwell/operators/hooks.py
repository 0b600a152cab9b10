"""Hooks for user models: encode, score, generate, map rows. No model is shipped.

Every hook is an iterator over Arrow batches, so a model is loaded once per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from seekwell.functions.text import tokens, truncate


def hashing_encoder(dim: int = 64) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """Deterministic bag-of-words vectors by token digest; stands in for a model in tests."""

    def load():
        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim), dtype=np.float64)
            for row, text in enumerate(texts):
                for token in text.split():
                    digest = hashlib.md5(token.encode()).digest()
                    out[row, int.from_bytes(digest[:4], "big") % dim] += 1.0 if digest[4] & 1 else -1.0
            return out

        return encode

    return load


def embed(df: DataFrame, col: str, encoder: Callable, instruction: str = "", max_tokens: int | None = None,
          normalize: bool = True, out: str = "embedding") -> DataFrame:
    """Add vectors from ``encoder``, a factory that returns ``texts -> matrix``.

    ``instruction`` is put in front of the text; it is meant for queries only.
    """
    text = F.array_join(truncate(tokens(col), max_tokens), " ") if max_tokens else F.col(col)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder()
        for batch in batches:
            m = np.asarray(encode(batch.fillna("").tolist()), dtype=np.float64)
            if normalize:
                norm = np.linalg.norm(m, axis=1, keepdims=True)
                m = m / np.where(norm == 0, 1, norm)
            yield pd.Series(list(m.astype(np.float32)))

    return df.withColumn(out, run(F.concat(F.lit(instruction), text)))


def score_pairs(df: DataFrame, query: str, passage: str, scorer: Callable, normalize: bool = False, out: str = "score") -> DataFrame:
    """Add scores from ``scorer``, a factory that returns ``(queries, passages) -> scores``."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = scorer()
        for q, p in batches:
            yield pd.Series(np.asarray(score(q.tolist(), p.tolist()), dtype=np.float64))

    value: Column = run(F.col(query), F.col(passage))
    return df.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-value)) if normalize else value)


def generate(df: DataFrame, prompt: str, model: Callable, retries: int = 3, out: str = "answer", batch_size: int = 64) -> DataFrame:
    """Add answers from ``model``, a factory that returns ``prompt -> text``. A prompt that
    still fails after ``retries`` attempts gets an empty answer.

    A model with a ``batch`` method (a list of prompts to a list of texts) is asked for up to
    ``batch_size`` prompts at once; a batch that fails is asked prompt by prompt.
    """

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ask = model()
        many = getattr(ask, "batch", None)

        def attempt(text):
            for _ in range(retries):
                try:
                    return ask(text)
                except Exception:
                    continue
            return ""

        def answers(texts: list) -> list:
            try:
                got = list(many(texts))
            except Exception:
                got = []
            return got if len(got) == len(texts) else [attempt(t) for t in texts]

        for batch in batches:
            if many is None:
                yield batch.map(attempt)
            else:
                texts = batch.tolist()
                yield pd.Series([a for at in range(0, len(texts), batch_size) for a in answers(texts[at:at + batch_size])], dtype=object)

    return df.withColumn(out, run(F.col(prompt)))


def map_rows(df: DataFrame, fn: Callable[[dict], dict | None], schema) -> DataFrame:
    """One output row per input row; rows mapped to ``None`` are dropped."""
    return flat_map_rows(df, lambda row: [r for r in (fn(row),) if r is not None], schema)


def flat_map_rows(df: DataFrame, fn: Callable[[dict], list[dict]], schema) -> DataFrame:
    """Any number of output rows per input row, batch by batch."""
    from pyspark.sql.types import StructType

    names = (schema if isinstance(schema, StructType) else StructType.fromDDL(schema)).names

    def run(batches):
        for pdf in batches:
            rows = [r for row in pdf.to_dict("records") for r in fn(row)]
            yield pd.DataFrame(rows, columns=names)

    return df.mapInPandas(run, schema)


def mean_vectors(df: DataFrame, by: str, vector: str, weight: str | None = None) -> DataFrame:
    """Weighted average of the vectors of each group, summed by position so that no group
    is ever collected; only the finished vector is."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(by, w.alias("_w"), F.posexplode(vector).alias("_i", "_x"))
    sums = rows.groupBy(by, "_i").agg((F.sum(F.col("_w") * F.col("_x").cast("double")) / F.sum("_w")).alias("_x"))
    return sums.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias(vector))
