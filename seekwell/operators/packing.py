"""Fixed-length sequences, sliding windows and language-model rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from seekwell.functions.text import tokens, truncate
from seekwell.scale import running_total


def pack_mixture(docs: DataFrame, mixture: dict[str, float], total_tokens: int, length: int, eos: str = "</s>", tokenizer="whitespace") -> DataFrame:
    """Concatenate the documents of each source, end marks included, and cut the stream into
    pieces of ``length`` tokens until the source's share of ``total_tokens`` is reached.

    ``docs`` is ``(source, doc_id, text)`` and the stream order is ``doc_id``. The place of a
    document in its stream is a two-pass running sum. Every document is cut at the piece
    borders it crosses, so only parts of documents are shuffled and a group is one piece.
    """
    quota = {s: math.ceil(math.ceil(total_tokens * share / 100) / length) for s, share in mixture.items() if share > 0}
    limits = F.create_map(*[F.lit(x) for kv in quota.items() for x in kv])
    known = docs.filter(F.col("source").isin(list(quota)))
    rows = known.select("source", "doc_id", F.concat(tokens("text", tokenizer), F.array(F.lit(eos))).alias("_t"))
    size = known.select("source", "doc_id", (F.size(tokens("text", tokenizer)) + 1).alias("_n"))
    ends = running_total(size, ["source"], "doc_id", F.col("_n"), "_end")
    start = F.col("_end") - F.col("_n")
    pieces = F.sequence(F.floor(start / length), F.floor((F.col("_end") - 1) / length))
    placed = (rows.join(ends, ["source", "doc_id"]).withColumn("_start", start)
              .withColumn("piece", F.explode(pieces)).filter(F.col("piece") < F.element_at(limits, F.col("source"))))
    low = F.greatest(F.col("piece") * length - F.col("_start"), F.lit(0))
    high = F.least((F.col("piece") + 1) * length - F.col("_start"), F.col("_n"))
    parts = placed.select("source", "piece", F.col("_start"), F.slice("_t", (low + 1).cast("int"), (high - low).cast("int")).alias("_p"))
    joined = parts.groupBy("source", "piece").agg(F.array_sort(F.collect_list(F.struct("_start", "_p"))).alias("_s"))
    out = joined.select("source", "piece", F.flatten(F.transform("_s", lambda x: x["_p"])).alias("tokens"))
    return out.filter(F.size("tokens") == length)


def sliding_windows(docs: DataFrame, max_length: int, stride: int, min_length: int | None = None, tokenizer="whitespace") -> DataFrame:
    """Windows ``(doc_id, window, tokens, labelled)``; only tokens not seen by an earlier
    window are labelled. ``stride=0`` makes one window."""
    rows = docs.select("doc_id", tokens("text", tokenizer).alias("_t")).withColumn("_n", F.size("_t")).filter(F.col("_n") > 0)
    if min_length is not None:
        rows = rows.filter(F.col("_n") >= min_length)
    if stride == 0:
        count = F.lit(1)
        stride = max_length
    else:
        count = F.greatest(F.ceil((F.col("_n") - max_length) / F.lit(stride)), F.lit(0)) + 1
    end = lambda i: F.least(i * stride + max_length, F.col("_n"))
    out = rows.withColumn("window", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))))
    i = F.col("window")
    labelled = end(i) - F.when(i == 0, F.lit(0)).otherwise(end(i - 1))
    return out.select("doc_id", "window", F.slice("_t", i * stride + 1, F.lit(max_length)).alias("tokens"), labelled.alias("labelled"))


def suffix_targets(docs: DataFrame, context: int, target: int, anchor: int, tokenizer="whitespace") -> DataFrame:
    """The last ``context`` tokens of the first ``anchor`` characters, with the last
    ``target`` tokens labelled; shorter documents are dropped."""
    t = truncate(tokens(F.substring("text", 1, anchor), tokenizer), context, "tail")
    rows = docs.select("doc_id", t.alias("tokens")).filter(F.size("tokens") >= target)
    return rows.withColumn("masked", F.size("tokens") - target).withColumn("labelled", F.lit(target))


def language_rows(docs: DataFrame, min_length: int, max_length: int, eos: str = "</s>", tokenizer="whitespace") -> DataFrame:
    """Drop short texts, end-mark texts that fit, cut the others."""
    rows = docs.select("doc_id", tokens("text", tokenizer).alias("_t")).filter(F.size("_t") >= min_length)
    fits = F.size("_t") < max_length
    return rows.select("doc_id", F.when(fits, F.concat("_t", F.array(F.lit(eos)))).otherwise(F.slice("_t", 1, max_length)).alias("tokens"))


def instruction_rows(df: DataFrame, max_length: int, tokenizer="whitespace") -> DataFrame:
    """``(id, input, output)``: over-long outputs are dropped, inputs lose their middle so
    that both fit."""
    rows = df.select("id", tokens(F.trim("input"), tokenizer).alias("_i"), tokens(F.trim("output"), tokenizer).alias("_o")).filter(F.size("_o") <= max_length)
    room = F.lit(max_length) - F.size("_o")
    half = F.floor(room / 2).cast("int")
    middle = F.concat(F.slice("_i", F.lit(1), half), F.slice("_i", F.size("_i") - half + 1, half))
    kept = F.when(F.size("_i") > room, middle).otherwise(F.col("_i"))
    return rows.select("id", F.array_join(kept, " ").alias("input"), F.array_join("_o", " ").alias("output"))


def text_of(col: Column | str) -> Column:
    return F.array_join(col, " ")
