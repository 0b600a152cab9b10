"""Retrieval inside one conversation or one long document."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seekwell.functions.text import token_counts, tokens
from seekwell.functions.vectors import vec_dot
from seekwell.scale import MAX_HOT_KEYS, ROWS_PER_SALT, seeded, top_rows


def local_bm25(items: DataFrame, queries: DataFrame, k: int, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """BM25 inside groups: ``items (grp, item, toks)``, ``queries (grp, q, toks)``.

    Keys are (group, token), so a large group is spread over its tokens. Every group has
    its own document frequencies and size. A group of more than ``ROWS_PER_SALT`` items is
    spread over salts as well: its postings by item, its few query weights copied to each.
    """
    postings = items.select("grp", "item", F.size("toks").alias("dl"), F.inline(token_counts(F.col("toks"))))
    df = postings.groupBy("grp", "token").agg(F.count(F.lit(1)).alias("df"))
    size = items.groupBy("grp").agg(F.count(F.lit(1)).cast("double").alias("n_items"))
    q = queries.select("grp", "q", F.inline(token_counts(F.col("toks")))).withColumnRenamed("n", "qtf")
    idf = F.log((F.col("n_items") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weights = q.join(df, ["grp", "token"]).join(size, "grp").select("grp", "q", "token", (F.col("qtf") * idf * F.lit(k1 + 1)).alias("w"))
    part = F.col("w") * F.col("n") / (F.col("n") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl")))
    # the list of large groups is short: their items add up to the table, and never more than MAX_HOT_KEYS pass the cut
    total = size.agg(F.sum("n_items").alias("n")).first()["n"] or 0
    cut = max(ROWS_PER_SALT, total / MAX_HOT_KEYS)
    large = size.filter(F.col("n_items") > cut).select("grp", F.ceil(F.col("n_items") / cut).cast("int").alias("_salts"))
    if total > cut:
        salts = F.broadcast(large)
        postings = postings.join(salts, "grp", "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("item"), F.col("_salts")).cast("int"), F.lit(0))).drop("_salts")
        weights = weights.join(salts, "grp", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts")
    keys = ["grp", "token", "_salt"] if total > cut else ["grp", "token"]
    scored = postings.join(weights, keys).groupBy("grp", "q", "item").agg(F.round(F.sum(part), 6).alias("score"))
    return top_rows(scored.filter(F.col("score") != 0), ["grp", "q"], [F.col("score").desc(), F.col("item")], k)


def split_history(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The last user turn of every conversation as query, and the turns before it."""
    last = turns.filter(F.col("role") == "user").groupBy("conv_id").agg(F.max("turn").alias("_last"))
    rows = turns.join(last, "conv_id")
    query = rows.filter(F.col("turn") == F.col("_last")).drop("_last")
    return query, rows.filter(F.col("turn") < F.col("_last")).drop("_last")


def history_retrieve(history: DataFrame, query: DataFrame, method: str = "recent", k: int = 1, order: str = "sequential", seed: int = 42) -> DataFrame:
    """``k`` past turns per conversation joined in front of the query.

    ``recent``, ``random`` (seeded), ``bm25``, ``dense`` (column ``embedding`` on both
    sides) or ``oracle`` (column ``loss`` on the history, smallest wins). ``order`` is
    ``sequential`` or ``relevance`` (best turn last).
    """
    conv, turn = F.col("conv_id"), F.col("turn")
    if method == "recent":
        picked = top_rows(history, ["conv_id"], [turn.desc()], k)
    elif method == "random":
        picked = top_rows(history.withColumn("_h", seeded(seed, "conv_id", "turn")), ["conv_id"], [F.col("_h"), turn], k)
    elif method == "oracle":
        picked = top_rows(history, ["conv_id"], [F.col("loss"), turn], k)
    elif method == "dense":
        scored = history.join(query.select("conv_id", F.col("embedding").alias("_q")), "conv_id").withColumn("_s", F.round(vec_dot("_q", "embedding"), 6))
        picked = top_rows(scored, ["conv_id"], [F.col("_s").desc(), turn], k)
    elif method == "bm25":
        items = history.select(conv.alias("grp"), turn.alias("item"), tokens("text").alias("toks"))
        asked = query.select(conv.alias("grp"), F.lit(0).alias("q"), tokens("text").alias("toks"))
        hits = local_bm25(items, asked, k).select(F.col("grp").alias("conv_id"), F.col("item").alias("turn"), "rank")
        picked = history.join(hits, ["conv_id", "turn"])
    else:
        raise ValueError(f"unknown method {method!r}")
    key = {"sequential": F.col("turn").cast("long"), "relevance": -F.col("rank").cast("long")}[order]
    joined = picked.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(key.alias("o"), "text"))).alias("_h"))
    text = F.array_join(F.transform("_h", lambda x: x["text"]), "\n")
    # a conversation without a usable turn still asks its question
    asked = query.select("conv_id", F.col("text").alias("_q")).join(joined, "conv_id", "left")
    return asked.select("conv_id", F.when(F.col("_h").isNull(), F.col("_q")).otherwise(F.concat(text, F.lit("\n"), F.col("_q"))).alias("prompt"))


def chunk_retrieve(docs: DataFrame, chunk: int, window: int, k: int, mode: str = "replace", continuation: bool = False, pad: str = "<pad>") -> DataFrame:
    """Self-retrieval of long documents.

    Documents are left-padded to whole chunks of ``chunk`` tokens. The last chunk is the
    target, the one before it the query. Keys are the chunks that leave the ``window``;
    the value of a hit is the chunk and the one after it. ``replace`` trades the oldest
    ``2 k`` chunks of the window for the values, ``concat`` puts them in front.
    """
    toks = docs.select("doc_id", tokens("text").alias("_t")).withColumn("_c", F.ceil(F.size("_t") / F.lit(chunk)).cast("int"))
    full = F.concat(F.array_repeat(F.lit(pad), F.col("_c") * chunk - F.size("_t")), F.col("_t"))
    w = F.least(F.col("_c"), F.lit(window // chunk))
    n_keys = F.col("_c") - w + 1 if mode == "replace" else F.col("_c") - w - 1
    if mode not in ("replace", "concat"):
        raise ValueError(f"unknown mode {mode!r}")
    base = toks.select("doc_id", full.alias("_t"), "_c", w.alias("_w"), n_keys.alias("_k")).filter((F.col("_k") >= 1) & (F.col("_c") >= 2))
    if mode == "replace":
        # the window must hold the target, the query and the chunks that are replaced
        base = base.filter(F.col("_w") >= 2 + 2 * k)
    chunks = base.select("doc_id", "_k", "_c", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("_c") - 1), lambda i: F.slice("_t", i * chunk + 1, F.lit(chunk)))).alias("item", "toks"))
    keys = chunks.filter(F.col("item") < F.col("_k"))
    if continuation:
        nxt = chunks.select("doc_id", (F.col("item") - 1).alias("item"), F.col("toks").alias("_next"))
        keys = keys.join(nxt, ["doc_id", "item"]).withColumn("toks", F.concat("toks", "_next"))
    real = lambda c: F.filter(c, lambda x: x != pad)
    items = keys.select(F.col("doc_id").alias("grp"), "item", real(F.col("toks")).alias("toks"))
    asked = chunks.filter(F.col("item") == F.col("_c") - 2).select(F.col("doc_id").alias("grp"), F.lit(0).alias("q"), real(F.col("toks")).alias("toks"))
    hits = local_bm25(items, asked, k).select(F.col("grp").alias("doc_id"), "item", "rank")
    values = (hits.withColumn("item", F.explode(F.array(F.col("item"), F.col("item") + 1)))
              .join(chunks.select("doc_id", "item", "toks"), ["doc_id", "item"]))
    found = values.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("r"), "item", "toks"))).alias("_v"))
    keep = F.col("_w") - 2 * k if mode == "replace" else F.col("_w")
    # a document whose query chunk matches nothing keeps its plain window
    keep = F.when(F.col("_v").isNull(), F.col("_w")).otherwise(keep)
    fixed = F.slice("_t", (F.col("_c") - keep) * chunk + 1, keep * chunk)
    none = F.array().cast("array<string>")
    out = base.join(found, "doc_id", "left").select("doc_id", F.concat(F.coalesce(F.flatten(F.transform("_v", lambda x: x["toks"])), none), fixed).alias("_all"))
    return out.select("doc_id", F.array_join(real(F.col("_all")), " ").alias("context"))
