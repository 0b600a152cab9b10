"""Training rows for retrievers: negatives, groups, teacher scores, buckets and batches.

All random choice is seeded: items are ordered by the md5 of seed, key and item, so a
rerun, another partitioning or another engine gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seekwell.functions.text import tokens
from seekwell.operators.ranking import rank_window
from seekwell.scale import hash_rank, seeded, seeded_place, stack, top_rows

# Upper borders of the length buckets and their batch sizes by group size.
LENGTH_BORDERS = (0, 500, 1000, 2000, 3000, 4000, 5000, 6000, 7000)
BATCH_SIZES = {
    8: (48, 32, 20, 18, 14, 14, 12, 10, 8),
    1: (700, 570, 388, 288, 224, 180, 157, 128, 104),
}


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def hard_negatives(run: DataFrame, positives: DataFrame, low: int, high: int, n: int, seed: int = 42, self_match: bool = False) -> DataFrame:
    """``n`` seeded negatives per query from the rank window, without positives."""
    window = rank_window(run, low, high).join(positives.select("qid", "docid").distinct(), ["qid", "docid"], "left_anti")
    if self_match:
        window = window.filter(F.col("qid") != F.col("docid"))
    picked = top_rows(window.select("qid", "docid").withColumn("_h", seeded(seed, "qid", "docid")), ["qid"], [F.col("_h"), F.col("docid")], n, "pos")
    return picked.drop("_h")


def backfill_negatives(queries: DataFrame, negatives: DataFrame, positives: DataFrame, corpus: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Fill queries with fewer than ``n`` negatives with seeded random documents.

    A short query draws ``n`` plus its number of positives from one seeded corpus order;
    after dropping positives and known negatives enough are left.
    """
    have = negatives.groupBy("qid").agg(F.count(F.lit(1)).alias("_have"))
    n_pos = positives.select("qid", "docid").distinct().groupBy("qid").agg(F.count(F.lit(1)).alias("_pos"))
    short = (queries.select("qid").join(have, "qid", "left").join(n_pos, "qid", "left").fillna(0, ["_have", "_pos"])
             .filter(F.col("_have") < n))
    order = hash_rank(corpus.select("docid").withColumn("_h", seeded(seed, "docid")), [], "_h", ["docid"], "_at").select("docid", "_at")
    size = corpus.agg(F.count(F.lit(1))).scalar()
    start = seeded_place(seed, "qid")
    draws = (short.withColumn("_n", size)
             .select("qid", "_have", "_n", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(n) + F.col("_pos"), F.col("_n")))).alias("_draw"))
             .withColumn("_at", (start + F.col("_draw")) % F.col("_n") + 1))
    known = stack(positives.select("qid", "docid"), negatives.select("qid", "docid")).distinct()
    fresh = draws.join(order, "_at").join(known, ["qid", "docid"], "left_anti")
    w = W.partitionBy("qid").orderBy("_draw")
    extra = fresh.withColumn("pos", (F.row_number().over(w) + F.col("_have")).cast("int")).filter(F.col("pos") <= n)
    return stack(negatives.select("qid", "docid", "pos"), extra.select("qid", "docid", "pos"))


def shuffled(items: Column, key: Column, seed: int = 42) -> Column:
    """Array in seeded order; equal items at different places are kept apart."""
    rows = F.transform(items, lambda x, i: F.struct(seeded(seed, key.cast("string"), i.cast("string")).alias("h"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(rows), lambda r: r["x"])


def repeat_to(items: Column, n: int) -> Column:
    """Repeat the whole array until it holds at least ``n`` items."""
    times = F.when(F.size(items) > 0, F.ceil(F.lit(n) / F.greatest(F.size(items), F.lit(1)))).otherwise(F.lit(0)).cast("int")
    return F.when(F.size(items) >= n, items).otherwise(F.flatten(F.array_repeat(items, times)))


def train_group(pos: Column, neg: Column, key: Column, size: int, seed: int = 42) -> Column:
    """One seeded positive followed by ``size - 1`` seeded negatives, repeated when short."""
    one = F.slice(shuffled(pos, key, seed), 1, 1)
    return F.concat(one, F.slice(shuffled(repeat_to(neg, size - 1), key, seed), 1, size - 1))


def teacher_filter(df: DataFrame, scores: str = "teacher_scores", minimum: float | None = None, margin: float | None = None) -> DataFrame:
    """Drop rows whose best score is too low or whose scores are too close. The number of
    scores must equal the number of positives and negatives."""
    matching = F.size(scores) == F.size("pos") + F.size("neg")
    df = df.filter(F.when(F.col(scores).isNotNull() & ~matching, F.raise_error(F.lit("teacher scores do not match pos and neg")).cast("boolean")).otherwise(F.lit(True)))
    s = F.col(scores)
    if minimum is not None:
        df = df.filter(s.isNull() | (F.array_max(s) >= minimum))
    if margin is not None:
        df = df.filter(s.isNull() | (F.array_max(s) - F.array_min(s) >= margin))
    return df


def choose_positive(df: DataFrame, how: str = "first", key: str = "qid", seed: int = 42) -> DataFrame:
    """Adds ``positive`` and ``positive_score``; ``teacher`` may take a negative, which then
    leaves the negatives."""
    n = F.size("pos")
    every = F.concat("pos", "neg")
    s = F.col("teacher_scores")
    at_max = lambda a: (F.array_position(a, F.array_max(a)) - 1).cast("int")
    if how == "first":
        at = F.lit(0)
    elif how == "random":
        digest = F.conv(F.substring(seeded(seed, F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
        at = (digest % n).cast("int")
    elif how == "teacher":
        at = F.coalesce(at_max(s), F.lit(0))
    elif how == "teacher-pos":
        at = F.coalesce(at_max(F.slice(s, F.lit(1), n)), F.lit(0))
    else:
        raise ValueError(f"unknown choice {how!r}")
    out = df.withColumn("_at", at).withColumn("positive", F.get(every, F.col("_at"))).withColumn("positive_score", F.get(s, F.col("_at")))
    drop = lambda a, base: F.filter(a, lambda x, i: i + base != F.col("_at"))
    return (out.withColumn("neg_scores", drop(F.slice(s, n + 1, F.greatest(F.size(s) - n, F.lit(0))), n))
            .withColumn("neg", drop(F.col("neg"), n)).drop("_at"))


def choose_negatives(df: DataFrame, n: int, how: str = "random", key: str = "qid", seed: int = 42) -> DataFrame:
    """``n`` negatives with scores; rows without negatives are dropped."""
    rows = F.arrays_zip(repeat_to(F.col("neg"), n).alias("x"), repeat_to(F.coalesce("neg_scores", F.array().cast("array<double>")), n).alias("s"))
    if how == "random":
        ordered = shuffled(rows, F.col(key), seed)
    elif how == "first":
        ordered = rows
    elif how in ("teacher+", "teacher-"):
        sign = -1.0 if how == "teacher+" else 1.0
        keyed = F.transform(rows, lambda r, i: F.struct((r["s"] * sign).alias("k"), i.alias("i"), r.alias("r")))
        ordered = F.transform(F.array_sort(keyed), lambda x: x["r"])
    else:
        raise ValueError(f"unknown choice {how!r}")
    out = df.filter(F.size("neg") > 0).withColumn("_n", F.slice(ordered, 1, n))
    return out.withColumn("neg", F.transform("_n", lambda r: r["x"])).withColumn("neg_scores", F.transform("_n", lambda r: r["s"])).drop("_n")


def stable_distill(neg: Column, scores: Column) -> Column:
    """``array<struct<x, s>>`` of the negatives by teacher score descending, ties in place."""
    rows = F.transform(F.arrays_zip(neg.alias("x"), scores.alias("s")), lambda r, i: F.struct((-r["s"]).alias("k"), i.alias("i"), r.alias("r")))
    return F.transform(F.array_sort(rows), lambda x: x["r"])


def teacher_or_default(scores: Column, size: Column) -> Column:
    """Missing teacher scores become 100 for the positive and 0 for the rest."""
    default = F.concat(F.array(F.lit(100.0)), F.array_repeat(F.lit(0.0), (size - 1).cast("int")))
    return F.coalesce(scores, default)


def history_negatives(history: Column, neg: Column) -> Column:
    return F.coalesce(history, neg)


def rerank_candidates(df: DataFrame) -> DataFrame:
    """``key`` as given, else positives then negatives; ``key_index`` defaults to positions."""
    key = F.coalesce("key", F.concat("pos", "neg"))
    given = F.coalesce("key_index", F.when(F.col("key").isNull(), F.concat("pos_index", "neg_index")))
    return df.withColumn("_k", key).withColumn(
        "key_index", F.coalesce(given, F.transform("_k", lambda x, i: i.cast("long")))).withColumn("key", F.col("_k")).drop("_k")


def row_length(tokenizer="whitespace") -> Column:
    """Largest token count over query, positives and negatives."""
    every = F.concat(F.array("query"), "pos", "neg")
    return F.array_max(F.transform(every, lambda x: F.size(tokens(x, tokenizer))))


def length_bucket(length: Column, borders=LENGTH_BORDERS) -> Column:
    """Half-open ranges, named ``low-high``; the last one is open."""
    edges = sorted(borders)
    out = F.lit(None).cast("string")
    for low, high in zip(edges, [*edges[1:], None]):
        inside = (length >= low) if high is None else (length >= low) & (length < high)
        out = F.when(inside, F.lit(f"{low}-{high if high is not None else 'inf'}")).otherwise(out)
    return out


def write_buckets(df: DataFrame, path: str, by: str = "bucket") -> None:
    """One folder of JSON lines per length bucket."""
    df.write.mode("overwrite").partitionBy(by).json(path)


def bucket_report(df: DataFrame, by: str = "bucket", length: str = "length") -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(length), 6).alias("avg_length"))


def bucket_batch_size(bucket: Column, group_size: int, default: int) -> Column:
    sizes = BATCH_SIZES.get(group_size)
    if sizes is None:
        return F.lit(default)
    edges = [*LENGTH_BORDERS, None]
    names = [f"{a}-{b if b is not None else 'inf'}" for a, b in zip(edges, edges[1:])]
    pairs = F.create_map(*[F.lit(x) for kv in zip(names, sizes) for x in kv])
    return F.coalesce(F.element_at(pairs, bucket), F.lit(default))


def merge_small_sources(df: DataFrame, source: str, small: int, drop: int, merged: str = "small") -> DataFrame:
    """Sources below ``small`` rows become one; it is dropped when still below ``drop``. Rows
    without a source are a source of their own."""
    counts = df.groupBy(source).agg(F.count(F.lit(1)).alias("_n"))
    is_small = F.col("_n") < small
    total = counts.agg(F.coalesce(F.sum(F.when(is_small, F.col("_n"))), F.lit(0))).scalar()
    names = counts.select(source, F.when(is_small, F.lit(merged)).otherwise(F.col(source)).alias("_to"), is_small.alias("_small"))
    names = names.withColumn("_total", total).filter(~F.col("_small") | (F.col("_total") >= drop))
    names = names.select(F.col(source).alias("_from"), "_to")
    return df.join(names, F.col(source).eqNullSafe(F.col("_from"))).withColumn(source, F.col("_to")).drop("_from", "_to")


def batches(df: DataFrame, by: str, key: str, size, seed: int = 42, keep_tail: int | None = None) -> DataFrame:
    """Seeded batches of one source each. A short last batch is dropped, or kept when it has
    at least ``keep_tail`` rows. ``batch_order`` shuffles the batches among sources."""
    size = size if isinstance(size, Column) else F.lit(size)
    ranked = hash_rank(df.withColumn("_h", seeded(seed, key)), [by], "_h", [key], "_pos").withColumn("_b", size)
    total = df.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("_n"))
    rows = ranked.join(total, F.col(by).eqNullSafe(F.col("_by"))).withColumn("batch", F.floor((F.col("_pos") - 1) / F.col("_b")))
    tail = F.least(F.col("_n") - F.col("batch") * F.col("_b"), F.col("_b"))
    rows = rows.filter(tail >= (F.col("_b") if keep_tail is None else F.least(F.lit(keep_tail), F.col("_b"))))
    return rows.withColumn("batch_order", seeded(seed, F.col(by).cast("string"), F.col("batch").cast("string"))).drop("_h", "_pos", "_b", "_by", "_n")


def stride_count(length: Column, window: int, stride: int) -> Column:
    return (F.ceil((length - window) / F.lit(stride)) + 1).cast("int")


def stride_batches(df: DataFrame, length: str, key: str, window: int, stride: int, size: int, mode: str = "strict", seed: int = 42, sort: str | None = None) -> DataFrame:
    """Batches of rows with the same number of strides. ``relaxed`` lets a batch run over
    into the next stride count, so only the very last batch can be short.

    ``batch_order`` orders the batches: shuffled, or with ``sort`` by their (largest) number
    of strides, ``ascend`` or ``descend``.
    """
    if mode not in ("strict", "relaxed"):
        raise ValueError(f"unknown mode {mode!r}")
    if sort not in (None, "ascend", "descend"):
        raise ValueError(f"unknown sort {sort!r}")
    rows = df.withColumn("strides", stride_count(F.col(length), window, stride))
    if mode == "strict":
        out, most = batches(rows, "strides", key, size, seed).drop("batch_order"), F.col("strides")
        name = F.concat_ws("|", "strides", "batch")
    else:
        ranked = hash_rank(rows.withColumn("_h", seeded(seed, key)), ["strides"], "_h", [key], "_pos")
        counts = rows.groupBy(F.col("strides").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
        # one row per stride count, bounded by the longest text
        before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        out = (ranked.join(before, F.col("strides") == F.col("_s"))
               .withColumn("batch", F.floor((F.col("_before") + F.col("_pos") - 1) / F.lit(size))).drop("_h", "_pos", "_s", "_n", "_before"))
        most, name = F.max("strides").over(W.partitionBy("batch")), F.col("batch").cast("string")
    if sort is None:
        return out.withColumn("batch_order", seeded(seed, name))
    place = most if sort == "ascend" else F.lit(2**31) - most
    return out.withColumn("batch_order", F.concat_ws("|", F.lpad(place.cast("string"), 10, "0"), F.lpad(F.col("batch").cast("string"), 19, "0")))


def shuffle_text(text: Column, key: Column, ratio: float, seed: int = 42) -> Column:
    """Reorder the three thirds of a text longer than 100 characters, for a seeded share of rows."""
    draw = F.conv(F.substring(seeded(seed, F.lit("draw"), key.cast("string")), 1, 8), 16, 10).cast("double") / 4294967296.0
    size = (F.floor(F.length(text) / 3) + 1).cast("int")
    pieces = F.filter(F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: F.substring(text, i * size + 1, size)), lambda p: p != "")
    return F.when((F.length(text) > 100) & (draw < ratio), F.array_join(shuffled(pieces, key, seed), " ")).otherwise(text)


def collate_keys(queries: DataFrame, run: DataFrame, corpus: DataFrame) -> DataFrame:
    """``key`` texts and ``key_index`` per query in rank order; empty without hits."""
    rows = run.join(corpus.select("docid", "text"), "docid")
    lists = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "docid", "text"))).alias("_h"))
    empty = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>"))
    return queries.join(lists, "qid", "left").withColumns({
        "key": empty(F.col("_h.text"), "string"), "key_index": empty(F.col("_h.docid"), "bigint")}).drop("_h")


def collate_negatives(queries: DataFrame, run: DataFrame, corpus: DataFrame, positives: DataFrame, max_neg: int, drop_answers: bool = False) -> DataFrame:
    """First ``max_neg`` hits per query that are not a positive or a copy of one.

    ``positives`` is ``(qid, docid)``; hits with the text of a positive go by text digest,
    so long texts are not shuffled for the comparison. With ``drop_answers`` hits that
    contain one of the query's ``answers`` go as well. Queries without hits get no row.
    """
    texts = corpus.select("docid", "text", F.md5("text").alias("_d"))
    same = positives.join(texts.select("docid", "_d"), "docid").select("qid", "_d").distinct()
    hits = run.select("qid", "docid", "rank").join(texts, "docid")
    keep = hits.join(positives.select("qid", "docid").distinct(), ["qid", "docid"], "left_anti").join(same, ["qid", "_d"], "left_anti")
    if drop_answers:
        keep = keep.join(queries.select("qid", "answers"), "qid").filter(
            ~F.exists("answers", lambda a: F.contains(F.lower("text"), F.lower(a)))).drop("answers")
    picked = top_rows(keep.drop("_d").withColumnRenamed("rank", "hit_rank"), ["qid"], [F.col("hit_rank")], max_neg, "pos")
    return picked.select("qid", "docid", "text", "pos")


def collate_scores(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores in the order of each query's ``key_index``; a missing score is an error."""
    wanted = candidates.select("qid", F.posexplode("key_index").alias("pos", "docid"))
    rows = wanted.join(scores.select("qid", "docid", "score"), ["qid", "docid"], "left").withColumn(
        "score", F.coalesce("score", F.raise_error(F.lit("candidate without score")).cast("double")))
    lists = rows.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "score"))), lambda x: x["score"]).alias("teacher_scores"))
    return candidates.join(lists, "qid", "left")


def collate_losses(samples: DataFrame, losses: DataFrame) -> DataFrame:
    """``teacher_scores`` of each sample: the negated losses ``(qid, place, loss)`` of its candidates in order.

    The candidates are the ``history`` of a sample if it has one, otherwise ``pos`` and ``neg``; another number of losses
    is an error.
    """
    lists = losses.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "loss"))), lambda x: -x["loss"]).alias("teacher_scores"))
    size = lambda name: F.coalesce(F.size(name), F.lit(0)) if name in samples.columns else F.lit(0)
    wanted = size("pos") + size("neg")
    if "history" in samples.columns:
        wanted = F.when(F.col("history").isNotNull(), F.size("history")).otherwise(wanted)
    rows = samples.join(lists, "qid", "left").withColumn("teacher_scores", F.coalesce("teacher_scores", F.array().cast("array<double>")))
    wrong = F.raise_error(F.concat(F.lit("sample "), F.col("qid").cast("string"), F.lit(": number of losses and candidates differ"))).cast("array<double>")
    return rows.withColumn("teacher_scores", F.when(F.size("teacher_scores") == wanted, F.col("teacher_scores")).otherwise(wrong))
