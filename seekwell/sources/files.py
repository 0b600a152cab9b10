"""Readers and writers for corpora, topics, runs, labels, vectors and metric logs."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from seekwell.scale import hash_rank, running_total, seeded, stack, top_rows
from seekwell.sources.json_arrays import read_json_array

# Accepted names of the document id, best first.
ID_NAMES = ("docid", "id", "_id")
# Languages of the two multilingual evaluation sets.
OPEN_QA_LANGUAGES = ("en", "ar", "fi", "ja", "ko", "ru", "es", "sv", "he", "th", "da", "de", "fr", "it", "nl", "pl", "pt", "hu", "vi", "ms", "km", "no", "tr", "zh_cn", "zh_hk", "zh_tw")
LONG_DOC_LANGUAGES = ("ar", "de", "en", "es", "fr", "hi", "it", "ja", "ko", "pt", "ru", "th", "zh")
# Three intents of the router.
INTENTS = {0: "chat", 1: "consult", 2: "human"}

TRIPLE = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("pos", T.ArrayType(T.StringType())),
    T.StructField("neg", T.ArrayType(T.StringType())),
])
SCORED_TRIPLE = T.StructType(TRIPLE.fields + [
    T.StructField("pos_scores", T.ArrayType(T.DoubleType())),
    T.StructField("neg_scores", T.ArrayType(T.DoubleType())),
])


def _present(df: DataFrame, names) -> list[str]:
    return [n for n in names if n in df.columns]


def read_corpus(spark: SparkSession, path, fmt: str = "jsonl") -> DataFrame:
    """``(docid, text, title)`` from a JSON array, JSON lines or tab-separated text.

    The id is the first present of ``docid``, ``id``, ``_id``; a row without any is an error.
    One large JSON array is read by many tasks.
    """
    if fmt == "tsv":
        f = F.split("value", "\t")
        return spark.read.text(path).select(F.get(f, 0).alias("docid"), F.get(f, 1).alias("text"), F.get(f, 2).alias("title"))
    if fmt not in ("json", "jsonl"):
        raise ValueError(f"unknown corpus format {fmt!r}")
    # ids are read as text so that 1 and "1" are the same document
    fields = [*ID_NAMES, "contents", "text", "title"]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in fields])
    df = read_json_array(spark, path, schema) if fmt == "json" else spark.read.schema(schema).json(path)
    docid = F.coalesce(*[F.col(n) for n in ID_NAMES])
    missing = F.raise_error(F.lit("corpus row without docid, id or _id")).cast("string")
    return df.select(F.coalesce(docid, missing).alias("docid"), F.coalesce("contents", "text").alias("text"), "title")


def read_topics(spark: SparkSession, path) -> DataFrame:
    f = F.split("value", "\t", 2)
    return spark.read.text(path).select(F.get(f, 0).alias("qid"), F.get(f, 1).alias("query"))


def write_topics(df: DataFrame, path: str) -> None:
    """``qid<TAB>query`` lines; line breaks and tabs inside the query become spaces."""
    line = F.concat_ws("\t", F.col("qid").cast("string"), F.translate("query", "\n\t", "  "))
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def qa_pairs(df: DataFrame, value: str = "value") -> DataFrame:
    """Nested ``[[question, answer], ...]`` JSON text to rows with their position."""
    pairs = F.from_json(value, "array<array<string>>")
    rows = df.select(*[c for c in df.columns if c != value], F.posexplode(pairs).alias("pos", "_p"))
    return rows.withColumns({"question": F.get("_p", 0), "answer": F.get("_p", 1)}).drop("_p")


def qa_dict(pairs: DataFrame, order: Column | str = "pos") -> DataFrame:
    """One answer per question; the last duplicate wins."""
    key = F.col(order) if isinstance(order, str) else order
    return pairs.groupBy("question").agg(F.max_by("answer", key).alias("answer"))


def with_positional_id(df: DataFrame, order_by: str, out: str = "docid") -> DataFrame:
    """Zero-based position by a unique numeric column, by two-pass running count."""
    return running_total(df, [], order_by, F.lit(1), out).withColumn(out, F.col(out) - 1)


def write_corpus(df: DataFrame, path: str) -> None:
    df.select(F.col("docid").alias("id"), F.col("text").alias("contents")).write.mode("overwrite").json(path)


def read_labelled_lines(spark: SparkSession, files: dict[str, object]) -> DataFrame:
    """One trimmed sentence per line, each file with its label."""
    frames = [spark.read.text(p).select(F.trim("value").alias("sentence"), F.lit(label).alias("label")) for p, label in files.items()]
    return stack(*frames)


def read_run(spark: SparkSession, path, top: int | None = None) -> DataFrame:
    """Six-column run lines ``qid Q0 docid rank score tag``, up to rank ``top``."""
    f = F.split("value", " ")
    run = spark.read.text(path).select(
        F.get(f, 0).alias("qid"), F.get(f, 2).alias("docid"), F.get(f, 3).cast("int").alias("rank"),
        F.get(f, 4).cast("double").alias("score"))
    return run.filter(F.col("rank") <= top) if top else run


def run_lines(run: DataFrame, tag: str) -> DataFrame:
    line = F.concat_ws(" ", F.col("qid").cast("string"), F.lit("Q0"), F.col("docid").cast("string"),
                       F.col("rank").cast("string"), F.format_string("%.6f", F.col("score").cast("double")), F.lit(tag))
    return run.select("qid", "rank", line.alias("value"))


def write_run(run: DataFrame, path: str, tag: str = "seekwell") -> None:
    """Run lines ordered by query and rank; files are ranges of queries."""
    lines = run_lines(run, tag).repartitionByRange("qid", "rank").sortWithinPartitions("qid", "rank")
    lines.select("value").write.mode("overwrite").text(path)


def read_msmarco_run(spark: SparkSession, path) -> DataFrame:
    """``qid<TAB>docid<TAB>rank`` lines, long form."""
    f = F.split("value", "\t")
    return spark.read.text(path).select(F.get(f, 0).alias("qid"), F.get(f, 1).alias("docid"), F.get(f, 2).cast("int").alias("rank"))


def hit_lists(run: DataFrame) -> DataFrame:
    """One row per query with id and score arrays in rank order; as long as the run is deep."""
    hits = F.array_sort(F.collect_list(F.struct("rank", "docid", "score")))
    return run.groupBy("qid").agg(hits.alias("h")).select(
        F.col("qid").alias("query_id"), F.col("h.docid").alias("pred"), F.col("h.score").alias("score"))


def write_hits(run: DataFrame, path: str) -> None:
    hit_lists(run).write.mode("overwrite").json(path)


def read_hits(spark: SparkSession, path) -> DataFrame:
    df = spark.read.schema("query_id string, pred array<string>, score array<double>").json(path)
    return df.select(F.col("query_id").alias("qid"), F.posexplode(F.arrays_zip("pred", "score")).alias("pos", "h")).select(
        "qid", F.col("h.pred").alias("docid"), (F.col("pos") + 1).alias("rank"), F.col("h.score").alias("score"))


def qrels_from_table(df: DataFrame, qid: str, docid: str, grade: str) -> DataFrame:
    return df.select(F.col(qid).alias("qid"), F.col(docid).alias("docid"), F.col(grade).cast("int").alias("grade"))


def qrels_from_pos_index(df: DataFrame, order_by: str) -> DataFrame:
    """``pos_index`` arrays; a missing ``query_id`` becomes the row position."""
    numbered = with_positional_id(df, order_by, "_line")
    return numbered.select(F.coalesce(F.col("query_id").cast("long"), F.col("_line")).alias("qid"), F.explode("pos_index").alias("docid"), F.lit(1).alias("grade"))


def qrels_from_positives(df: DataFrame, first_only: bool = False) -> DataFrame:
    """``{qid, pos: [{docid}]}`` records."""
    pos = F.slice("pos", 1, 1) if first_only else F.col("pos")
    return df.select("qid", F.explode(pos).alias("p")).select("qid", F.col("p.docid").alias("docid"), F.lit(1).alias("grade"))


def read_triples(spark: SparkSession, path, with_scores: bool = False) -> DataFrame:
    """Training triples with a fixed schema; score columns only when asked for."""
    return spark.read.schema(SCORED_TRIPLE if with_scores else TRIPLE).json(path)


def write_sharded(df: DataFrame, path: str, max_rows: int = 1_000_000) -> None:
    """JSON files of at most ``max_rows`` rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", max_rows).json(path)


def read_many(spark: SparkSession, glob, schema) -> DataFrame:
    """All JSON files below a glob with the file each row came from."""
    return spark.read.schema(schema).json(glob).withColumn("source", F.input_file_name())


def parse_capped_path(path: str) -> tuple[str, int | None]:
    """``file[N]`` to ``(file, N)``."""
    m = re.fullmatch(r"(.+)\[(\d+)\]", path)
    return (m.group(1), int(m.group(2))) if m else (path, None)


def cap_rows(df: DataFrame, by: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` seeded random rows per source."""
    return top_rows(df.withColumn("_h", seeded(seed, key)), [by], [F.col("_h"), F.col(key)], n).drop("_h", "rank")


def write_sparse(vectors: DataFrame, path: str) -> None:
    """``{id, contents: "", vector}`` lines."""
    vectors.select("id", F.lit("").alias("contents"), "vector").write.mode("overwrite").json(path)


def read_sparse(spark: SparkSession, path) -> DataFrame:
    df = spark.read.schema("id string, contents string, vector map<string,int>").json(path)
    return df.select("id", F.explode("vector").alias("token", "w"))


def write_embeddings(df: DataFrame, path: str) -> None:
    df.select("id", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(path)


def read_embeddings(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema("id long, embedding array<float>").parquet(path)


def append_metrics(metrics: DataFrame, path: str, command: str, args: dict | None = None) -> None:
    """Append metric rows with time, command and arguments."""
    import json

    metrics.select(F.current_timestamp().alias("time"), F.lit(command).alias("command"),
                   F.lit(json.dumps(args or {}, sort_keys=True)).alias("args"), F.to_json(F.struct("*")).alias("metrics")
                   ).write.mode("append").json(path)


def file_times(spark: SparkSession, paths) -> DataFrame:
    """Path and modification time of the files, without reading their content."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("modificationTime").alias("modified"))


def changed_files(spark: SparkSession, paths, manifest: str) -> DataFrame:
    """New or modified files against the saved manifest; all of them on the first run."""
    now = file_times(spark, paths)
    try:
        old = spark.read.parquet(manifest).select("path", F.col("modified").alias("_old"))
    except AnalysisException:
        return now
    return now.join(old, "path", "left").filter(F.col("_old").isNull() | (F.col("_old") != F.col("modified"))).drop("_old")


def save_manifest(spark: SparkSession, paths, manifest: str) -> None:
    """Each save replaces the manifest as a whole."""
    file_times(spark, paths).write.mode("overwrite").parquet(manifest)


def check_languages(languages, known) -> list[str]:
    wanted = [languages] if isinstance(languages, str) else list(languages)
    unknown = sorted(set(wanted) - set(known))
    if unknown:
        raise ValueError(f"unsupported languages {unknown}; known: {list(known)}")
    return wanted


def split_by_ratio(df: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """Seeded shuffle; the first ``floor(n * ratio)`` rows are ``test``, the rest ``train``."""
    ranked = hash_rank(df.withColumn("_h", seeded(seed, key)), [], "_h", [key], "_pos")
    cut = F.floor(df.agg(F.count(F.lit(1))).scalar() * F.lit(ratio))
    return ranked.withColumn("split", F.when(F.col("_pos") <= cut, "test").otherwise("train")).drop("_h", "_pos")


def label_ids(df: DataFrame, mapping: dict[int, str], label: str = "label") -> DataFrame:
    """Label names to ids, through a fixed literal map."""
    pairs = F.create_map(*[x for i, name in mapping.items() for x in (F.lit(name), F.lit(i))])
    return df.withColumn("label_id", F.element_at(pairs, F.col(label)))


def label_names(df: DataFrame, mapping: dict[int, str], label: str = "label_id") -> DataFrame:
    pairs = F.create_map(*[x for i, name in mapping.items() for x in (F.lit(i), F.lit(name))])
    return df.withColumn("label", F.element_at(pairs, F.col(label)))
