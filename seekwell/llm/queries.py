"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seekwell.llm import collocations, decontamination, katz, packing_genetic, quality_classifier, quality_rules, quotation, ranked_search, secrets, simhash, substring_dedup, suffix_dedup, toxicity


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing_genetic.packed_pieces(table(spark, folder, "documents"))


def op2_quotation_linking(spark: SparkSession, folder: str) -> DataFrame:
    return quotation.threads(table(spark, folder, "conversations"))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("hit_words", "items")


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", simhash.hex_fingerprint(groups["fp"]).alias("fingerprint"), "component_id")


def op5_katz_backoff(spark: SparkSession, folder: str) -> DataFrame:
    return katz.score(table(spark, folder, "documents"))


def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality_classifier.classify(docs, quality_classifier.train(docs, table(spark, folder, "labels")))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, folder, "documents"))


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.deduplicated(table(spark, folder, "documents"))


def op9_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, folder, "documents")))


def op10_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, folder, "documents"))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.classify(docs, toxicity.train(docs, table(spark, folder, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_quotation_linking": op2_quotation_linking,
    "op3_decontamination": op3_decontamination,
    "op4_simhash": op4_simhash,
    "op5_katz_backoff": op5_katz_backoff,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_quality_rules": op7_quality_rules,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_secret_scans": op9_secret_scans,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_collocations": op11_collocations,
    "op12_ranked_search": op12_ranked_search,
    "op13_toxicity": op13_toxicity,
}
SQL: dict[str, str] = {
    "op2_quotation_linking": quotation.sql(),
    "op3_decontamination": decontamination.sql(),
    "op7_quality_rules": quality_rules.sql(),
    "op8_substring_dedup": substring_dedup.sql(),
    "op11_collocations": collocations.sql(),
    "op12_ranked_search": ranked_search.sql(),
}
