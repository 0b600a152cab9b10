"""Quality rules: a threshold table compiled into one projection.

Every document is measured and judged in its own row with built-in functions only, so the plan is a scan and a
projection: no shuffle, no user function, nothing that depends on other documents.

Defined results: a null or empty text has no words and fails; null ids are carried along; repeated rows are judged
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seekwell.llm.common import SPACES, clean_input, plain_words

# Common function words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "with", "as", "be", "by", "at", "or", "from", "this", "an", "are",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "que", "qui", "pour", "dans", "pas", "en", "par", "au", "ce",
    "der", "die", "das", "und", "zu", "den", "von", "mit", "ist", "ein", "eine", "nicht", "auf", "für", "dem", "im", "sich", "des",
    "el", "los", "las", "y", "del", "se", "no", "una", "su", "con", "para", "lo", "al", "o",
)
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5

# (measure, unit it is divided by, "min" or "max", parts per 100, least number of words at which the rule holds)
THRESHOLDS = (
    ("n_symbols", "n_words", "max", 10, 10),
    ("n_stop_words", "n_words", "min", 3, 30),
    ("word_chars", "n_words", "max", 2000, 10),
    ("n_dup_lines", "n_lines", "max", 50, 10),
)


def repeated_words(words: Column) -> Column:
    """Words inside five-word windows that occur at least twice in ``words``.

    Distinct 64-bit window hashes prove that no window repeats; only otherwise are the windows themselves sorted and
    neighbours compared, so the count is exact."""
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    ordered = F.array_sort(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(words, i, WINDOW), " ").alias("w"), i.alias("at"))))

    def covered(s: Column) -> Column:
        same = lambda k, other: F.get(s, other)["w"].eqNullSafe(F.get(s, k)["w"])
        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.when(k > 0, same(k, k - 1)).otherwise(F.lit(False)) | same(k, k + 1))
        places = F.array_sort(F.transform(twice, lambda k: F.get(s, k)["at"]))
        gaps = lambda p: F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
                                     lambda acc, at: F.struct((acc["n"] + F.least(at - acc["last"], F.lit(WINDOW))).alias("n"), at.alias("last")),
                                     lambda acc: acc["n"])
        return F.transform(F.array(places), gaps)[0]

    exact = F.transform(F.array(ordered), covered)[0]
    unique = F.size(F.array_distinct(hashes)) == F.size(words) - (WINDOW - 1)
    return F.when(F.size(words) < WINDOW, F.lit(0)).when(unique, F.lit(0)).otherwise(exact)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts the thresholds refer to, all long."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = clean_input(docs).select("doc_id", text.alias("text"), plain_words(F.col("text")).alias("words"),
                                     F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    long = lambda c: c.cast("long")
    return split.select(
        "doc_id", long(F.size("words")).alias("n_words"), long(F.length(F.array_join("words", ""))).alias("word_chars"),
        long(F.regexp_count("text", F.lit(SYMBOLS))).alias("n_symbols"), long(F.size("lines")).alias("n_lines"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        long(F.size(F.filter("words", lambda w: w.isin(*STOP_WORDS)))).alias("n_stop_words"),
        long(repeated_words(F.col("words"))).alias("n_repeat_words"))


def quality_rules(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """One row per document: its measures, ``base_failed`` and ``kept``."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    failed = F.lit(False)
    for measure, unit, side, share, least in thresholds:
        value, bound = 100 * F.col(measure), share * F.col(unit)
        failed = failed | ((F.col("n_words") >= least) & ((value > bound) if side == "max" else (value < bound)))
    return measures(docs).withColumns({"base_failed": base, "kept": ~base & ~failed})


def sql() -> str:
    """The same result for DuckDB."""
    space = SPACES.replace(r"\x20", " ")
    word = space.replace("[", "[^", 1)
    rules = " OR ".join(f"(n_words >= {least} AND 100 * {m} {'>' if side == 'max' else '<'} {share} * {unit})" for m, unit, side, share, least in THRESHOLDS)
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return f"""
WITH t AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{word}') AS words,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{word}')) AS lines FROM t),
g AS (SELECT uid, i, list_aggregate(words[i:i+{WINDOW - 1}], 'string_agg', ' ') AS win
      FROM (SELECT uid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW})),
d AS (SELECT uid, i FROM (SELECT uid, i, count(*) OVER (PARTITION BY uid, win) AS n FROM g) WHERE n > 1),
r AS (SELECT uid, count(DISTINCT p) AS n FROM (SELECT uid, unnest(range(i, i + {WINDOW})) AS p FROM d) GROUP BY uid),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '{SYMBOLS}'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        len(list_filter(words, lambda x: x IN ({stops})))::BIGINT AS n_stop_words, coalesce(r.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN r USING (uid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND NOT ({rules}) AS kept FROM b"""
