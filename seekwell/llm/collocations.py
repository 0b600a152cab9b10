"""Collocations by set-oriented relational mining (SETM).

A relation holds the occurrences of frequent phrases of one length as rows (piece, pos, id), sorted and persisted as a
table bucketed by piece. The relation of the next length is a merge join of the table with itself on the same piece and
the next position, which needs no shuffle as both sides are the same buckets: two phrases that overlap in all but their
outer words make a longer one. Its groups are counted, groups below the least count are dropped, and a semi join with the
frequent groups leaves the rows that are persisted before the next length. All that follows (cuts, scores, longer
candidates) works on the tables of frequent groups, not on occurrences.

Scale: texts cross the network once, as pieces; positions never do. Counts are summed inside each task before their
shuffle. Frequent groups are broadcast below a measured size and joined by key beyond, where adaptive execution splits
hot keys; the rows then go back to their buckets. Numbers of groups are dense, given by partition offsets. A relation is
dropped as soon as the next one is written; all of them lie in the warehouse, so a lost executor repeats only its tasks.

Defined results: a null text has no words; a null lang counts as ``und``; words are told apart as they are after A-Z is
lower-cased; repeated rows count again; ties are ordered as the contract says; an empty table gives an empty result;
other columns are ignored, doc_id too.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seekwell.llm.common import BROADCAST_BYTES, LOWER, UPPER, ascii_lower, cut, sized_broadcast
from seekwell.scale import top_rows

LEAST, LONGEST, TOP = 30, 4, 2000
SCALE, SHARE = 2_000_000, 80
# Fixed patterns: ends of pieces, blanks between words, and both.
ENDS, BLANKS, ANY = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+", r"[.,;:!?\x0A-\x0D\x20\x09]+"
# Numbers of groups stay below this, so that two of them fit one signed long.
MOST_GROUPS = 2**31
ROWS_PER_BUCKET = 4_000_000


@contextmanager
def co_partitioned(spark: SparkSession):
    """Inside, joins on (piece, pos) accept tables that are bucketed by piece alone, and read their buckets as sorted."""
    wanted = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


class Relations:
    """Bucketed tables of occurrences, dropped when they are no longer needed."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets = spark, buckets

    def write(self, rows: DataFrame, placed: bool) -> str:
        """``rows`` (piece, pos, id) as a new table, sorted inside its buckets. ``placed``: each task holds whole buckets already."""
        name = f"occurrences_{uuid.uuid4().hex}"
        rows = rows if placed else rows.repartition(self.buckets, "piece")
        rows.write.format("parquet").bucketBy(self.buckets, "piece").sortBy("piece", "pos").saveAsTable(name)
        return name

    def joined(self, name: str) -> DataFrame:
        """(piece, pos, key): every occurrence with the one at the next position of its piece."""
        a, b = self.spark.table(name).alias("a"), self.spark.table(name).alias("b")
        both = a.hint("merge").join(b.hint("merge"), (F.col("a.piece") == F.col("b.piece")) & (F.col("a.pos") == F.col("b.pos") - 1))
        return both.select("a.piece", "a.pos", (F.shiftleft("a.id", 32) + F.col("b.id")).alias("key"))

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def numbered(groups: DataFrame) -> DataFrame:
    """``groups``, written once, with dense numbers ``id`` from 0: place inside the partition plus the partition's offset."""
    held = cut(groups.withColumn("_at", F.monotonically_increasing_id()), "groups")
    part = F.shiftright("_at", 33)
    sizes = sorted((r["part"], r["count"]) for r in held.groupBy(part.alias("part")).count().collect())  # one row per partition
    offsets, total = [], 0
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    if total >= MOST_GROUPS:
        raise ValueError("too many frequent groups for 31-bit numbers; raise the least count")
    start = F.broadcast(held.sparkSession.createDataFrame(offsets, "_part long, _offset long"))
    return held.withColumn("_part", part).join(start, "_part").withColumn("id", F.col("_offset") + F.col("_at").bitwiseAND(2**33 - 1)).drop("_at", "_part", "_offset")


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), ascii_lower(F.coalesce("text", F.lit(""))).alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f) over all words."""
    words = texts(docs).select("lang", F.explode(F.split("text", ANY)).alias("word")).filter("word <> ''")
    return words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("f"))


def pieces(docs: DataFrame) -> DataFrame:
    """(piece, lang, text): pieces of two words or more, numbered where they were read."""
    rows = texts(docs).select("lang", F.explode(F.split("text", ENDS)).alias("text"))
    return rows.filter(F.col("text").rlike(r"[^\x20\x09][\x20\x09]+[^\x20\x09]")).withColumn("piece", F.monotonically_increasing_id())


def _buckets(spark: SparkSession, n_words: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_words // ROWS_PER_BUCKET))


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, limit: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all phrases with up to ``longest`` words and at least ``least`` occurrences, and (lang, n)."""
    spark = docs.sparkSession
    counts = cut(word_counts(docs), "words")
    n = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    words = numbered(counts.filter(F.col("f") >= least))
    total = counts.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    keep = Relations(spark, _buckets(spark, total))
    near, told = _side(words.select("lang", "word", "id"), F.octet_length("lang") + F.octet_length("word") + 24, limit)
    # pieces are placed first and cut into positions there; only a list of words too large to broadcast moves rows again
    placed = pieces(docs).repartition(keep.buckets, "piece")
    rows = placed.select("piece", "lang", F.posexplode(F.array_remove(F.split("text", BLANKS), "")).alias("pos", "word"))
    table = keep.write(rows.join(told, ["lang", "word"]).select("piece", "pos", "id"), near) if longest > 1 else None
    known = words.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "f", "id", F.col("word").alias("last"))
    levels = [known]
    for size in range(2, longest + 1):
        with co_partitioned(spark):
            raw = keep.joined(table)
            group = numbered(raw.groupBy("key").agg(F.count(F.lit(1)).alias("f")).filter(F.col("f") >= least))
            if size < longest:
                near, told = _side(group.select("key", "id"), F.lit(32), limit)
                now = keep.write(raw.join(told, "key").select("piece", "pos", "id"), near)
            else:
                now = None
        keep.drop(table)
        head = levels[-1].select(F.col("id").alias("_head"), "lang", F.col("phrase").alias("_phrase"))
        tail = levels[-1].select(F.col("id").alias("_tail"), "last")
        pairs = group.withColumns({"_head": F.shiftright("key", 32), "_tail": F.col("key").bitwiseAND(2**32 - 1)})
        named = pairs.join(head, "_head").join(tail, "_tail")
        levels.append(cut(named.select("lang", F.concat_ws(" ", "_phrase", "last").alias("phrase"), F.lit(size).alias("size"), "f", "id", "last"), "phrases"))
        table = now
    return reduce(DataFrame.unionByName, [x.select("lang", "phrase", "size", "f") for x in levels]), n


def _side(groups: DataFrame, row_bytes: Column, limit: int) -> tuple[bool, DataFrame]:
    """Whether the frequent groups are small enough to reach every task, and their side of the semi join (each key stands once in it)."""
    side = sized_broadcast(groups, row_bytes, limit)
    return side is not groups, side


def part(words: Column, first, n) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def scored(phrases: DataFrame, share: int = SHARE) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that no longer candidate covers."""
    candidates = phrases.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("_words"))
    known = phrases.select("lang", "phrase", "f")
    # a longer candidate tells each phrase inside it how often it occurs itself
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda at: part(F.col("_words"), at, n))))
    longer = candidates.filter("size > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    left = candidates.join(longer, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("_longer") < share * F.col("a"), F.lit(True)))
    cuts = left.select("lang", "phrase", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(
        k.alias("k"), part(F.col("_words"), F.lit(1), k).alias("head"), part(F.col("_words"), k + 1, F.col("size")).alias("tail")))).alias("_c")).select("lang", "phrase", "a", "_c.*")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(
        known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    score = F.expr(f"(CAST({SCALE} AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(20, 0))) DIV (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    least = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    return cuts.groupBy("lang", "phrase", "a").agg(least.alias("_c")).select("lang", "phrase", "a", "_c.l", "_c.r", "_c.score")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, longest: int = LONGEST, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The first ``top`` candidates of each lang: lang, rank, phrase, a, l, r, n, score."""
    phrases, n = frequent_phrases(docs, least, longest, limit)
    ranked = top_rows(scored(phrases), ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()], top)
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def sql(top: int = TOP, least: int = LEAST) -> str:
    occurs = "\nUNION ALL\n".join(
        f"SELECT lang, list_aggregate(ws[i:i + {k - 1}], 'string_agg', ' ') AS phrase, {k} AS size FROM (SELECT lang, ws, unnest(range(1, len(ws) - {k - 2})) AS i FROM cut WHERE len(ws) >= {k})"
        for k in range(1, LONGEST + 1))
    return f"""
WITH split AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
cut AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM split),
found AS ({occurs}),
known AS (SELECT lang, phrase, size, count(*) AS f FROM found GROUP BY lang, phrase, size HAVING count(*) >= {least}),
total AS (SELECT lang, count(*) AS n FROM found WHERE size = 1 GROUP BY lang),
cand AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS ws FROM known WHERE size > 1),
inner_phrases AS (SELECT lang, a, list_aggregate(ws[i:i + m - 1], 'string_agg', ' ') AS phrase FROM
  (SELECT lang, a, ws, size, m, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM cand))),
covered AS (SELECT lang, phrase, max(a) AS longer FROM inner_phrases GROUP BY lang, phrase),
left_over AS (SELECT c.* FROM cand c LEFT JOIN covered v ON c.lang = v.lang AND c.phrase = v.phrase WHERE v.longer IS NULL OR 100 * v.longer < {SHARE} * c.a),
cuts AS (SELECT lang, phrase, a, k, list_aggregate(ws[1:k], 'string_agg', ' ') AS head, list_aggregate(ws[k + 1:], 'string_agg', ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM left_over)),
valued AS (SELECT c.lang, c.phrase, c.a, c.k, h.f AS l, t.f AS r, ((({SCALE}::HUGEINT) * c.a) // (h.f + t.f))::BIGINT AS score
  FROM cuts c JOIN known h ON h.lang = c.lang AND h.phrase = c.head JOIN known t ON t.lang = c.lang AND t.phrase = c.tail),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM valued) WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT b.*, t.n, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best b JOIN total t USING (lang))
WHERE rank <= {top}"""
