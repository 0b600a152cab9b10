"""Chat formatting by quotation linking.

A line's quote level is the number of ``>`` in its prefix. Neighbouring lines of one level without a blank line
between are a passage; level 0 passages are a message's own words, the others quote something. Passages are normalised
(prefix off, white space and line breaks squeezed, lower case) and hashed with 256 bits, and so are their lines. The
original of a quoted passage is the earliest message of the conversation that has it as its own words. If no earlier
message has all of it, it is linked by its lines: each needs an earlier message with that own line, and the latest of the
lines' earliest messages is the original. A message replies to the latest original among its
linked quotes of the lowest level. Threads and depths follow by pointer doubling over reply links, and messages are
numbered inside their thread so that every message comes after the one it answers.

Built-in functions only. Own passages are reduced to one row per conversation and hash with partial sums before
the join, so a line that everybody writes or quotes never forms pairs; positions use two-pass sums, so that one huge
conversation is numbered by many tasks.

Defined results: a null or empty text has no passages; messages with a null conversation or turn are never linked and
start threads of their own; rows that share conversation and turn are one message (their quotes are taken together,
each keeps its text); a quote whose original is not earlier stays unlinked; ties of normalised text go to the earliest
message; a quote that is both trimmed and wrapped anew stays unlinked; an empty table gives an empty result; other
columns are ignored. ``sql`` has only whole passages with their line breaks, which is the same without such quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seekwell.llm.common import cut
from seekwell.scale import running_totals

PREFIX = r"^[ \t]*(?:>[ \t]*)*"


def parsed_lines(text: Column) -> Column:
    """Array of (level, raw, norm) for the lines of a text."""
    def line(x: Column) -> Column:
        prefix = F.regexp_extract(x, PREFIX, 0)
        body = F.substr(x, F.length(prefix) + 1)
        return F.struct(F.length(F.regexp_replace(prefix, "[^>]", "")).alias("level"), x.alias("raw"),
                        F.lower(F.trim(F.regexp_replace(body, r"[ \t\r]+", " "))).alias("norm"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), line)


def passages(lines: Column) -> Column:
    """Array of (level, hash, wrapped, lines) for the passages of parsed lines: hashes of the passage, of the passage with
    its line breaks and of its distinct lines."""
    n = F.size(lines)
    full = lambda i: F.get(lines, i)["norm"] != ""
    joined = lambda i, j: F.coalesce(full(i) & full(j) & (F.get(lines, i)["level"] == F.get(lines, j)["level"]), F.lit(False))
    every = F.sequence(F.lit(0), n - 1)
    starts = F.filter(every, lambda i: full(i) & ~F.when(i > 0, joined(i - 1, i)).otherwise(F.lit(False)))
    ends = F.filter(every, lambda i: full(i) & ~joined(i, i + 1))
    text = lambda a, b: F.transform(F.slice(lines, a + 1, b - a + 1), lambda x: x["norm"])
    hashed = lambda a, b, by: F.sha2(F.array_join(text(a, b), by), 256)
    return F.zip_with(starts, ends, lambda a, b: F.struct(
        F.get(lines, a)["level"].alias("level"), hashed(a, b, " ").alias("hash"), hashed(a, b, "\n").alias("wrapped"),
        F.array_distinct(F.transform(text(a, b), lambda x: F.sha2(x, 256))).alias("lines")))


def threads(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, own_text, n_quotes, n_linked, max_level, parent_turn, thread_turn, depth, position."""
    rows = messages.select("conv_id", "turn", "role", parsed_lines(F.col("text")).alias("_lines"))
    rows = rows.withColumn("_passages", passages(F.col("_lines")))
    quotes = F.filter("_passages", lambda p: p["level"] > 0)
    shown = rows.select("conv_id", "turn", "role", F.btrim(F.array_join(F.transform(F.filter("_lines", lambda x: x["level"] == 0), lambda x: x["raw"]), "\n"), F.lit(" \t\r\n")).alias("own_text"),
                        F.size(quotes).alias("n_quotes"), F.coalesce(F.array_max(F.transform("_lines", lambda x: x["level"])), F.lit(0)).alias("max_level"))
    each = rows.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", "turn", F.explode(F.array_distinct("_passages")).alias("p")).select("conv_id", "turn", "p.*")
    keys = F.explode(F.concat(F.array(F.struct(F.col("hash").alias("key"), F.lit(True).alias("whole"))), F.transform("lines", lambda x: F.struct(x.alias("key"), F.lit(False).alias("whole")))))
    origins = each.filter("level = 0").select("conv_id", "turn", keys.alias("k")).groupBy("conv_id", F.col("k.key").alias("key"), F.col("k.whole").alias("whole")).agg(F.min("turn").alias("origin"))
    quoted = each.filter("level > 0").select("conv_id", "turn", "level", "hash", "wrapped", F.size("lines").alias("n_lines"), keys.alias("k"))
    quoted = quoted.select("conv_id", "turn", "level", "hash", "wrapped", "n_lines", "k.*").distinct()
    found = quoted.join(origins, ["conv_id", "key", "whole"]).filter("origin < turn").groupBy("conv_id", "turn", "level", "hash", "wrapped", "n_lines").agg(
        F.max(F.when(F.col("whole"), F.col("origin"))).alias("_whole"), F.max(F.when(~F.col("whole"), F.col("origin"))).alias("_line"), F.count_if(~F.col("whole")).alias("_lines"))
    linked = found.withColumn("origin", F.coalesce("_whole", F.when(F.col("_lines") == F.col("n_lines"), F.col("_line")))).filter("origin IS NOT NULL")
    best = F.min(F.struct("level", (-F.col("origin")).alias("late")))
    replies = cut(linked.groupBy("conv_id", "turn").agg(F.count_distinct("level", "hash").alias("n_linked"), (-best["late"]).alias("parent_turn")), "replies")
    climbed = replies.select("conv_id", "turn", F.col("parent_turn").alias("thread_turn"), F.lit(1).alias("depth"))
    while True:  # every round doubles the length of the climbed path
        above = climbed.select("conv_id", F.col("turn").alias("thread_turn"), F.col("thread_turn").alias("_up"), F.col("depth").alias("_more"))
        if climbed.join(above, ["conv_id", "thread_turn"], "left_semi").isEmpty():
            break
        climbed = cut(climbed.join(above, ["conv_id", "thread_turn"], "left").select(
            "conv_id", "turn", F.coalesce("_up", "thread_turn").alias("thread_turn"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth")), "threads")
    known = replies.join(climbed, ["conv_id", "turn"])
    out = shown.join(known, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "own_text", F.col("n_quotes").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("max_level").cast("long").alias("max_level"), "parent_turn", F.coalesce("thread_turn", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))
    out = cut(out, "messages")
    return running_totals(out, ["conv_id", "thread_turn"], "turn", {"position": F.lit(1)}, tie=["role", "own_text"]).withColumn("position", F.col("position").cast("long"))


def sql(table: str = "conversations") -> str:
    return rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS uid, conv_id, turn, role, coalesce(text, '') AS text FROM {table}),
l0 AS (SELECT uid, conv_id, turn, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM m),
l AS (SELECT *, length(regexp_replace(regexp_extract(raw, '^[ \t]*(?:>[ \t]*)*'), '[^>]', '', 'g')) AS level,
        lower(trim(regexp_replace(substr(raw, length(regexp_extract(raw, '^[ \t]*(?:>[ \t]*)*')) + 1), '[ \t\r]+', ' ', 'g'))) AS norm FROM l0),
b AS (SELECT *, CASE WHEN norm <> '' AND lag(norm) OVER w <> '' AND lag(level) OVER w = level THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (PARTITION BY uid ORDER BY i)),
g AS (SELECT *, sum(new) OVER (PARTITION BY uid ORDER BY i) AS grp FROM b),
p AS (SELECT uid, conv_id, turn, level, sha256(string_agg(norm, chr(10) ORDER BY i)) AS hash FROM g WHERE norm <> '' GROUP BY uid, conv_id, turn, level, grp),
o AS (SELECT conv_id, hash, min(turn) AS origin FROM p WHERE level = 0 GROUP BY ALL),
k AS (SELECT DISTINCT conv_id, turn, level, hash, origin FROM p JOIN o USING (conv_id, hash) WHERE level > 0 AND origin < turn),
r AS (SELECT conv_id, turn, count(*) AS n_linked, max(origin) FILTER (level = low) AS parent_turn
      FROM (SELECT *, min(level) OVER (PARTITION BY conv_id, turn) AS low FROM k) GROUP BY ALL),
t AS (SELECT conv_id, turn, parent_turn AS up, 1 AS depth FROM r
      UNION ALL SELECT t.conv_id, t.turn, r.parent_turn, t.depth + 1 FROM t JOIN r ON t.conv_id = r.conv_id AND t.up = r.turn),
top AS (SELECT conv_id, turn, arg_max(up, depth) AS up, max(depth) AS depth FROM t GROUP BY ALL),
own AS (SELECT uid, coalesce(trim(string_agg(raw, chr(10) ORDER BY i) FILTER (level = 0), ' ' || chr(9) || chr(13) || chr(10)), '') AS own_text, max(level) AS max_level FROM l GROUP BY uid),
q AS (SELECT uid, count(*) FILTER (level > 0) AS n FROM p GROUP BY uid),
f AS (SELECT m.conv_id, m.turn, role, own_text, coalesce(q.n, 0)::BIGINT AS n_quotes, coalesce(n_linked, 0)::BIGINT AS n_linked, max_level::BIGINT AS max_level,
        parent_turn, coalesce(top.up, m.turn) AS thread_turn, coalesce(depth, 0)::BIGINT AS depth
      FROM m JOIN own USING (uid) LEFT JOIN q USING (uid) LEFT JOIN r ON m.conv_id = r.conv_id AND m.turn = r.turn LEFT JOIN top ON m.conv_id = top.conv_id AND m.turn = top.turn)
SELECT *, row_number() OVER (PARTITION BY conv_id, thread_turn ORDER BY turn, role, own_text)::BIGINT AS position FROM f"""
