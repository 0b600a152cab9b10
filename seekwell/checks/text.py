"""Text functions as whole-table jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from seekwell.checks import sql as S
from seekwell.checks.registry import register
from seekwell.functions import scoring as Q, text as X
from seekwell.operators.prompts import explode_options, few_counts
from seekwell.operators.ranking import sort_by_score
from seekwell.sources.files import LONG_DOC_LANGUAGES, check_languages

PUNCT = r"[!-/:-@\[-`{-~]"


@register("normalized_punctuation", r"""WITH a AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
   regexp_replace(text, '[\x{01}-\x{08}\x{0e}\x{0f}\x{11}-\x{1b}\x{ad}]', '', 'g'), '[\x{0b}\x{0c}\x{85}]', ' ', 'g'),
   '[\x{2010}\x{2011}\x{2043}\x{2012}-\x{2015}\x{2212}\x{ff0d}\x{207b}]', '-', 'g'), '[\x{201c}\x{201d}\x{201e}\x{201f}]', '"', 'g'),
   '[\x{2018}-\x{201b}\x{055a}\x{a78b}\x{a78c}\x{ff07}`\x{b4}\x{2032}\x{2035}]', '''', 'g') AS t FROM documents),
 b AS (SELECT doc_id, text, replace(replace(regexp_replace(t, '[\x{2044}\x{2215}]', '/', 'g'), chr(8230), '...'), ' . . . ', ' ... ') AS t FROM a)
 SELECT doc_id, t AS normalized, t <> text AS changed FROM b""")
def _(t):
    n = X.normalize_punctuation("text")
    return t.documents.select("doc_id", n.alias("normalized"), (n != F.col("text")).alias("changed"))


@register("simple_token_counts", f"WITH d AS (SELECT lang, unnest({S.simple('lower(text)')}) AS token FROM documents) SELECT lang, token, count(*) AS n FROM d GROUP BY lang, token")
def _(t):
    return t.documents.select("lang", F.explode(X.simple_tokens("text", lower=True)).alias("token")).groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"))


@register("decomposed_tokens")
def _(t):
    return t.documents.select("lang", F.explode(X.simple_tokens("text", lower=True, decompose=True)).alias("token")).groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"))


ARTICLE = r"(^|[^\p{L}\p{N}\p{M}_])(?:a|an|the)($|[^\p{L}\p{N}\p{M}_])"
NORM_EN = (r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({c}), '" + PUNCT + r"', '', 'g'), '" + ARTICLE + r"', '\1 \2', 'g'), '" + ARTICLE
           + r"', '\1 \2', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))").replace("\\p{L}", "\\p{{L}}").replace("\\p{N}", "\\p{{N}}").replace("\\p{M}", "\\p{{M}}").replace("{-~", "{{-~")
NORM_ZH = (r"regexp_replace(translate(regexp_replace(lower({c}), '" + PUNCT + r"', '', 'g'), '" + X.CJK_PUNCTUATION + r"', ''), '[\s\p{{Z}}]+', '', 'g')").replace("{-~", "{{-~").replace("｛", "｛")


@register("normalized_answers", f"SELECT doc_id, {NORM_EN.format(c='text')} AS english, {NORM_ZH.format(c='text')} AS chinese FROM documents")
def _(t):
    return t.documents.select("doc_id", X.normalize_answer("text").alias("english"), X.normalize_answer_zh("text").alias("chinese"))


@register("flag_normalizer", rf"""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '{PUNCT}', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g')) AS usual,
 regexp_replace(text, '[0-9]', '', 'g') AS no_digits, regexp_replace(text, ' {{2,}}', ' ', 'g') AS squeezed FROM documents""")
def _(t):
    return t.documents.select("doc_id", X.normalize_text("text").alias("usual"),
                              X.normalize_text("text", False, False, False, True).alias("no_digits"),
                              X.squeeze_double_spaces("text").alias("squeezed"))


@register("stop_token_filter", "SELECT doc_id, array_to_string(list_filter(string_split(text, ' '), lambda t: t NOT IN ('the', 'of', 'la', 'de', 'der', 'die')), ' ') AS kept FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(X.space_tokens("text", ["the", "of", "la", "de", "der", "die"]), " ").alias("kept"))


@register("chinese_flag", r"SELECT lang, count(*) AS n, count(*) FILTER (regexp_matches(text, '[\x{4e00}-\x{9fa5}]')) AS n_chinese FROM documents GROUP BY lang")
def _(t):
    return t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(X.contains_chinese("text"), 1)).alias("n_chinese"))


@register("clean_queries", r"""SELECT conv_id, turn, replace(replace(replace(replace(text, '\', '\\'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') AS query
 FROM conversations WHERE regexp_replace(text, '[\s\p{Z}]+', '', 'g') <> ''""")
def _(t):
    return t.conversations.filter(~X.is_blank("text")).select("conv_id", "turn", X.clean_query("text").alias("query"))


@register("numbers_in_text", r"""SELECT doc_id, regexp_extract(text, '[0-9]+') AS first_number, array_to_string(regexp_extract_all(text, '[0-9]+'), ' ') AS numbers,
 array_to_string(list_filter(regexp_split_to_array(regexp_replace(text, '[\n:"''.,?!{}]', ' ', 'g'), '[\s\p{Z}]+'), lambda w: w <> ''), ' ') AS words FROM documents""")
def _(t):
    return t.documents.select("doc_id", X.first_integer("text").alias("first_number"), F.array_join(X.integers("text"), " ").alias("numbers"),
                              F.array_join(X.answer_words("text"), " ").alias("words"))


@register("truncated_texts", """WITH d AS (SELECT doc_id, string_split(text, ' ') AS t FROM documents), n AS (SELECT doc_id, t, len(t) AS n FROM d)
 SELECT doc_id, array_to_string(t[1:65], ' ') AS head, array_to_string(CASE WHEN n <= 65 THEN t ELSE t[n - 64:n] END, ' ') AS tail,
 array_to_string(CASE WHEN n <= 65 THEN t ELSE t[1:32] || t[n - 31:n] END, ' ') AS middle FROM n""")
def _(t):
    d = t.documents.select("doc_id", X.space_tokens("text").alias("t"))
    return d.select("doc_id", *[F.array_join(X.truncate(F.col("t"), 65, how), " ").alias(how) for how in ("head", "tail", "middle")])


@register("pair_truncation", """SELECT a.conv_id, a.turn, array_to_string(string_split(a.text, ' ')[1:greatest(64 - len(string_split(b.text, ' ')), 0)], ' ') AS kept
 FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def _(t):
    a = t.conversations.select("conv_id", "turn", X.space_tokens("text").alias("l"))
    b = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), X.space_tokens("text").alias("r"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.array_join(X.truncate_left_of_pair(F.col("l"), F.col("r"), 64), " ").alias("kept"))


@register("first_lines", "SELECT doc_id, split_part(ltrim(chr(10) || text, chr(10)), chr(10), 1) AS line FROM documents")
def _(t):
    return t.documents.select("doc_id", X.first_line(F.concat(F.lit("\n"), "text")).alias("line"))


@register("parsed_rewrites", """SELECT a.conv_id, a.turn, CASE WHEN a.role = 'system' THEN '' ELSE a.text END AS original, CASE WHEN a.role = 'system' THEN '' ELSE b.text END AS rewritten
 FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def _(t):
    a = t.conversations.select("conv_id", "turn", "role", "text")
    b = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    # a system turn gives a message without markers, which must parse to an empty pair
    message = F.when(F.col("role") == "system", F.concat(F.lit("[INST] "), "text")).otherwise(
        F.concat(F.lit("<s>[INST] Original Query: "), "text", F.lit(" [/INST] Here: Rewritten Query: "), "next"))
    p = X.parse_rewrite(message)
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", p["original"].alias("original"), p["rewritten"].alias("rewritten"))


@register("key_templates", "SELECT doc_id, source || ' ' || text AS plain, lower(source || chr(10) || text) AS lowered, source || ' -- ' || text AS dashed, trim(source || ' ' || text) AS stripped FROM documents")
def _(t):
    return t.documents.select("doc_id", X.fill_template("{source} {text}").alias("plain"), F.lower(X.fill_template("{source}\n{text}")).alias("lowered"),
                              X.fill_template("{title} -- {text}", title="source").alias("dashed"), F.trim(X.fill_template("{source} {text}")).alias("stripped"))


PAIRS_SQL = "p AS (SELECT a.conv_id, a.turn, a.text AS pred, b.text AS gold FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


def turn_pairs(t):
    """Every turn with the one that follows it, as prediction and answer."""
    a = t.conversations.select("conv_id", "turn", F.col("text").alias("pred"))
    b = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("gold"))
    return a.join(b, ["conv_id", "turn"])


CHARS = "string_split({c}, '')"


@register("edit_similarity", f"""WITH {PAIRS_SQL}, s AS (SELECT row_number() OVER () AS id, conv_id, turn, {CHARS.format(c='pred')} AS a, {CHARS.format(c='gold')} AS b FROM p), {S.lcs('l', 's')}
 SELECT conv_id, turn, round(200.0e0 * lcs / (len(a) + len(b))) / 100 AS ratio FROM s JOIN l USING (id)""")
def _(t):
    return turn_pairs(t).select("conv_id", "turn", Q.edit_ratio(F.col("pred"), F.col("gold")).alias("ratio"))


@register("length_filter", "SELECT doc_id, array_to_string(string_split(text, ' ')[1:512], ' ') AS text FROM documents WHERE len(string_split(text, ' ')) >= 128")
def _(t):
    d = t.documents.select("doc_id", X.space_tokens("text").alias("t"))
    return d.filter(F.size("t") >= 128).select("doc_id", F.array_join(X.truncate(F.col("t"), 512), " ").alias("text"))


@register("language_check", "SELECT lang, count(*) AS n FROM documents WHERE lang IN ('ar','de','en','es','fr','hi','it','ja','ko','pt','ru','th','zh') GROUP BY lang")
def _(t):
    return t.documents.filter(F.col("lang").isin(check_languages(LONG_DOC_LANGUAGES, LONG_DOC_LANGUAGES))).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@register("answer_in_text", f"""SELECT a.conv_id, a.turn, contains({S.padded('a.text')}, {S.padded("split_part(b.text, ' ', 1)")}) AS found
 FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def _(t):
    p = turn_pairs(t).withColumn("first", F.split("gold", " ")[0])
    return p.select("conv_id", "turn", X.contains_tokens(X.simple_tokens("pred", lower=True), X.simple_tokens("first", lower=True)).alias("found"))


@register("exploded_options", "SELECT doc_id, unnest([lang, source, quality::VARCHAR, toxic::VARCHAR]) AS choice, unnest([0, 1, 2, 3]) AS pos FROM documents JOIN labels USING (doc_id)")
def _(t):
    d = t.documents.join(t.labels, "doc_id")
    return explode_options(d.select("doc_id", F.array("lang", "source", F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("options")))


@register("few_topic_filter", "SELECT source, count(*) AS n, avg(n_chars) AS mean_chars FROM documents WHERE source IN ('src0', 'src1', 'src2') GROUP BY source")
def _(t):
    return few_counts(t.documents, "source", ["src0", "src1", "src2"]).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("mean_chars"))


@register("sorted_payload", "SELECT conv_id, turn, array_to_string(list_transform(list_sort(list_transform(range(0, len(w)), lambda i: {'s': -length(w[i + 1]), 'i': i, 'x': w[i + 1]})), lambda r: r.x), ' ') AS ordered FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)")
def _(t):
    w = X.space_tokens("text")
    return t.conversations.select("conv_id", "turn", w.alias("w")).select(
        "conv_id", "turn", F.array_join(sort_by_score(F.col("w"), F.transform("w", F.length)), " ").alias("ordered"))
