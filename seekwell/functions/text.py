"""Text normalisers, tokenisers, truncation and predicates as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from seekwell.scale import let

# Character classes of the punctuation normaliser.
CONTROLS = "\u0001\u0002\u0003\u0004\u0005\u0006\u0007\u0008\u000e\u000f\u0011\u0012\u0013\u0014\u0015\u0016\u0017\u0018\u0019\u001a\u001b"
SPACES = "\u000b\u000c\u0085"
HYPHENS = "-\u2010\u2011\u2043\u2012\u2013\u2014\u2015"
MINUSES = "-\u2212\uff0d\u207b"
SOFT_HYPHEN = "\u00ad"
DOUBLE_QUOTES = "\"\u201c\u201d\u201e\u201f"
SINGLE_QUOTES = "'\u2018\u2019\u201a\u201b"
APOSTROPHES = "'\u2019\u055a\ua78b\ua78c\uff07"
ACCENTS = "`\u00b4"
SLASHES = "/\u2044\u2215"
PRIMES = {"\u2032": "'", "\u2035": "'", "\u2033": "''", "\u2036": "''", "\u2034": "'''", "\u2037": "'''", "\u2057": "''''"}
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CJK_PUNCTUATION = (
    "！？｡。＂＃＄％＆＇（）＊＋，－／：；＜＝＞＠［＼］＾＿｀｛｜｝～｟｠｢｣､、〃》「」『』【】〔〕〖〗〘〙〚〛〜〝〞〟"
    "〰〾〿–—‘’‛“”„‟…‧﹏."
)
# Token and script patterns.
SIMPLE_TOKEN = r"([\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}])"
CHINESE = "[\u4e00-\u9fa5]"
ARTICLES = r"(?U)\b(a|an|the)\b"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalize_punctuation(col) -> Column:
    """Map typographic punctuation to ASCII and drop control characters.

    One ``translate`` covers all one-to-one and delete rules; only the rules that
    lengthen the text need ``replace``.
    """
    to_dash, to_double = HYPHENS + MINUSES, DOUBLE_QUOTES
    to_single = SINGLE_QUOTES + APOSTROPHES + ACCENTS + "".join(p for p, r in PRIMES.items() if len(r) == 1)
    source = SPACES + to_dash + to_double + to_single + SLASHES
    target = " " * len(SPACES) + "-" * len(to_dash) + '"' * len(to_double) + "'" * len(to_single) + "/" * len(SLASHES)
    out = F.translate(_c(col), source + CONTROLS + SOFT_HYPHEN, target)
    for prime, repl in PRIMES.items():
        if len(repl) > 1:
            out = F.replace(out, F.lit(prime), F.lit(repl))
    out = F.replace(out, F.lit("\u2026"), F.lit("..."))
    return F.replace(out, F.lit(" . . . "), F.lit(" ... "))


@F.pandas_udf(T.StringType())
def nfd(text: pd.Series) -> pd.Series:
    """Canonical decomposition; Spark has no built-in for it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFD", t))


def simple_tokens(col, lower: bool = False, decompose: bool = False) -> Column:
    """Runs of letters, digits and marks, or single visible symbols."""
    text = nfd(_c(col)) if decompose else _c(col)
    if lower:
        text = F.lower(text)
    return F.regexp_extract_all(text, F.lit(SIMPLE_TOKEN), F.lit(1))


def space_tokens(col, stop: list[str] | None = None) -> Column:
    """Tokens between single spaces, optionally without stop tokens."""
    tokens = F.split(_c(col), " ")
    return F.filter(tokens, lambda t: ~t.isin(list(stop))) if stop else tokens


def words(col) -> Column:
    """Tokens between runs of white space, no empty tokens."""
    return F.filter(F.split(_c(col), r"[\s\p{Z}]+"), lambda t: t != "")


def tokens(col, tokenizer="whitespace") -> Column:
    """Token array by tokenizer name, or by any callable from Column to Column."""
    if callable(tokenizer):
        return tokenizer(_c(col))
    if tokenizer == "whitespace":
        return space_tokens(col)
    if tokenizer == "simple":
        return simple_tokens(col)
    raise ValueError(f"unknown tokenizer {tokenizer!r}")


def token_counts(array: Column) -> Column:
    """``array<struct<token, n>>`` of the distinct tokens, in one pass per row.

    Sorting puts equal tokens next to each other, so run starts give the counts and the
    row never has to be exploded and shuffled to be counted.
    """

    def runs(s):
        n = F.size(s)
        index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(index, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda st: F.transform(
            st,
            lambda p, j: F.struct(
                F.get(s, p).alias("token"),
                (F.coalesce(F.get(st, j + 1), n) - p).alias("n"),
            ),
        ))

    return let(F.array_sort(array), runs)


def normalize_answer(col) -> Column:
    """Lower case, no ASCII punctuation, no English articles, single spaces."""
    text = F.translate(F.lower(_c(col)), ASCII_PUNCTUATION, "")
    return squeeze(F.regexp_replace(text, ARTICLES, " "))


def normalize_answer_zh(col) -> Column:
    """Lower case, no ASCII or CJK punctuation, no white space."""
    text = F.translate(F.lower(_c(col)), ASCII_PUNCTUATION + CJK_PUNCTUATION, "")
    return F.regexp_replace(text, r"[\s\p{Z}]+", "")


def squeeze(col) -> Column:
    """Trim and turn every white-space run into one space."""
    return F.trim(F.regexp_replace(_c(col), r"[\s\p{Z}]+", " "))


def normalize_text(col, ignore_case=True, ignore_punctuation=True, ignore_space=True, ignore_number=False) -> Column:
    """Normaliser built from flags; punctuation and digits are removed, spaces squeezed."""
    text = _c(col)
    if ignore_case:
        text = F.lower(text)
    if ignore_punctuation:
        text = F.translate(text, ASCII_PUNCTUATION, "")
    if ignore_number:
        text = F.translate(text, "0123456789", "")
    if ignore_space:
        text = squeeze(text)
    return text


def squeeze_double_spaces(col) -> Column:
    return F.regexp_replace(_c(col), "[ ]{2,}", " ")


def contains_chinese(col) -> Column:
    return _c(col).rlike(CHINESE)


def clean_query(col) -> Column:
    """Escape line breaks and tabs so the query stays on one line."""
    text = F.replace(_c(col), F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    return text


def is_blank(col) -> Column:
    return F.length(F.regexp_replace(_c(col), r"[\s\p{Z}]+", "")) == 0


def first_integer(col) -> Column:
    """First digit run, or an empty string."""
    return F.regexp_extract(_c(col), "[0-9]+", 0)


def integers(col) -> Column:
    return F.regexp_extract_all(_c(col), F.lit("([0-9]+)"), F.lit(1))


# Symbols that separate words in retrieval answers.
ANSWER_BREAKS = "\n:\"'.,?!{}"


def answer_words(col, breaks: str = ANSWER_BREAKS) -> Column:
    return words(F.translate(_c(col), breaks, " " * len(breaks)))


def truncate(array: Column, limit: int, how: str = "head") -> Column:
    """Keep ``limit`` tokens: ``head``, ``tail`` or ``middle`` (both ends, half each)."""
    n = F.size(array)
    if how == "head":
        return F.slice(array, 1, limit)
    if how == "tail":
        return F.when(n <= limit, array).otherwise(F.slice(array, n - limit + 1, F.lit(limit)))
    if how == "middle":
        half = limit // 2
        cut = F.concat(F.slice(array, 1, half), F.slice(array, n - half + 1, F.lit(half)))
        return F.when(n <= limit, array).otherwise(cut)
    raise ValueError(f"unknown truncation {how!r}")


def truncate_left_of_pair(left: Column, right: Column, limit: int) -> Column:
    """Shorten only ``left`` so that both together hold at most ``limit`` tokens."""
    return F.slice(left, F.lit(1), F.greatest(F.lit(limit) - F.size(right), F.lit(0)))


def first_line(col) -> Column:
    """First line after the leading line breaks."""
    return F.regexp_extract(_c(col), r"^\n*([^\n]*)", 1)


def parse_rewrite(col) -> Column:
    """Struct ``(original, rewritten)`` from a chat message; empty pair when malformed."""
    message = _c(col)
    body = F.regexp_extract(message, r"(?s)(\[INST\].*)$", 1)
    pattern = r"(?s)\[INST\]\s*(.+) \[/INST\]\s*(.+)"
    original = F.regexp_extract(body, pattern, 1)
    rewritten = F.regexp_extract(body, pattern, 2)
    marker = "Rewritten Query: "
    original = F.regexp_replace(original, r"^Original Query: ", "")
    original = F.regexp_replace(original, r"^Query: ", "")
    at = F.instr(rewritten, marker)
    rewritten = F.when(at > 0, F.substring(rewritten, at + len(marker), F.length(rewritten))).otherwise(rewritten)
    return F.struct(original.alias("original"), rewritten.alias("rewritten"))


def fill_template(template: str, **cols) -> Column:
    """``{name}`` placeholders filled with columns; the rest is literal text."""
    parts, rest = [], template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            parts.append(F.lit(head))
        if not brace:
            break
        name, close, rest = tail.partition("}")
        if not close:
            raise ValueError(f"unclosed placeholder in {template!r}")
        parts.append(_c(cols.get(name, name)).cast("string"))
    return F.concat(*parts) if parts else F.lit("")


def contains_tokens(text: Column, answer: Column) -> Column:
    """True when the ``answer`` tokens occur in ``text`` as one run. Both are token arrays
    without spaces inside tokens, so a delimited substring test is exact."""
    pad = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    return F.contains(pad(text), pad(answer))
