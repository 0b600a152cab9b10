"""Answer scorers as Column expressions: exact match, F1, overlap, numbers, tasks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from seekwell.functions.text import (
    answer_words, first_integer, first_line, integers, normalize_answer, normalize_answer_zh, token_counts, words)
from seekwell.scale import let


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _num(flag: Column) -> Column:
    return F.when(flag, F.lit(1.0)).otherwise(F.lit(0.0))


def best_of(answers, score) -> Column:
    """Largest ``score(answer)`` over an array of answers, zero when there is none."""
    return F.coalesce(F.array_max(F.transform(_c(answers), score)), F.lit(0.0))


def exact_match(pred, answers) -> Column:
    p = normalize_answer(pred)
    return F.exists(_c(answers), lambda a: normalize_answer(a) == p)


def occurrences(tokens: Column) -> Column:
    """Number repeated tokens, so that a set intersection counts them like a multiset."""
    return F.flatten(F.transform(token_counts(tokens), lambda x: F.transform(
        F.sequence(F.lit(1), x["n"]), lambda i: F.concat_ws("\u0001", x["token"], i.cast("string")))))


def f1_tokens(pred: Column, gold: Column) -> Column:
    """Multiset F1 of two token arrays."""
    same = F.size(F.array_intersect(occurrences(pred), occurrences(gold))).cast("double")
    return let(F.struct(same.alias("s"), F.size(pred).alias("p"), F.size(gold).alias("g")),
               lambda x: F.when(x["s"] == 0, F.lit(0.0)).otherwise(2 * x["s"] / (x["p"] + x["g"])))


def f1_answer(pred, gold) -> Column:
    return f1_tokens(words(normalize_answer(pred)), words(normalize_answer(gold)))


def f1_answer_zh(pred, gold) -> Column:
    """Character F1 after Chinese normalisation."""
    chars = lambda c: F.filter(F.split(normalize_answer_zh(c), ""), lambda x: x != "")
    return f1_tokens(chars(pred), chars(gold))


def ngrams(tokens: Column, n: int) -> Column:
    """Distinct n-grams joined by spaces."""
    count = F.size(tokens) - (n - 1)
    at = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " ")))


def rouge_n(pred: Column, gold: Column, n: int) -> Column:
    """F1 of the distinct n-grams of two token arrays."""
    p, g = ngrams(pred, n), ngrams(gold, n)
    same = F.size(F.array_intersect(p, g))
    return F.when(same == 0, F.lit(0.0)).otherwise(2.0 * same / (F.size(p) + F.size(g)))


# Bits of one long that hold places of a token array; the rest takes the carry.
_BITS = 62


def _places(tokens: Column) -> Column:
    """Map from each distinct token to its places as an array of longs, one bit a place. Sorting brings equal tokens
    together, so each place is looked at once."""
    n = F.size(tokens)
    blocks = F.sequence(F.lit(0), F.ceil(n / F.lit(_BITS)).cast("int") - 1)
    order = F.array_sort(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i"))))

    def masks(s):
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(s, i)["t"] != F.get(s, i - 1)["t"]))
        mine = lambda st, p, j: F.slice(s, p + 1, F.coalesce(F.get(st, j + 1), n) - p)
        bits = lambda rows: F.transform(blocks, lambda k: F.aggregate(
            rows, F.lit(0).cast("long"), lambda acc, r: F.when(F.floor(r["i"] / F.lit(_BITS)) == k, acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (r["i"] % _BITS).cast("int")))).otherwise(acc)))
        return let(starts, lambda st: F.map_from_arrays(F.transform(st, lambda p: F.get(s, p)["t"]), F.transform(st, lambda p, j: bits(mine(st, p, j)))))

    return let(order, masks)


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two token arrays, by bit-parallel rows: one bit for each token of
    ``a``, as many longs as it takes, and one pass over ``b``. Built-in functions only; null counts as empty."""
    none = F.array().cast("array<string>")
    a, b = F.coalesce(F.filter(a, lambda t: t.isNotNull()), none), F.coalesce(b, none)

    def length(x):
        n, masks = F.size(x["a"]), x["m"]
        count = F.ceil(n / F.lit(_BITS)).cast("int")
        full = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.least(n - k * _BITS, F.lit(_BITS)).cast("int")) - F.lit(1).cast("long")
        whole = F.transform(F.sequence(F.lit(0), count - 1), lambda k: full(k))
        start = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("out"))

        def block(row, mask):
            def put(s, k):
                now, hit = F.get(row, k), F.get(row, k).bitwiseAND(F.get(mask, k))
                total = now + hit + s["carry"]
                return F.struct(F.when(total > full(k), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")).alias("carry"),
                                F.concat(s["out"], F.array(total.bitwiseAND(full(k)).bitwiseOR(now - hit))).alias("out"))
            return F.aggregate(F.sequence(F.lit(0), count - 1), start, put, lambda s: s["out"])

        rows = F.aggregate(x["b"], whole, lambda row, token: let(F.try_element_at(masks, token), lambda m: F.when(m.isNull(), row).otherwise(block(row, m))))
        return F.aggregate(rows, F.lit(0), lambda acc, v: acc - F.bit_count(v), lambda acc: acc + n)

    some = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(some, let(F.struct(a.alias("a"), b.alias("b"), _places(a).alias("m")), length)).otherwise(F.lit(0))


def rouge_l(pred: Column, gold: Column, kind: str = "f") -> Column:
    """LCS-based F1, or recall with ``kind='r'``."""
    common = lcs_length(pred, gold)
    bottom = F.size(gold).cast("double") if kind == "r" else (F.size(pred) + F.size(gold)) / 2.0
    return F.when(bottom > 0, common / bottom).otherwise(F.lit(0.0))


def edit_ratio(a: Column, b: Column) -> Column:
    """Similarity 0..1 of two texts in whole percent: the share of characters that stay when one text is turned into the
    other by deletions and insertions, from their longest common subsequence."""
    total = F.length(a) + F.length(b)
    same = lcs_length(F.filter(F.split(a, ""), lambda x: x != ""), F.filter(F.split(b, ""), lambda x: x != ""))
    return F.when(total == 0, F.lit(1.0)).otherwise(F.round(F.lit(200.0) * same / total) / 100)


def characters(col) -> Column:
    """Single characters without blanks."""
    return F.filter(F.split(_c(col), ""), lambda x: F.trim(x) != "")


def code_line(col) -> Column:
    """First line without comment or code marks."""
    lines = F.split(F.regexp_replace(_c(col), r"^\n+", ""), "\n")
    code = F.filter(lines, lambda x: ~(x.contains("`") | x.contains("#") | x.contains("//")))
    return F.coalesce(F.get(code, F.lit(0)), F.lit(""))


def substring_match(pred, answers) -> Column:
    """Any answer occurs as written, in lower case, or with one leading capital."""
    text = _c(pred)
    capital = lambda a: F.concat(F.upper(F.substring(a, 1, 1)), F.lower(F.substring(a, 2, 2**31 - 1)))
    return F.exists(_c(answers), lambda a: F.contains(text, a) | F.contains(text, F.lower(a)) | F.contains(text, capital(a)))


def number_share(pred, truth) -> Column:
    """Share of the numbers in the prediction that equal the true number."""
    found = integers(pred)
    right = F.size(F.filter(found, lambda x: x == _c(truth).cast("string")))
    return F.when(F.size(found) == 0, F.lit(0.0)).otherwise(right / F.size(found))


def paragraph_share(pred, truth, language: str = "en") -> Column:
    """As :func:`number_share`, with the paragraph number named in the truth."""
    word = {"en": "Paragraph ", "zh": "段落"}[language]
    return number_share(pred, F.regexp_extract(_c(truth), f"{word}([0-9]+)", 1))


def class_score(pred, truth, classes) -> Column:
    """One over the number of class names found, when the true one is among them. Found
    names that are only a part of the true name do not count."""
    t = _c(truth)
    found = F.filter(_c(classes), lambda c: F.contains(_c(pred), c))
    found = F.filter(found, lambda c: ~(F.contains(t, c) & (c != t)))
    return F.when(F.array_contains(found, t), 1.0 / F.size(found)).otherwise(F.lit(0.0))


# Phrases that come before an answer, and symbols dropped around it.
DEBUG_PREFIXES = ("answer is:", "is:", "answer:")
CHOICE_PREFIXES = ("answer is:", "answer:", "answer is", "option is")
CODE_BREAKS = "\n.`'\":"
DEBUG_BREAKS = "\n`'\"-*"
CHOICE_BREAKS = "\n\"'.,?!{}"
OPTIONS = ("A", "B", "C", "D")


def _after_prefix(text: Column, prefixes, accept) -> Column:
    """``accept(rest)`` on the text behind the first prefix that occurs; null when none does."""
    out = F.lit(None).cast("boolean")
    for prefix in reversed(prefixes):
        at = F.instr(text, prefix)
        rest = F.substring(text, at + len(prefix) + 1, F.length(text))
        out = F.when(at > 0, (F.length(rest) > 0) & accept(rest)).otherwise(out)
    return out


def _blank(text: Column, breaks: str) -> Column:
    return F.translate(text, breaks, " " * len(breaks))


def score_choice(pred, labels) -> Column:
    """Multiple choice: leading letter, then an answer phrase, then the first lone letter."""
    text = F.trim(_c(pred))
    labels = _c(labels)
    first = F.substring(text, 1, 1)
    clean = F.regexp_replace(_blank(text, CHOICE_BREAKS), " {2,}", " ")
    starts = lambda rest: F.exists(labels, lambda a: F.startswith(rest, a))
    letter = F.get(F.filter(F.split(F.trim(clean), " "), lambda w: w.isin("A", "B", "C", "D", "AB", "BC", "CD", "ABC", "BCD", "ABCD")), F.lit(0))
    fallback = F.coalesce(F.array_contains(labels, letter), F.lit(False))
    return _num(F.when(text == "", F.lit(False))
                .when(first.isin(*OPTIONS), F.array_contains(labels, first))
                .when(F.array_contains(labels, text), F.lit(True))
                .otherwise(F.coalesce(_after_prefix(clean, CHOICE_PREFIXES, starts), fallback)))


def score_code_debug(pred, name, letter) -> Column:
    """The prediction opens with the option letter, or names it behind an answer phrase."""
    text = _c(pred)
    opens = (F.substring(text, 1, 2) == F.concat(_c(letter), F.lit("."))) | (F.substring(text, 1, 2) == F.concat(_c(letter), F.lit(":")))
    clean = _blank(F.trim(text), DEBUG_BREAKS)
    clean = F.regexp_replace(F.replace(F.replace(clean, F.lit("Option"), F.lit(" ")), F.lit("option"), F.lit(" ")), " {2,}", " ")
    named = lambda rest: F.startswith(rest, _c(letter)) | F.startswith(rest, _c(name))
    return _num(opens | F.coalesce(_after_prefix(clean, DEBUG_PREFIXES, named), F.lit(False)))


def score_code_run(pred, truth) -> Column:
    """The last word is the expected integer."""
    w = words(_blank(F.trim(_c(pred)), CODE_BREAKS))
    last = F.when(F.size(w) > 0, F.element_at(w, -1))
    number = F.when(last.rlike(r"^[+-]?[0-9]+$"), last.try_cast("long"))
    return _num(F.coalesce(number == _c(truth).try_cast("long"), F.lit(False)))


def score_math_find(pred, truth) -> Column:
    """The first number equals the true one; an integer truth needs the same integer text."""
    found = F.regexp_extract(_c(pred), r"([0-9]+\.[0-9]+|[0-9]+)", 1)
    whole = _c(truth).rlike(r"^[+-]?[0-9]+$")
    same = F.when(whole, found == _c(truth)).otherwise(found.try_cast("double") == _c(truth).try_cast("double"))
    return _num(F.coalesce(same, F.lit(False)))


def score_math_calc(pred, truth) -> Column:
    """Length of the common prefix of two number lists, over the true length."""
    t = _c(truth)
    p = F.transform(integers(pred), lambda x: x.try_cast("long"))
    pos = F.when(F.size(t) > 0, F.sequence(F.lit(0), F.size(t) - 1)).otherwise(F.array().cast("array<int>"))
    wrong = F.filter(pos, lambda i: F.coalesce(F.get(p, i) != F.get(t, i).try_cast("long"), F.lit(True)))
    good = F.coalesce(F.get(wrong, F.lit(0)), F.size(t))
    return F.when(F.size(t) > 0, good.cast("double") / F.size(t)).otherwise(F.lit(0.0))


def task_score(task, pred, labels, classes=None) -> Column:
    """Score by task name. ``labels`` is an array of strings; the first one is the truth."""
    t, first = _c(task), F.get(_c(labels), F.lit(0))
    p = _c(pred)
    one_word = lambda: _num(F.array_contains(answer_words(p), first))
    return (
        F.when(t.isin("kv_retrieval", "kv_retrieval_prefix", "kv_retrieval_both"), one_word())
        .when(t.isin("passkey", "number_string"), _num(first_integer(p) == first))
        .when(t == "code_run", score_code_run(p, first.try_cast("long")))
        .when(t == "code_debug", score_code_debug(p, first, F.get(_c(labels), F.lit(1))))
        .when(t == "math_find", score_math_find(p, first.try_cast("double")))
        .when(t == "math_calc", score_math_calc(p, _c(labels)))
        .when(t == "longdialogue_qa_eng", _num(F.array_contains(F.transform(answer_words(p), F.upper), first)))
        .when(t == "longbook_choice_eng", score_choice(p, labels))
        .when(t == "longbook_qa_eng", best_of(labels, lambda a: f1_answer(p, a)))
        .when(t == "longbook_qa_chn", best_of(labels, lambda a: f1_answer_zh(p, a)))
        .when(t == "longbook_sum_eng", best_of(labels, lambda a: rouge_l(words(p), words(a))))
    )
