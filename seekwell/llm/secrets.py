"""Secret scans with inferred grammars.

Three base patterns find certain credentials. Their values are the labelled examples: for each kind at
most ``EXAMPLES`` distinct values (those with the smallest hashes over all documents) are parted by the classes of
characters they have, and a prefix tree of each part is folded into a
probabilistic automaton by merging states whose symbol and ending frequencies are statistically compatible. One more
automaton, the null model, is inferred from all ordinary words: states of their prefix tree merge when their last
``CONTEXT`` characters agree, so that its counts are one aggregate over the words. Every
other run of at least ``SHORTEST`` credential characters in every document is then a candidate, dots inside included
and dots around it not, scored by its likelihood per character under each automaton against even odds. It is added when
it fits a format as well as all but a hundredth of the examples do, cut to its length; a run without digits has to fit
better, too, than all but a thousandth of the ordinary words (letter runs that occur in two documents or more, all of
them, in a histogram of their scores in steps of ``STEP``), no run may fit the null model as well as its format, and one without letters better than as many random numbers. If a dotted
run is not added as a whole, its parts between the dots are judged.

One pass over the texts writes the base spans and the candidates (slim rows); the other steps read only those.

Defined results: a null or empty text has no spans; null ids are carried along; repeated rows are scanned each;
without examples no format is learned and only base spans remain; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seekwell.llm.common import by_key, clean_input, cut, same_key, sized_broadcast, with_row_key

# Fixed patterns and least lengths.
KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{6,}[A-Za-z0-9+/_=-]")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
HEX_ONLY, LOWER, UPPER, OTHER = re.compile(r"[0-9a-f]+|[0-9A-F]+"), re.compile(r"[a-z]"), re.compile(r"[A-Z]"), re.compile(r"[^A-Za-z0-9]")
DIGIT, LETTER, WORD = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]"), r"^[A-Za-z][a-z]+$"

EXAMPLES, LONGEST_EXAMPLE, ALPHA, LIKE_EXAMPLES = 400, 256, 0.05, 0.01
SHORTEST, NUMBERS, LIKE_WORDS, LEAST_SHAPE = 8, 4000, 0.001, 10
CONTEXT, STEP = 2, 0.001
# Characters of the texts, or candidates, that are turned into Python objects at once.
PIECE_CHARS, PIECE_CANDIDATES = 1_000_000, 50_000
# An unseen value of a format scores below the examples, which the automaton knows by heart.
SLACK = 0.6


def base_matches(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of the base patterns, by start and then kind."""
    found = []
    if "=" in text or ":" in text:
        found += [(0, m.start(), m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m.group()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if DIGIT.search(text) or HEX.search(text):
        found += [(2, m.start(), m.end(), m.group()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda f: (f[1], f[0]))


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """Runs of credential characters that touch no base span."""
    return [(m.start(), m.end(), m.group()) for m in CANDIDATE.finditer(text) if not any(s < m.end() and m.start() < e for _, s, e, _ in base)]


class Automaton:
    """Probabilistic automaton inferred from example strings by merging compatible prefix-tree states."""

    def __init__(self, examples: list[str], alpha: float = ALPHA):
        self.passed, self.ended, self.seen, self.to = [0], [0], [{}], [{}]
        self.margin = math.sqrt(0.5 * math.log(2 / alpha))
        for text in examples:
            at = 0
            self.passed[0] += 1
            for c in text:
                if c not in self.to[at]:
                    self.to[at][c] = len(self.to)
                    self.passed.append(0), self.ended.append(0), self.seen.append({}), self.to.append({})
                self.seen[at][c] = self.seen[at].get(c, 0) + 1
                at = self.to[at][c]
                self.passed[at] += 1
            self.ended[at] += 1
        self._merge()
        self._compact()

    @classmethod
    def of_contexts(cls, counts: list[tuple[str, str, int]]) -> "Automaton":
        """From (last characters, next character or empty at the end, times) of all examples."""
        made = cls([])
        number = {"": 0} | {c: i for i, c in enumerate(sorted({c for c, _, _ in counts if c}), 1)}
        n = len(number)
        made.passed, made.ended, made.seen, made.to = [0] * n, [0] * n, [{} for _ in range(n)], [{} for _ in range(n)]
        for context, c, times in counts:
            at = number[context]
            made.passed[at] += times
            if c:
                made.seen[at][c], made.to[at][c] = times, number[(context + c)[-CONTEXT:]]
            else:
                made.ended[at] += times
        return made

    def _differ(self, f: int, n: int, g: int, m: int) -> bool:
        return bool(n and m) and abs(f / n - g / m) > self.margin * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.passed[a], self.passed[b]
            if self._differ(self.ended[a], n, self.ended[b], m):
                return False
            for c in self.seen[a].keys() | self.seen[b].keys():
                if self._differ(self.seen[a].get(c, 0), n, self.seen[b].get(c, 0), m):
                    return False
                if c in self.to[a] and c in self.to[b]:
                    if self.to[a][c] != self.to[b][c]:
                        todo.append((self.to[a][c], self.to[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below ``b`` to the automaton at ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.passed[a] += self.passed[b]
            self.ended[a] += self.ended[b]
            for c, n in self.seen[b].items():
                self.seen[a][c] = self.seen[a].get(c, 0) + n
                if c in self.to[a]:
                    todo.append((self.to[a][c], self.to[b][c]))
                else:
                    self.to[a][c] = self.to[b][c]

    def _merge(self) -> None:
        red = [0]
        blue = [(0, c) for c in sorted(self.to[0])]
        while blue:
            parent, c = blue.pop(0)
            state = self.to[parent][c]
            if state in red:
                continue
            same = next((r for r in red if self._compatible(r, state)), None)
            if same is None:
                red.append(state)
                blue += [(state, d) for d in sorted(self.to[state])]
            else:
                self.to[parent][c] = same
                self._fold(same, state)
                blue = [(r, d) for r in red for d in sorted(self.to[r]) if self.to[r][d] not in red]

    def _compact(self) -> None:
        """Forget the states that merging left behind: every task holds the automata."""
        number, order = {0: 0}, [0]
        for state in order:
            for c in sorted(self.to[state]):
                if self.to[state][c] not in number:
                    number[self.to[state][c]] = len(order)
                    order.append(self.to[state][c])
        self.passed, self.ended, self.seen = ([x[s] for s in order] for x in (self.passed, self.ended, self.seen))
        self.to = [{c: number[t] for c, t in self.to[s].items()} for s in order]

    def scores(self, text: str) -> list[float]:
        """Mean log odds per character against even odds over the alphabet, of every beginning of the text."""
        at, total, even, small, out = 0, 0.0, math.log(len(ALPHABET) + 1), 0.01, []
        for i, c in enumerate(text, 1):
            if at is None:
                total += math.log(small)
            else:
                n = self.passed[at] + small * (len(ALPHABET) + 1)
                total += math.log((self.seen[at].get(c, 0) + small) / n) + even
                at = self.to[at].get(c)
            out.append(total / i)
        return out

    def score(self, text: str) -> float:
        return self.scores(text)[-1] if text else 0.0


@dataclass
class Format:
    """An automaton with the scores that its examples reach at each length and that ordinary words and numbers stay below."""

    automaton: Automaton
    least: list[float]
    words: float
    numbers: float
    null: Automaton

    def fits(self, value: str) -> bool:
        score = self.automaton.score(value)
        if score < self.least[min(len(value), len(self.least)) - 1]:
            return False
        if score <= max(self.null.score(value), self.null.score(value.lower())):  # a shouted word is a word
            return False
        return (score > self.words or bool(DIGIT.search(value))) and (score > self.numbers or bool(LETTER.search(value)))


def numbers() -> list[str]:
    """Random numbers of 8 to 16 digits."""
    rnd = random.Random(0)
    return ["".join(rnd.choice("0123456789") for _ in range(SHORTEST + i % 9)) for i in range(NUMBERS)]


def shape(value: str) -> tuple[bool, ...]:
    """Which classes of characters a value has; hexadecimal letters are a class of their own where no others are."""
    hexadecimal = bool(HEX_ONLY.fullmatch(value))
    return (hexadecimal, bool(LOWER.search(value)), bool(UPPER.search(value)), bool(DIGIT.search(value)), bool(OTHER.search(value)))


def by_format(texts: list[str]) -> list[list[str]]:
    """The values of one pattern, one list for each shape that ``LEAST_SHAPE`` of them share, the rest together."""
    groups: dict[tuple, list[str]] = {}
    for t in texts:
        groups.setdefault(shape(t), []).append(t)
    large = [g for _, g in sorted(groups.items()) if len(g) >= LEAST_SHAPE]
    rest = [t for _, g in sorted(groups.items()) if len(g) < LEAST_SHAPE for t in g]
    return large + [rest] * bool(rest)


def learn(examples: dict[int, list[str]]) -> list[tuple[Automaton, list[float]]]:
    """An automaton and its least scores for each shape of the values of each kind; the order is fixed."""
    out = []
    for _, every in sorted(examples.items()):
        for texts in by_format(every):
            automaton = Automaton(sorted(texts))
            runs = [automaton.scores(t) for t in texts]
            least = []
            for length in range(1, max(map(len, runs)) + 1):
                reached = sorted(r[min(length, len(r)) - 1] for r in runs)
                least.append(max(0.0, SLACK * reached[int(LIKE_EXAMPLES * len(reached))]))
            out.append((automaton, least))
    return out


def ordinary_words(slim: DataFrame) -> DataFrame:
    """(word): all candidates of letters alone that two documents have."""
    words = F.array_distinct(F.transform(F.filter("candidates", lambda c: c["value"].rlike(WORD)), lambda c: c["value"]))
    return cut(slim.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("word"), "words")


def null_model(words: DataFrame) -> Automaton:
    """The automaton of all ordinary words; its counts are bounded by the alphabet."""
    places = words.select("word", F.explode(F.sequence(F.lit(1), F.length("word") + 1)).alias("at"))
    before = F.expr(f"substring(word, greatest(at - {CONTEXT}, 1), least(at - 1, {CONTEXT}))")
    counts = places.groupBy(before.alias("context"), F.expr("substring(word, at, 1)").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    return Automaton.of_contexts(sorted((r["context"], r["c"], r["n"]) for r in counts.collect()))


def borders(words: DataFrame, automata: list[Automaton]) -> list[float]:
    """The score under each automaton that all but ``LIKE_WORDS`` of the ordinary words stay below or reach, rounded up to
    whole steps."""
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple[int, int], int] = {}
        for b in batches:
            for word in b["word"]:
                for i, a in enumerate(automata):
                    key = (i, math.ceil(a.score(word) / STEP))
                    found[key] = found.get(key, 0) + 1
        yield pd.DataFrame([(i, at, n) for (i, at), n in found.items()], columns=["i", "at", "n"])

    out = [-math.inf] * len(automata)
    rows = words.mapInPandas(counted, "i int, at long, n long").groupBy("i", "at").agg(F.sum("n").alias("n")).collect()  # scores lie between -10 and 5
    for i in {r["i"] for r in rows}:
        steps = sorted((r["at"], r["n"]) for r in rows if r["i"] == i)
        left = int((1 - LIKE_WORDS) * sum(n for _, n in steps))
        for at, n in steps:
            left -= n
            if left < 0:
                out[i] = at * STEP
                break
    return out


def formats_of(examples: dict[int, list[str]], slim: DataFrame) -> list[Format]:
    """What the values of the base patterns look like, beside the ordinary words of all documents."""
    learned = learn(examples)
    if not learned:
        return []
    words, random_ = ordinary_words(slim), numbers()
    null, below = null_model(words), borders(words, [a for a, _ in learned])
    return [Format(a, least, border, sorted(map(a.score, random_))[int((1 - LIKE_WORDS) * len(random_))], null) for (a, least), border in zip(learned, below)]


def pieces(sizes, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold ``most`` in all, or a single row."""
    at, total = 0, 0
    for i, size in enumerate(sizes):
        if i > at and total + size > most:
            yield at, i
            at, total = i, 0
        total += size
    if at < len(sizes):
        yield at, len(sizes)


def scan_base(docs: DataFrame) -> DataFrame:
    """(doc_id, base, values, candidates) of whole texts."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            # the candidates of a text are many times as many objects as the text
            for at, end in pieces([len(text or "") for text in b["text"]], PIECE_CHARS):
                rows = []
                for doc_id, text in zip(b["doc_id"].iloc[at:end], b["text"].iloc[at:end]):
                    text = text or ""
                    base = base_matches(text)
                    rows.append((doc_id, [(k, s, e) for k, s, e, _ in base], [(k, v) for k, _, _, v in base if len(v) <= LONGEST_EXAMPLE], candidates(text, base)))
                yield pd.DataFrame(rows, columns=["doc_id", "base", "values", "candidates"])

    schema = (f"doc_id {kind}, base array<struct<kind:int,start:int,end:int>>, values array<struct<kind:int,value:string>>, "
              "candidates array<struct<start:int,end:int,value:string>>")
    return clean_input(docs).mapInPandas(scanned, schema)


def judged(batches: Iterator[pa.RecordBatch], formats: list[Format]) -> Iterator[pa.RecordBatch]:
    """(doc_id, spans) from (doc_id, base, candidates). Candidates stay in Arrow: the different ones of a piece are judged
    once, and only those that fit are looked up in the rows."""
    fits = lru_cache(20_000)(lambda value: any(f.fits(value) for f in formats))

    def fitting(value: str) -> list[tuple[int, int]]:
        if fits(value):
            return [(0, len(value))]
        parts = re.finditer(r"[^.]+", value) if "." in value else []
        return [m.span() for m in parts if m.end() - m.start() >= SHORTEST and fits(m.group())]

    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        ids, bases, runs = (batch.column(name) for name in ("doc_id", "base", "candidates"))
        edges = runs.offsets.to_numpy()
        for at, end in pieces(np.diff(edges), PIECE_CANDIDATES):
            spans = [[(x["kind"], x["start"], x["end"]) for x in base] for base in bases.slice(at, end - at).to_pylist()]
            found = runs.values.slice(edges[at], edges[end] - edges[at])
            values = found.field("value").dictionary_encode()
            inside = {i: f for i, value in enumerate(values.dictionary.to_pylist()) if (f := fitting(value))}
            hits = np.flatnonzero(np.isin(values.indices.to_numpy(), list(inside)))
            rows = np.searchsorted(edges[at:end + 1] - edges[at], hits, "right") - 1
            for row, start, value in zip(rows, found.field("start").to_numpy()[hits].tolist(), values.indices.to_numpy()[hits].tolist()):
                spans[row] += [(3, start + s, start + e) for s, e in inside[value]]
            yield pa.RecordBatch.from_arrays([ids.slice(at, end - at), pa.array([sorted(x, key=lambda x: (x[1], x[0])) for x in spans], kind)], ["doc_id", "spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and all spans (kind, start, end) by start and kind."""
    slim = cut(scan_base(docs), "secrets")
    values = slim.select(F.explode("values").alias("v")).select("v.kind", "v.value").distinct()
    examples: dict[int, list[str]] = {}
    for k in range(3):  # at most EXAMPLES short strings of each kind reach the driver
        picked = values.filter(F.col("kind") == k).orderBy(F.xxhash64("value"), "value").limit(EXAMPLES)
        examples[k] = [r["value"] for r in picked.collect()]
    formats = formats_of(examples, slim)
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return slim.select("doc_id", "base", "candidates").mapInArrow(lambda batches: judged(batches, formats), f"doc_id {kind}, spans array<struct<kind:int,start:int,end:int>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts, hash of the base spans and the list of all spans."""
    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)
        for b in batches:
            rows = [[(x["kind"], x["start"], x["end"]) for x in spans] for spans in b["spans"]]
            out = {f"n_{KINDS[k]}": [sum(x[0] == k for x in r) for r in rows] for k in range(3)}
            out["base_sha256"] = [hashlib.sha256(text([x for x in r if x[0] < 3]).encode()).hexdigest() for r in rows]
            yield b[["doc_id"]].assign(**out, spans=[text(r) for r in rows])

    kind = found.select("doc_id").schema[0].dataType.simpleString()
    return found.mapInPandas(listed, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; ``n_chars``, if there, follows the new text. Rows without
    spans are unchanged."""
    keyed = with_row_key(docs)
    found = find_secrets(by_key(keyed)).filter(F.size("spans") > 0)
    found = cut(found.groupBy(F.col("doc_id._k1").alias("_k1"), F.col("doc_id._k2").alias("_k2")).agg(F.first("spans").alias("_spans")), "spans")
    found = sized_broadcast(found, 24 + 16 * F.size("_spans"))

    def cut_out(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, found_ in zip(text, spans):
            if found_ is None:
                out.append(t)
                continue
            parts, at = [], 0
            for s in found_:
                if s["start"] >= at:
                    parts += [t[at:s["start"]], mark]
                at = max(at, s["end"])
            out.append("".join([*parts, t[at:]]))
        return pd.Series(out)

    joined = keyed.join(found, same_key(keyed, found), "left")
    changed = F.col("_spans").isNotNull()
    joined = joined.select("_row", changed.alias("_changed"), F.when(changed, F.pandas_udf(cut_out, "string")("_row.text", "_spans")).otherwise(F.col("_row.text")).alias("_text"))
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_changed"), F.length("_text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("_row.n_chars"))
    return joined.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
