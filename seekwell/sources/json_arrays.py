"""One large JSON array of objects, read by many tasks.

Spark cuts the file into splits and hands every task the text between opening braces, which is where objects begin. What
a split does to the reading state (inside a string or not, how deep) is found without knowing the state it starts in; one
small row per split then gives every split its true start, and a second scan emits the objects that lie inside a split.
An object that crosses borders leaves one piece in each split it touches; the pieces are put together by file and place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

# An escaped character, or a character that changes the state.
_MARK = re.compile(r'\\.|["{}\[\]]', re.S)


@dataclass
class _Scan:
    """Reading state and what a text does to it."""

    inside: bool = False
    depth: int = 0

    def marks(self, text: str) -> Iterator[tuple[int, str]]:
        """Places of the brackets outside of strings; the state is the one after each of them."""
        for m in _MARK.finditer(text):
            c = m[0]
            if c == '"':
                self.inside = not self.inside
            elif not self.inside and c in "{}[]":
                self.depth += 1 if c in "{[" else -1
                yield m.end(), c


def _fragments(spark: SparkSession, path) -> DataFrame:
    """(file, start, value): texts between opening braces, in the order of the file inside a split."""
    return spark.read.option("lineSep", "{").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _by_split(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, Iterator[str]]]:
    """(file, start, texts) of each split of a task. The brace that ended the text before is put back, except at the start of a file."""
    def rows():
        for b in batches:
            yield from zip(b["file"].tolist(), b["start"].tolist(), b["value"].tolist())

    held = rows()
    ahead = next(held, None)
    while ahead is not None:
        key = ahead[:2]

        def texts():
            nonlocal ahead
            first = key[1] == 0
            while ahead is not None and ahead[:2] == key:
                text = ahead[2]
                ahead = next(held, None)
                yield text if first else "{" + text
                first = False

        mine = texts()
        yield (*key, mine)
        for _ in mine:
            pass


def _effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(file, start, flips, plain, other): whether the split ends in the other string state, and the change of depth when it
    starts outside and inside a string. A backslash outside of strings is no JSON, so both readings see the same quotes."""
    out = []
    for file, start, texts in _by_split(batches):
        scans = [_Scan(False), _Scan(True)]
        for text in texts:
            for s in scans:
                for _ in s.marks(text):
                    pass
        out.append((file, start, scans[0].inside, scans[0].depth, scans[1].depth))
    yield pd.DataFrame(out, columns=["file", "start", "flips", "plain", "other"])


def _starts(effects: list) -> dict[tuple[str, int], tuple[bool, int]]:
    """The true state before each split: one row per split comes in, in the order of the file."""
    starts, file, inside, depth = {}, None, False, 0
    for r in sorted(effects, key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            file, inside, depth = r["file"], False, 0
        starts[r["file"], r["start"]] = (inside, depth)
        depth += r["other"] if inside else r["plain"]
        inside = inside != r["flips"]
    return starts


def _objects(starts: dict):
    """A function from fragments to (file, start, part, value): part 0 a whole object, 1 its beginning, 2 a middle, 3 its end."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        for file, start, texts in _by_split(batches):
            state = _Scan(*starts[file, start])
            begun_here, held = False, ([] if state.depth > 1 or state.inside else None)
            for text in texts:
                at = 0
                for end, c in state.marks(text):
                    if c == "{" and state.depth == 2 and held is None:
                        held, begun_here, at = [], True, end - 1
                    elif c == "}" and state.depth == 1 and held is not None:
                        held.append(text[at:end])
                        out.append((file, start, 0 if begun_here else 3, "".join(held)))
                        size, held, begun_here = size + len(out[-1][3]), None, True
                if held is not None:
                    held.append(text[at:])
                if size > 4_000_000:
                    yield pd.DataFrame(out, columns=["file", "start", "part", "value"])
                    out, size = [], 0
            if held is not None:
                out.append((file, start, 1 if begun_here else 2, "".join(held)))
        yield pd.DataFrame(out, columns=["file", "start", "part", "value"])

    return cut


def json_objects(spark: SparkSession, path) -> DataFrame:
    """``value``: the text of every object of the JSON arrays at ``path``."""
    rows = _fragments(spark, path)
    effects = rows.mapInPandas(_effects, "file string, start long, flips boolean, plain long, other long").collect()  # one row per split
    starts = _starts([r.asDict() for r in effects])
    found = rows.mapInPandas(_objects(starts), "file string, start long, part int, value string")
    whole = found.filter("part = 0").select("value")
    # at most two pieces per split: the window of a file holds no more rows than the file has splits, twice
    before = W.partitionBy("file").orderBy("start", F.when(F.col("part") == 1, 1).otherwise(0)).rowsBetween(W.unboundedPreceding, W.currentRow)
    pieces = found.filter("part > 0").withColumn("_object", F.sum(F.when(F.col("part") == 1, 1).otherwise(0)).over(before))
    joined = pieces.groupBy("file", "_object").agg(F.array_sort(F.collect_list(F.struct("start", "value"))).alias("p"))
    return whole.unionAll(joined.select(F.array_join(F.transform("p", lambda x: x["value"]), "").alias("value")))


def read_json_array(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """Rows of the objects of JSON arrays, by ``schema``; a file of any size is read by as many tasks as it has splits."""
    return json_objects(spark, path).select(F.from_json("value", schema).alias("_o")).select("_o.*")
