"""A lexical index that grows by micro-batches.

Every batch becomes a part of its own. As soon as ``FANOUT`` parts of one level exist they are merged into one part of
the next, so a search reads a number of parts that is logarithmic in the number of batches, and every document is
rewritten a logarithmic number of times. A document that arrives again is marked dead in the part that held it; searches
leave marked documents out, and the next merge drops them.

All state is files below one shared folder: parts, the places of their documents, marks, and one manifest per batch. A
batch reads the manifest before its own and writes its own last, so a replayed batch replaces itself.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from seekwell.operators.blocks import blocks_of_texts, corpus_counts, rebuilt, term_counts, write_blocks
from seekwell.operators.lexical import LexicalIndex
from seekwell.scale import BROADCAST_BYTES

FANOUT = 4


@dataclass(frozen=True)
class Part:
    """Batches ``first`` to ``last`` as one folder; the counts are those of its writing."""

    name: str
    level: int
    first: int
    last: int
    n_docs: int
    n_tokens: int
    n_blocks: int


MANIFEST = "name string, level int, first long, last long, n_docs long, n_tokens long, n_blocks long"


class GrowingIndex:
    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT):
        self.spark, self.path, self.fanout = spark, path, fanout

    def _read(self, *names: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{n}" for n in names])

    def parts(self, before: int | None = None) -> list[Part]:
        """Live parts, oldest first, of the newest manifest (of one written before batch ``before``)."""
        try:
            every = self._read("manifest")
        except Exception as e:  # no manifest yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []
        versions = every.select("version").distinct() if before is None else every.filter(F.col("version") < before).select("version").distinct()
        newest = versions.agg(F.max("version")).first()[0]
        if newest is None:
            return []
        rows = every.filter(F.col("version") == newest).drop("version").filter("name is not null").collect()  # a few rows per level
        return sorted((Part(**r.asDict()) for r in rows), key=lambda p: p.first)

    def add(self, docs: DataFrame, batch_id: int, tokens) -> None:
        """Take in ``(docid, text)`` rows; ``tokens`` maps a text column to its tokens. Of rows that share an id in one
        batch the one with the greatest text counts."""
        parts = self.parts(before=batch_id)
        one = docs.groupBy("docid").agg(F.max("text").alias("text")).select("docid", tokens(F.col("text")).alias("toks"))
        fresh = self._write(blocks_of_texts(one), f"batch-{batch_id}", 0, batch_id, batch_id)
        if fresh.n_docs and parts:
            places = reduce(DataFrame.unionAll, [self._read(f"places/{p.name}").withColumn("part", F.lit(p.name)) for p in parts])
            again = places.join(self._read(f"places/{fresh.name}").select("docid"), "docid", "left_semi").withColumn("by", F.lit(batch_id).cast("long"))
            again.select("part", "block", "place", "by").write.mode("overwrite").parquet(f"{self.path}/marks/batch={batch_id}")
        live = parts + [fresh] if fresh.n_docs else parts
        while True:
            full = [level for level in sorted({p.level for p in live}) if sum(p.level == level for p in live) >= self.fanout]
            if not full:
                break
            old = [p for p in live if p.level == full[0]][:self.fanout]
            name = f"batch-{old[0].first}-{old[-1].last}-level-{full[0] + 1}-by-{batch_id}"
            # merging drops the marked documents, so the new part starts without marks
            merged = self._write(rebuilt(self._marked(old, batch_id)[0]), name, full[0] + 1, old[0].first, old[-1].last)
            live = sorted([p for p in live if p not in old] + [merged], key=lambda p: p.first)
        rows = [tuple(p.__dict__.values()) for p in live] or [(None,) * 7]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={batch_id}")

    def _write(self, blocks: DataFrame, name: str, level: int, first: int, last: int) -> Part:
        saved = write_blocks(blocks.withColumn("block", F.monotonically_increasing_id()), f"{self.path}/parts/{name}")
        saved.select("block", F.posexplode("docid").alias("place", "docid")).select("docid", "block", "place").write.mode("overwrite").parquet(f"{self.path}/places/{name}")
        term_counts(saved).write.mode("overwrite").parquet(f"{self.path}/terms/{name}")
        return Part(name, level, first, last, **corpus_counts(saved).first().asDict())

    def _marks(self, parts: list[Part], upto: int | None) -> DataFrame | None:
        """(part, block, dead) of the given parts, or None."""
        try:
            marks = self._read("marks")
        except Exception as e:  # nothing was ever replaced
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
        mine = marks.filter(F.col("part").isin([p.name for p in parts]))
        mine = mine if upto is None else mine.filter(F.col("by") <= upto)
        return mine.groupBy("part", "block").agg(F.array_sort(F.collect_set("place")).alias("dead"))  # at most one block's documents

    def _marked(self, parts: list[Part], upto: int | None) -> tuple[DataFrame, bool]:
        """Blocks of ``parts`` with their marked places ``dead``, and whether there is any."""
        stored = reduce(DataFrame.unionAll, [self._read(f"parts/{p.name}").withColumn("part", F.lit(p.name)) for p in parts])
        dead = self._marks(parts, upto)
        size = dead.agg(F.coalesce(F.sum(F.size("dead") * 4 + 64), F.lit(0)).alias("bytes")).first()["bytes"] if dead is not None else 0
        if not size:
            return stored.withColumn("dead", F.lit(None).cast("array<int>")).drop("part", "block"), False
        side = F.broadcast(dead) if size <= BROADCAST_BYTES else dead
        return stored.join(side, ["part", "block"], "left").drop("part", "block"), True

    def index(self) -> LexicalIndex:
        """What a search reads: the live parts, without dead documents."""
        parts = self.parts()
        if not parts:
            raise ValueError(f"no documents were added to {self.path}")
        rows, some = self._marked(parts, None)
        if some:
            plain = rows.filter("dead is null").drop("dead")
            return LexicalIndex.of_blocks(plain.unionByName(rebuilt(rows.filter("dead is not null"))))
        stats = self.spark.createDataFrame([(sum(p.n_docs for p in parts), sum(p.n_tokens for p in parts), sum(p.n_blocks for p in parts))], "n_docs long, n_tokens long, n_blocks long")
        terms = self._read(*[f"terms/{p.name}" for p in parts]).groupBy("token").agg(F.sum("df").alias("df"))
        return LexicalIndex.of_blocks(rows.drop("dead"), stats, terms)
