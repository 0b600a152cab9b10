"""Structured Streaming forms of the service: arriving queries, new corpus files, history."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from seekwell.functions.text import tokens
from seekwell.operators.lexical import LexicalIndex, bm25_search
from seekwell.scale import scratch_path
from seekwell.streaming.growing import GrowingIndex


def answer_stream(queries: DataFrame, index: LexicalIndex, out: str, checkpoint: str, k: int = 10, **params) -> StreamingQuery:
    """Search every micro-batch of ``(qid, query)`` against a static index.

    A batch is written below its own id with overwrite, so a replayed batch replaces
    itself and results stay exactly once. An index that was not saved is saved once first,
    so that no micro-batch tokenises the corpus again.
    """
    if index.blocks is None:
        path, spark = scratch_path(queries.sparkSession, "index"), queries.sparkSession
        index.save(path)
        index = LexicalIndex.load(spark, path)

    def search(batch: DataFrame, batch_id: int) -> None:
        bm25_search(index, batch, k, **params).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return queries.writeStream.foreachBatch(search).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_stream(corpus: DataFrame, out: str, checkpoint: str, tokenizer="whitespace") -> StreamingQuery:
    """Add new ``(docid, text)`` rows to a :class:`seekwell.streaming.growing.GrowingIndex`, whose parts are merged by tiers."""
    def add(batch: DataFrame, batch_id: int) -> None:
        GrowingIndex(batch.sparkSession, out).add(batch.select("docid", "text"), batch_id, lambda text: tokens(text, tokenizer))

    return corpus.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_streamed_index(spark: SparkSession, path: str) -> LexicalIndex:
    """The index of all parts. A document that arrived again counts as its last version."""
    return GrowingIndex(spark, path).index()


class _History(StatefulProcessor):
    """The turns of one conversation, in order, as list state of (turn, text, at, revision)."""

    def __init__(self, keep: int, idle_ms: int | None, turn_kind: str):
        self.keep, self.idle_ms, self.turn_kind = keep, idle_ms, turn_kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", f"turn {self.turn_kind}, text string, at long, revision int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = {turn: (text, at, revision) for turn, text, at, revision in self.turns.get()}
        arrived: dict = {}
        for pdf in rows:
            for turn, text, at in zip(pdf["turn"].tolist(), pdf["text"].tolist(), pdf["at"].tolist()):
                arrived[turn] = max(arrived.get(turn, (text, at)), (text, at), key=lambda x: (x[0] is not None, x[0] or "", x[1]))
        changed = [turn for turn, (text, _) in arrived.items() if turn not in known or known[turn][0] != text]
        for turn in changed:
            known[turn] = (*arrived[turn], known[turn][2] if turn in known else -1)
        order = sorted(known)
        place = {turn: i for i, turn in enumerate(order)}
        # a new or changed turn stands in its own history and in those of the next turns
        touched = sorted({i for turn in changed for i in range(place[turn], min(place[turn] + self.keep, len(order)))})
        out = []
        for i in touched:
            text, at, revision = known[order[i]]
            known[order[i]] = (text, at, revision + 1)
            out.append((key[0], order[i], "\n".join(known[t][0] or "" for t in order[max(0, i - self.keep + 1):i + 1]), revision + 1))
        if self.idle_ms is not None:
            settled = [t for t in order if known[t][1] < timerValues.getCurrentWatermarkInMs()]
            for turn in settled[:max(0, len(settled) - self.keep + 1)]:
                del known[turn]  # no turn that may still arrive reaches back to it
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(at for _, at, _ in known.values()) + self.idle_ms)
        self.turns.put([(turn, *known[turn]) for turn in sorted(known)])
        yield pd.DataFrame(out, columns=["conv_id", "turn", "history", "revision"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.turns.clear()
        return iter([])

    def close(self) -> None:
        pass


def rolling_history(turns: DataFrame, keep: int, time: str | None = None, late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """For every arriving ``(conv_id, turn, text)`` the last ``keep`` turns of its conversation, ``(conv_id, turn, history, revision)``.

    Turns may arrive in any order, also over micro-batches: a turn that comes late is put in its place, and the histories
    it belongs to are sent again with a higher ``revision``, so the highest revision of a turn is its history. A turn that
    is sent again with another text replaces itself.

    With an event ``time`` column turns may come ``late`` by so much; older turns than the watermark leave the state but
    for the last ``keep - 1``, and a timer drops a conversation ``idle_ms`` after its last turn. Without it the state holds
    whole conversations. Needs the RocksDB state store, which :func:`history_stream` sets for its query.
    """
    kinds = dict(turns.dtypes)
    if time is None:
        rows = turns.select("conv_id", "turn", "text", F.lit(0).cast("long").alias("at"))
    else:
        rows = turns.withWatermark(time, late).select("conv_id", "turn", "text", F.col(time).alias("_time"), F.unix_millis(time).alias("at"))
    processor = _History(keep, idle_ms if time else None, kinds["turn"])
    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, history string, revision int"
    return rows.groupBy("conv_id").transformWithStateInPandas(processor, schema, "Append", "EventTime" if time else "None")


def history_stream(turns: DataFrame, keep: int, out: str, checkpoint: str, **options) -> StreamingQuery:
    """:func:`rolling_history` written to ``out``; :func:`read_history` returns the current rows."""
    conf, name = turns.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:  # a query keeps the settings it was started with
        return (rolling_history(turns, keep, **options).writeStream.format("parquet").option("path", out)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        conf.set(name, before)


def read_history(spark: SparkSession, out: str) -> DataFrame:
    """``(conv_id, turn, history)`` after all corrections."""
    return spark.read.parquet(out).groupBy("conv_id", "turn").agg(F.max_by("history", "revision").alias("history"))
