"""Reassembly of streamed completions."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import (
    ExpiredTimerInfo,
    StatefulProcessor,
    StatefulProcessorHandle,
    TimerValues,
)

_USAGE = T.StructType([T.StructField(n, T.LongType()) for n in ("prompt_tokens", "completion_tokens", "total_tokens")])
_DELTA = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
_CHOICE = T.StructType(
    [
        T.StructField("index", T.IntegerType()),
        T.StructField("delta", _DELTA),
        T.StructField("finish_reason", T.StringType()),
    ]
)
# A completion chunk as it was sent, with the arrival time and running number the log adds.
CHUNK_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("object", T.StringType()),
        T.StructField("created", T.LongType()),
        T.StructField("model", T.StringType()),
        T.StructField("choices", T.ArrayType(_CHOICE)),
        T.StructField("usage", _USAGE),
        T.StructField("error", T.StructType([T.StructField("message", T.StringType())])),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
    ]
)

# How long a completion without an end may pause, and how late a chunk may come.
IDLE, LATENESS = timedelta(minutes=10), "10 seconds"

_COMPLETION = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("_started", T.LongType()),
        T.StructField("content", T.StringType()),
        T.StructField("finish_reason", T.StringType()),
        T.StructField("total_tokens", T.LongType()),
        T.StructField("chunks", T.LongType()),
    ]
)


def scan_chunk_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(CHUNK_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return flatten_chunks(reader.json(folder))


def flatten_chunks(chunks: DataFrame) -> DataFrame:
    """``id, seq, ts, content, finish_reason, total_tokens``; an error event ends its completion."""
    choice = F.get("choices", F.lit(0))
    return chunks.select(
        "id", "seq", "ts",
        choice["delta"]["content"].alias("content"),
        F.coalesce(choice["finish_reason"], F.when(F.col("error").isNotNull(), "error")).alias("finish_reason"),
        F.col("usage.total_tokens").alias("total_tokens"),
    )


class Completions(StatefulProcessor):
    """One completion per key. Pieces are appended to a list state and read once, at the end; what is
    rewritten per micro-batch is one short row: the first and last time (ms and us), the number of
    pieces, and the latest finish and usage with their running numbers.

    A completion ends when its finish or error event and all numbers before that are there; when the
    watermark passes an end that still lacks a number, for that chunk would now be late; or, without
    an end, after ``idle_ms`` of event time without a chunk. It stays known as done for that long, so
    that chunks delivered again open no second one.
    """

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        head = "done boolean, first_us long, last_ms long, pieces long, end long, finish string, told long, tokens long"
        self.head = handle.getValueState("head", head)
        self.pieces = handle.getListState("pieces", "seq long, content string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held = self.head.get()
        if held is not None and held[0]:
            return
        _, first, last, many, end, finish, told, tokens = held or (False, None, 0, 0, None, None, None, None)
        new = []
        for r in rows:
            us = r["_us"]
            first, last = us if first is None else min(first, us), max(last, us // 1000)
            new.append((r["seq"], r["content"] or ""))
            if r["finish_reason"] is not None and (end is None or r["seq"] >= end):
                end, finish = r["seq"], r["finish_reason"]
            if r["total_tokens"] is not None and (told is None or r["seq"] >= told):
                told, tokens = r["seq"], r["total_tokens"]
        many += len(new)
        if end is not None and many > end:
            text = dict(reversed([*self.pieces.get(), *new] if held else new))  # of a number sent twice, the first counts
            if sum(0 <= n <= end for n in text) > end:
                self._wake(last + self.idle_ms, timerValues)
                if held:
                    self.pieces.clear()
                self.head.update((True, None, last, None, None, None, None, None))
                yield self._row(key, first, text, finish, tokens)
                return
        if held is None or (end is not None and held[4] is None):
            self._wake(last + (self.idle_ms if end is None else 1), timerValues)
        self.pieces.appendList(new)
        self.head.update((False, first, last, many, end, finish, told, tokens))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        held = self.head.get()
        if held is None:
            return
        done, first, last, _, end, finish, _, tokens = held
        now = timerValues.getCurrentWatermarkInMs()
        due = last + (self.idle_ms if done or end is None else 1)
        if due > now:  # chunks came since the timer was set
            self._wake(due, timerValues)
        elif done:
            self.head.clear()
        else:
            text = dict(reversed(list(self.pieces.get())))
            self.pieces.clear()
            if last + self.idle_ms > now:
                self._wake(last + self.idle_ms, timerValues)
                self.head.update((True, None, last, None, None, None, None, None))
            else:
                self.head.clear()
            yield self._row(key, first, text, finish, tokens)

    def _wake(self, at: int, now: TimerValues) -> None:
        self.handle.registerTimer(max(at, now.getCurrentWatermarkInMs() + 1))

    def _row(self, key: tuple, first: int, text: dict[int, str], finish: str | None, tokens: int | None) -> Row:
        return Row(
            id=key[0], _started=first, content="".join(text[n] for n in sorted(text)), finish_reason=finish, total_tokens=tokens, chunks=len(text)
        )

    def close(self) -> None:
        pass


def assemble_chunk_stream(chunks: DataFrame, idle: timedelta = IDLE, lateness: str = LATENESS) -> DataFrame:
    """One row per completion, given out as soon as it is whole: ``id, started, content,
    finish_reason, total_tokens, chunks``. A pause inside does not cut it, up to ``idle``.

    Running numbers begin at 0; a chunk sent twice counts once. A chunk later than ``lateness`` is
    dropped (and counted in the query progress), so state is bounded by the completions of the last
    ``idle`` of event time. A completion without an end comes out with a null finish.
    """
    keyed = chunks.withWatermark("ts", lateness).where("id is not null and seq is not null and ts is not null").withColumn("_us", F.unix_micros("ts"))
    found = keyed.groupBy("id").transformWithState(Completions(idle // timedelta(milliseconds=1)), _COMPLETION, "append", "EventTime")
    return found.select("id", F.timestamp_micros("_started").alias("started"), "content", "finish_reason", "total_tokens", "chunks")


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process what is there into parquet files, once, with RocksDB state."""
    conf = stream.sparkSession.conf
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(provider, None)
    conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = (
            stream.writeStream.format("parquet")
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start(out)
        )
        query.awaitTermination()
    finally:
        conf.set(provider, before) if before else conf.unset(provider)
