"""A work queue and its monitors as Structured Streaming over a log of request events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cuelake.sources.storage import fresh_folder


def read_log(spark: SparkSession, folder: str, pattern: str, schema, files: int = 1) -> DataFrame:
    """New files of a folder as a stream, `files` of them at a time."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)


def drained(stream: DataFrame, process: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Works through what the stream holds now, then stops. Each micro-batch goes through process and is written under its number, so a batch that runs again after a failure replaces its own rows."""
    spark, folder = stream.sparkSession, fresh_folder(stream.sparkSession, name)

    def one(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def latest_state(stream: DataFrame, columns: list[str], name: str) -> DataFrame:
    """The whole result of an aggregation of the stream, once it has worked through what it holds now."""
    spark, folder = stream.sparkSession, fresh_folder(stream.sparkSession, name)

    def one(batch: DataFrame, number: int) -> None:
        batch.select(*columns).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.outputMode("complete").foreachBatch(one).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    everything = spark.read.parquet(f"{folder}/out")
    last = everything.agg(F.max("batch").alias("batch"))
    return everything.join(F.broadcast(last), "batch", "left_semi").select(*columns)


def handled(batch: DataFrame) -> DataFrame:
    """The outcome of pending requests: an error where there is nothing to work on, else done (and the row may go)."""
    return batch.filter("status = 'pending'").select("request_id", F.when(F.col("value").isNull() | (F.col("value") < 1), "error").otherwise("done").alias("status"))


def reclaimed(requests: DataFrame) -> DataFrame:
    """Requests after a restart of the worker: those left in processing are pending again."""
    return requests.withColumn("status", F.when(F.col("status") == "processing", "pending").otherwise(F.col("status")))


def throttled_beats(stream: DataFrame, key: str, seconds: int = 4) -> DataFrame:
    """Beats (key, ts) that are at least `seconds` after the last one passed on for the key; the state of a key is one time."""
    gap = seconds * 1_000_000

    def run(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        times = sorted(t for p in parts for t in p["micros"])
        kept = []
        for t in times:
            if last is None or t - last >= gap:
                kept.append(t)
                last = t
        state.update((last,))
        yield pd.DataFrame({key: [keys[0]] * len(kept), "micros": kept})

    beats = stream.select(key, F.unix_micros(F.col("created_at").cast("timestamp")).alias("micros"))
    return beats.groupBy(key).applyInPandasWithState(run, f"{key} long, micros long", "last long", "append", GroupStateTimeout.NoTimeout)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RELEASED = "lane long, seq long, request_id long, reclaimed boolean, created_us long, started_us long, ended_us long, status string, note string"


#: Requests that wait lie together by this span of their time.
SPAN_US = 3_600_000_000
REQUEST = np.dtype([("created_us", "<i8"), ("request_id", "<i8"), ("run_us", "<i8"), ("code", "<i4"), ("reclaimed", "?")])


class Lane(StatefulProcessor):
    """One worker's queue. Requests wait until the watermark has passed them, so none that is older can still come; then the oldest is taken, and the next one when that has ended.

    State: when the worker is free again and how many requests it has taken; and the requests that wait, by spans of their time,
    in chunks of packed rows: what arrives is a chunk more, and only spans that the watermark has reached are read again, one
    at a time. So a batch costs what it brings and what it releases, however many wait. A timer stands at the oldest request
    that waits. A request whose run ends with a code other than 0 is an error with a note of it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getMapState("spans", "span long", "chunks int, oldest_us long")
        self.waiting = handle.getMapState("waiting", "span long, chunk int", "packed binary")
        self.worker = handle.getValueState("worker", "free_us long, taken long")

    def _wake(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        oldest = min((oldest for _, oldest in self.spans.values()), default=None)
        if oldest is not None:
            self.handle.registerTimer(-(-oldest // 1000))

    def _wait(self, span: int, rows: np.ndarray) -> None:
        chunks, oldest = self.spans.getValue((span,)) if self.spans.containsKey((span,)) else (0, rows["created_us"][0])
        self.waiting.updateValue((span, chunks), (rows.tobytes(),))
        self.spans.updateValue((span,), (chunks + 1, int(min(oldest, rows["created_us"].min()))))

    def _taken_out(self, span: int) -> np.ndarray:
        """The requests of a span in order; they don't wait any more."""
        chunks, _ = self.spans.getValue((span,))
        rows = np.concatenate([np.frombuffer(self.waiting.getValue((span, k))[0], REQUEST) for k in range(chunks)])
        for k in range(chunks):
            self.waiting.removeKey((span, k))
        self.spans.removeKey((span,))
        return rows[np.lexsort([rows[c] for c in ("code", "run_us", "reclaimed", "request_id", "created_us")])]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = []
        for part in rows:
            part = part[part["request_id"].notna()]
            new = np.empty(len(part), REQUEST)
            for c in REQUEST.names:
                new[c] = part[c].to_numpy(REQUEST[c])
            parts.append(new)
        new = np.concatenate(parts) if parts else np.empty(0, REQUEST)
        if len(new):
            span = new["created_us"] // SPAN_US
            order = np.argsort(span, kind="stable")
            for mine in np.split(order, np.flatnonzero(np.diff(span[order])) + 1):
                self._wait(int(span[mine[0]]), new[mine])
            self._wake()
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        free, taken = self.worker.get() if self.worker.exists() else (0, 0)
        for span in sorted(span for (span,), (_, oldest) in list(self.spans.iterator()) if oldest <= passed):
            held = self._taken_out(span)
            n = int(np.searchsorted(held["created_us"], passed, "right"))
            if n < len(held):
                self._wait(span, held[n:])
            due = held[:n]
            # A request starts when it is made or when the runs before it have ended, back to the last one that the worker waited for.
            before = np.cumsum(due["run_us"]) - due["run_us"]
            started = before + np.maximum(free, np.maximum.accumulate(due["created_us"] - before))
            ended = started + due["run_us"]
            failed = due["code"] != 0
            out = pd.DataFrame({"lane": key[0], "seq": taken + np.arange(n), "request_id": due["request_id"], "reclaimed": due["reclaimed"], "created_us": due["created_us"], "started_us": started, "ended_us": ended})
            out["status"], out["note"] = np.where(failed, "error", "done"), [f"exit {code}" if code else "" for code in due["code"].tolist()]
            free, taken = int(ended[-1]), taken + n
            self.worker.update((free, taken))
            yield out
        self._wake()

    def close(self) -> None:
        pass


def released(requests: DataFrame, delay: str) -> DataFrame:
    """The order in which workers take requests (lane, request_id, status, created_at, run_us, code), oldest first and one at a time in each lane, as a stream of RELEASED.

    Files may bring requests out of order by up to `delay`; they wait that long in the state. Requests found in processing belong to
    a worker that has died: they are reclaimed, and queue with the pending ones. Rows without a request only move the watermark on.
    Needs the state store of Spark that has timers (ROCKSDB).
    """
    open_ = requests.filter("request_id IS NULL OR status IN ('pending', 'processing')")
    shaped = open_.select("lane", "request_id", (F.col("status") == "processing").alias("reclaimed"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_us"), "run_us", "code", F.col("created_at").cast("timestamp").alias("_at"))
    return shaped.withWatermark("_at", delay).groupBy("lane").transformWithStateInPandas(Lane(), RELEASED, "Append", "EventTime")


def worked(stream: DataFrame, folder: str, process: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs what a stream of RELEASED hands out until it holds no more, and gives the outcomes.

    Each batch is claimed before it is worked on, under `folder`, and its outcomes are written under its number, so a batch that
    was cut off runs again after a restart with the same folder, from the state of the batch before it, and counts once.
    """
    spark = stream.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/claims/batch={number}")
        mine = spark.read.schema(batch.schema).parquet(f"{folder}/claims/batch={number}")
        process(mine).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        query = stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.parquet(f"{folder}/out")


def orphans(spark: SparkSession, folder: str) -> DataFrame:
    """Requests that were claimed and have no outcome: what a worker that died has left in processing."""
    claims = spark.read.parquet(f"{folder}/claims").select("lane", "seq", "request_id")
    try:
        out = spark.read.parquet(f"{folder}/out").select("request_id")
    except AnalysisException:  # the first batch was cut off
        return claims
    return claims.join(out, "request_id", "left_anti")
