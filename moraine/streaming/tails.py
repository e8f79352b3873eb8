"""Streams over files: tails by AvailableNow, heartbeat timeouts with state, queues with dead letters."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TIMEOUT_US = 6_000_000
ATTEMPTS = 3


def follow(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """A stream of the Parquet files of one name in a folder (or of a folder of that name)."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*").parquet(folder)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", timeout_s: int = 120) -> DataFrame:
    """Takes what is there, into a Parquet table, and stops; a rerun with the same checkpoint takes only what is new."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
    try:
        if not q.awaitTermination(timeout_s):
            raise TimeoutError("the stream didn't end")
    finally:
        q.stop()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


class Heartbeats(StatefulProcessor):
    """Per host the last time and count; a row for each batch with the state after it.

    The clock is a column of the input, so results don't depend on when a batch runs.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "last_us bigint, beats bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        last, beats = (self.last.get() if self.last.exists() else None) or (-(2**62), 0)
        now = last
        for pdf in rows:
            last, beats, now = max(last, int(pdf["at_us"].max())), beats + len(pdf), max(now, int(pdf["now_us"].max()))
        self.last.update((last, beats))
        yield pd.DataFrame({"host": [key[0]], "last_us": [last], "beats": [beats], "dead": [now - last >= TIMEOUT_US]})

    def close(self) -> None:
        pass


def heartbeat_status(beats: DataFrame) -> DataFrame:
    """(host, last_us, beats, dead) of a stream (host, at_us, now_us)."""
    return beats.groupBy("host").transformWithStateInPandas(Heartbeats(), "host long, last_us long, beats long, dead boolean", "append", "none")


#: The watermark stays behind the latest heartbeat by this, as rows that aren't beyond it are dropped; timers are set as much earlier.
BEHIND_MS = 1
EVICTED = "host long, last_us long, died_us long"


class Reaper(StatefulProcessor):
    """Per host the last heartbeat; a row when it has been silent for the timeout.

    A timer runs for each host and fires as the stream's clock (the watermark)
    passes the timeout, also in batches that have no row of the host.  A gap
    between two heartbeats that is as long is found as they come, so what is
    evicted doesn't depend on how rows fall into batches.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last_us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        times = sorted(t for pdf in rows for t in pdf["at_us"].tolist())
        kept = self.last.get() if self.last.exists() else None
        times = [kept[0], *(t for t in times if t > kept[0])] if kept else times
        gone = [a for a, b in zip(times, times[1:]) if b - a >= TIMEOUT_US]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((times[-1],))
        self.handle.registerTimer(-(-(times[-1] + TIMEOUT_US) // 1000) - BEHIND_MS)
        yield self._rows(key, gone)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0]
        self.last.clear()
        yield self._rows(key, [last])

    @staticmethod
    def _rows(key, gone: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]] * len(gone), "last_us": gone, "died_us": [t + TIMEOUT_US for t in gone]}, columns=["host", "last_us", "died_us"]).astype("int64")

    def close(self) -> None:
        pass


def reaped(beats: DataFrame) -> DataFrame:
    """(host, last_us, died_us) of a stream (host, received_at): hosts that fell silent for the timeout, also those that never come back.

    Rows come in the order of time but for those of one batch; the clock is the
    latest heartbeat of any host in the batches before.
    """
    timed = beats.select("host", F.col("received_at").cast("timestamp").alias("received_at")).withWatermark("received_at", f"{BEHIND_MS} milliseconds").withColumn("at_us", F.unix_micros("received_at"))
    return timed.groupBy("host").transformWithStateInPandas(Reaper(), EVICTED, "append", "EventTime")


def route_letters(messages: DataFrame, fails, dead_keys: list[str], attempts: int = ATTEMPTS) -> DataFrame:
    """(key, value, attempts): what ``fails`` (a predicate by attempt number) lets through goes to 'delivered', else to every dead-letter key."""
    tries = F.sequence(F.lit(1), F.lit(attempts))
    first_ok = F.get(F.filter(tries, lambda k: ~fails(k)), F.lit(0))
    to = F.when(first_ok.isNotNull(), F.array(F.lit("delivered"))).otherwise(F.array(*[F.lit(k) for k in dead_keys]))
    return messages.select("*", F.coalesce(first_ok, F.lit(attempts)).alias("attempts"), F.posexplode(to).alias("to_pos", "to_key"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, change, value): set and delete events between two states of a table."""
    a, b = before.select("key", F.col("value").alias("old"), F.lit(1).alias("a")), after.select("key", F.col("value").alias("new"), F.lit(1).alias("b"))
    j = a.join(b, "key", "full_outer")
    kind = F.when(F.col("b").isNull(), "delete").when(F.col("a").isNull() | ~F.col("old").eqNullSafe(F.col("new")), "set")
    return j.withColumn("change", kind).filter(F.col("change").isNotNull()).select("key", "change", F.col("new").alias("value"))


def publish_set(stream: DataFrame, key: str, path: str, checkpoint: str, timeout_s: int = 120) -> DataFrame:
    """Publishes the whole set of keys seen so far, replacing what was published, for each batch there is."""
    spark = stream.sparkSession
    whole = stream.groupBy(key).agg(F.count(F.lit(1)).alias("n")).select(key)
    q = whole.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(path)).trigger(availableNow=True).start()
    try:
        if not q.awaitTermination(timeout_s):
            raise TimeoutError("the stream didn't end")
    finally:
        q.stop()
    return spark.read.schema(whole.schema).parquet(path)


def with_gauges(df: DataFrame, observation, **gauges) -> DataFrame:
    """Reports aggregates of the rows that pass, to an Observation or (by name, for a stream) to its listeners."""
    return df.observe(observation, *[c.alias(name) for name, c in gauges.items()])


def retried(handler, backoff_ms: tuple, dead_letters=()):
    """A batch handler that tries again after each pause and then writes the batch to the dead-letter folders."""

    def run(df: DataFrame, batch: int) -> None:
        for pause in (*backoff_ms, None):
            try:
                return handler(df, batch)
            except Exception:  # the schedule decides what an error means
                if pause is None and not dead_letters:
                    raise
                if pause is not None:
                    time.sleep(pause / 1000)
        for folder in dead_letters:
            df.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return run


def watch(stream: DataFrame, on_set, on_delete, checkpoint: str, timeout_s: int = 120) -> None:
    """Calls on_set(rows, batch) and on_delete(rows, batch) for the changes (key, change, value) of a stream, a batch at a time."""

    def run(df: DataFrame, batch: int) -> None:
        df = df.persist()  # two readers of one batch
        try:
            for kind, call in (("set", on_set), ("delete", on_delete)):
                call(df.filter(F.col("change") == kind), batch)
        finally:
            df.unpersist()

    _finish(stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).trigger(availableNow=True).start(), timeout_s)


def tee(stream: DataFrame, sinks: dict[str, object], path: str, checkpoint: str, timeout_s: int = 120) -> None:
    """One stream to several sinks: each batch, read once, goes through every transformation of ``sinks`` (name: function) to path/name."""

    def run(df: DataFrame, batch: int) -> None:
        df = df.persist()
        try:
            for name, f in sinks.items():
                f(df).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
        finally:
            df.unpersist()

    _finish(stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).trigger(availableNow=True).start(), timeout_s)


def ready(queries: list) -> list[int]:
    """Indices of the streaming queries that have ended or have no data to take; an empty list is an error."""
    if not queries:
        raise ValueError("no queries to poll")
    return [i for i, q in enumerate(queries) if not q.isActive or not q.status["isDataAvailable"]]


def _finish(q, timeout_s: int) -> None:
    try:
        if not q.awaitTermination(timeout_s):
            raise TimeoutError("the stream didn't end")
    finally:
        q.stop()


class Queue:
    """Messages in a folder of Parquet files; a listener's checkpoint keeps what was delivered.

    ``folder`` and ``state`` are on the storage that executors share.
    """

    def __init__(self, spark: SparkSession, folder: str, state: str, schema):
        self.spark, self.folder, self.state, self.schema, self.closed = spark, folder, state, schema, False

    def _open(self) -> None:
        if self.closed:
            raise RuntimeError("Queue already closed")

    def enqueue(self, messages: DataFrame) -> dict:
        """Appends; the versionstamp orders the enqueues of one writer."""
        self._open()
        messages.write.mode("append").parquet(self.folder)
        return {"ok": True, "versionstamp": f"{time.time_ns():020x}"}

    def listen(self, handler, timeout_s: int = 120, backoff_ms: tuple = (), dead_letters=()) -> None:
        """Gives (messages, batch number) to ``handler`` until all that is there was delivered; a batch may come again after a failure.

        Where ``handler`` raises it is tried again after each of ``backoff_ms``;
        once these are used up the messages go to every one of ``dead_letters``
        (folders), in order, or the error ends the listener if there are none.
        """
        self._open()
        handler = handler if not backoff_ms and not dead_letters else retried(handler, backoff_ms, dead_letters)
        stream = self.spark.readStream.schema(self.schema).parquet(self.folder)
        q = stream.writeStream.option("checkpointLocation", self.state).foreachBatch(handler).trigger(availableNow=True).start()
        try:
            if not q.awaitTermination(timeout_s):
                raise TimeoutError("the listener didn't end")
        finally:
            q.stop()

    def close(self) -> None:
        self.closed = True
