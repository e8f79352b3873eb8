"""Streams run to their end over the events table."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import functions as F

from ..streaming import tails
from .registry import query, table


def work_dir(spark, name: str) -> str:
    """Under the shared folder that the session names; a temporary one only where it names none and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "moraine")
    return f"{root.rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def events_stream(spark, sf_dir):
    return tails.follow(spark, sf_dir, "events.parquet", table(spark, sf_dir, "events").schema)


@query("SELECT event_id AS seq, event_type FROM events WHERE event_id > 100")
def stream_incremental_append(spark, sf_dir):
    d = work_dir(spark, "append")
    return tails.run_once(events_stream(spark, sf_dir).filter("event_id > 100").select(F.col("event_id").alias("seq"), "event_type"), f"{d}/out", f"{d}/state")


@query("""WITH n AS (SELECT max(epoch_us(ts)) AS now FROM events)
SELECT user_id AS host, max(epoch_us(ts)) AS last_us, count(*) AS beats, max(now) - max(epoch_us(ts)) >= 6000000 AS dead FROM events, n GROUP BY 1""")
def stream_heartbeat_timeout(spark, sf_dir):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    now = table(spark, sf_dir, "events").agg(F.max(us)).first()[0]
    beats = events_stream(spark, sf_dir).select(F.col("user_id").alias("host"), us.alias("at_us"), F.lit(now).cast("bigint").alias("now_us"))
    d = work_dir(spark, "beats")
    return tails.run_once(tails.heartbeat_status(beats), f"{d}/out", f"{d}/state")


@query("""WITH e AS (SELECT DISTINCT user_id AS host, epoch_us(ts) AS t FROM events), g AS (SELECT host, t, lead(t) OVER (PARTITION BY host ORDER BY t) AS later, max(t) OVER () AS now FROM e)
SELECT host, t AS last_us, t + 6000000 AS died_us FROM g WHERE coalesce(later, now) - t >= 6000000""")
def stream_heartbeat_reap(spark, sf_dir):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    beats = events_stream(spark, sf_dir).select(F.col("user_id").alias("host"), F.col("ts").alias("received_at"))
    d = work_dir(spark, "reap")
    return tails.run_once(tails.reaped(beats), f"{d}/out", f"{d}/state")


@query("""SELECT event_id, to_key, CASE WHEN event_id % 5 = 0 THEN 3 ELSE event_id % 3 + 1 END AS attempts FROM events, (SELECT unnest(['delivered', 'queue_failed/a', 'queue_failed/b']) AS to_key)
WHERE (event_id % 5 = 0) = (to_key <> 'delivered')""")
def stream_dead_letter(spark, sf_dir):
    m = events_stream(spark, sf_dir).select("event_id")
    fails = lambda k: (F.col("event_id") % 5 == 0) | (k <= F.col("event_id") % 3)
    d = work_dir(spark, "letters")
    routed = tails.route_letters(m, fails, ["queue_failed/a", "queue_failed/b"])
    return tails.run_once(routed.select("event_id", "to_key", F.col("attempts").cast("bigint").alias("attempts")), f"{d}/out", f"{d}/state")


@query("SELECT c_name AS key, CASE WHEN c_custkey % 3 = 0 THEN 'delete' ELSE 'set' END AS change, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey + 1 END AS value FROM customer WHERE c_custkey % 3 < 2")
def kv_change_feed(spark, sf_dir):
    before = table(spark, sf_dir, "customer").select(F.col("c_name").alias("key"), F.col("c_custkey").alias("value"))
    after = before.filter("value % 3 <> 0").withColumn("value", F.when(F.col("value") % 3 == 1, F.col("value") + 1).otherwise(F.col("value")))
    return tails.changes(before, after)


@query("SELECT DISTINCT event_type FROM events")
def stream_publish_set(spark, sf_dir):
    d = work_dir(spark, "set")
    return tails.publish_set(events_stream(spark, sf_dir).select("event_type"), "event_type", f"{d}/out", f"{d}/state")


@query("SELECT event_id, event_type FROM events")
def stream_queue_deliver_whole(spark, sf_dir):
    return deliver_parts(spark, sf_dir, "event_id % 2 = 0", "event_id IS NULL OR event_id % 2 <> 0")


@query("SELECT event_id, k FROM events, (SELECT unnest(['a', 'b']) AS k)")
def stream_dead_letters_after_retries(spark, sf_dir):
    d, events = work_dir(spark, "retries"), table(spark, sf_dir, "events").select("event_id")
    q = tails.Queue(spark, f"{d}/messages", f"{d}/state", events.schema)

    def fail(df, batch):
        raise RuntimeError("always")

    q.enqueue(events)
    q.listen(fail, backoff_ms=(10, 20), dead_letters=[f"{d}/dead/k=a", f"{d}/dead/k=b"])
    return spark.read.parquet(f"{d}/dead").select("event_id", "k")


@query("SELECT c_name AS key, CASE WHEN c_custkey % 3 = 0 THEN 'delete' ELSE 'set' END AS change FROM customer WHERE c_custkey % 3 < 2")
def stream_change_watch(spark, sf_dir):
    d = work_dir(spark, "watch")
    kv_change_feed(spark, sf_dir).write.parquet(f"{d}/feed")
    stream = spark.readStream.schema("key string, change string, value bigint").parquet(f"{d}/feed")
    seen = lambda kind: lambda df, batch: df.select("key").write.mode("overwrite").parquet(f"{d}/seen/change={kind}/batch={batch}")
    tails.watch(stream, seen("set"), seen("delete"), f"{d}/state")
    return spark.read.parquet(f"{d}/seen").select("key", "change")


@query("SELECT event_type, n, how FROM (SELECT event_type, count(*) AS n, 'upper' AS how FROM events GROUP BY 1) UNION ALL SELECT event_type, count(*), 'error' FROM events WHERE event_type = 'error' GROUP BY 1")
def stream_tee(spark, sf_dir):
    d, counted = work_dir(spark, "tee"), lambda df: df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    tails.tee(events_stream(spark, sf_dir).select("event_type"), {"how=upper": counted, "how=error": lambda df: counted(df.filter("event_type = 'error'"))}, f"{d}/out", f"{d}/state")
    return spark.read.parquet(f"{d}/out").groupBy("event_type", "how").agg(F.sum("n").alias("n")).select("event_type", "n", "how")


@query("SELECT event_id, l FROM events, (SELECT unnest(['one', 'two']) AS l)")
def stream_broadcast(spark, sf_dir):
    """Every listener of a channel, each with a state of its own, sees each message."""
    d, events = work_dir(spark, "channel"), table(spark, sf_dir, "events").select("event_id")
    listeners = {l: tails.Queue(spark, f"{d}/messages", f"{d}/state-{l}", events.schema) for l in ("one", "two")}
    listeners["one"].enqueue(events)
    for l, q in listeners.items():
        q.listen(lambda df, batch, l=l: df.write.mode("overwrite").parquet(f"{d}/heard/l={l}/batch={batch}"))
    return spark.read.parquet(f"{d}/heard").select("event_id", "l")


@query("SELECT r_name AS name FROM region")
def source_objects_created(spark, sf_dir):
    """Objects that come into a folder, as a stream of events."""
    from ..sources import blobs

    d = work_dir(spark, "objects")
    table(spark, sf_dir, "region").select(F.col("r_name").alias("value"), F.col("r_name").alias("name")).write.partitionBy("name").text(f"{d}/in")
    seen = tails.run_once(blobs.created(spark, f"{d}/in/*", "*.txt"), f"{d}/out", f"{d}/state")
    return seen.select(F.regexp_extract("path", "name=([^/]*)/", 1).alias("name")).distinct()


def deliver_parts(spark, sf_dir, *parts):
    """Events of each part, queued and delivered one part after the other."""
    d, events = work_dir(spark, "queue"), table(spark, sf_dir, "events").select("event_id", "event_type")
    q = tails.Queue(spark, f"{d}/messages", f"{d}/state", events.schema)
    deliver = lambda df, batch: df.write.mode("overwrite").parquet(f"{d}/delivered/batch={batch}")
    for part in parts:
        q.enqueue(events.filter(part))
        q.listen(deliver)
    q.close()
    return spark.read.parquet(f"{d}/delivered").select("event_id", "event_type")
