"""Document table docs(pk, sk, value) and key-value tables: scans, lookups, writes.

Writes give the next state of the table as a DataFrame; Parquet has no MERGE,
so the caller writes it beside the old one and swaps.  Filters are plain
comparisons, which reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE_CONFIG = T.StructType([T.StructField(n, T.LongType()) for n in ("per_gb", "per_core", "scale_in_percent", "scale_out_percent", "min_hosts", "max_hosts", "memory_gb", "cores", "cooldown")])


def prefix_scan(docs: DataFrame, pk) -> DataFrame:
    return docs.filter(F.col("pk") == pk).orderBy("sk")


def keyset_after(docs: DataFrame, pk, sk) -> DataFrame:
    return docs.filter((F.col("pk") == pk) & (F.col("sk") > sk)).orderBy("sk")


def point_get(docs: DataFrame, pk, sk) -> DataFrame:
    return docs.filter((F.col("pk") == pk) & (F.col("sk") == sk)).limit(1)


def read_named(docs: DataFrame, key: str) -> DataFrame:
    """Key-value layout: the value of one key."""
    return docs.filter(F.col("key") == key).limit(1)


def decode_deployment(value: Column) -> Column:
    """16 bytes, two unsigned little-endian numbers; another length is an error."""
    from ..functions.ints import u64_le

    checked = F.when(F.octet_length(value) == 16, value).otherwise(F.raise_error(F.lit("a deployment has 16 bytes")).cast("binary"))
    return F.struct(u64_le(checked, 1).alias("code_id"), u64_le(checked, 9).alias("code_version"))


def encode_deployment(code_id: Column, version: Column) -> Column:
    from ..functions.ints import to_u64_le

    return F.concat(to_u64_le(code_id), to_u64_le(version))


def decode_json(value: Column, schema) -> Column:
    """Malformed JSON fails the query."""
    return F.from_json(value, schema, {"mode": "FAILFAST"})


def valid_config(c) -> Column:
    """What a scale configuration promises: all positive, percents to 100 with in under out, min not over max."""
    every = F.forall(F.array(*[c[f.name] for f in SCALE_CONFIG]), lambda x: x > 0)
    return every & (c["scale_out_percent"] <= 100) & (c["scale_in_percent"] < c["scale_out_percent"]) & (c["min_hosts"] <= c["max_hosts"])


def upsert(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``delta`` replace those of their keys; delta has a row for each key."""
    return base.join(delta.select(*keys), keys, "left_anti").unionByName(delta)


def delete_many(base: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Absent keys are ignored."""
    return base.join(keys.select(*on).distinct(), on, "left_anti")


def get_many(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pos, key, value) aligned with ``wanted`` (pos, key): null where the key is missing."""
    return wanted.join(base.select("key", "value", F.lit(True).alias("found")), "key", "left").select("pos", "key", "value", F.coalesce("found", F.lit(False)).alias("found"))


def exists(base: DataFrame, wanted: DataFrame) -> DataFrame:
    return get_many(base, wanted).select("key", "found")


def increment(base: DataFrame, deltas: DataFrame) -> DataFrame:
    """(key, value): several deltas of a key add up; an absent key starts at 0.  For a single writer."""
    d = deltas.groupBy("key").agg(F.sum("delta").alias("delta"))
    return base.join(d, "key", "full_outer").select("key", (F.coalesce("value", F.lit(0)) + F.coalesce("delta", F.lit(0))).alias("value"))


def list_keys(base: DataFrame, after, limit: int) -> DataFrame:
    """A page of keys beyond the cursor, in order."""
    keys = base.select("key")
    return (keys.filter(F.col("key") > after) if after is not None else keys).orderBy("key").limit(limit)


def prefix_list(base: DataFrame, prefix: list) -> DataFrame:
    """Entries of hierarchical keys (arrays) that begin with ``prefix``, in key order."""
    p = F.array(*[F.lit(x) for x in prefix])
    return base.filter(F.slice("key", 1, len(prefix)) == p).orderBy("key")


def set_items(base: DataFrame, items: DataFrame, quota: int) -> DataFrame:
    """Web storage: if the whole store (bytes of its keys and values) would be over the quota it raises and nothing is set."""
    after = upsert(base, items, ["key"])
    size = F.octet_length("key") + F.coalesce(F.octet_length(F.col("value").cast("string")), F.lit(0))
    whole = after.agg(F.coalesce(F.sum(size), F.lit(0)).alias("whole"))  # one row
    ok = F.when(F.col("whole") <= quota, F.col("value")).otherwise(F.raise_error(F.lit("quota exceeded")).cast(after.schema["value"].dataType))
    return after.crossJoin(F.broadcast(whole)).withColumn("value", ok).drop("whole")


def remove_items(base: DataFrame, keys: DataFrame) -> DataFrame:
    return delete_many(base, keys, ["key"])


def nth_key(base: DataFrame, n: int) -> DataFrame:
    return base.select("key").orderBy("key").offset(n).limit(1)


def cache_match(cache: DataFrame, requests: DataFrame, on: list[str] = ["url"]) -> DataFrame:
    """Exact request; null where nothing is cached."""
    return requests.join(cache.withColumnRenamed("value", "response"), on, "left")


def cache_put(cache: DataFrame, responses: DataFrame, on: list[str] = ["url"]) -> DataFrame:
    """A response replaces what was cached for its request."""
    return upsert(cache, responses, on)


def cache_delete(cache: DataFrame, requests: DataFrame, on: list[str] = ["url"]) -> DataFrame:
    """(requests, deleted): whether there was something to delete; ``cache_after`` is the cache without it."""
    return requests.join(cache.select(*on, F.lit(True).alias("d")).distinct(), on, "left").select(*on, F.coalesce("d", F.lit(False)).alias("deleted"))


def cache_after(cache: DataFrame, requests: DataFrame, on: list[str] = ["url"]) -> DataFrame:
    return delete_many(cache, requests, on)


def get_all(config: DataFrame) -> DataFrame:
    """Every (key, value) in key order."""
    return config.select("key", "value").orderBy("key")


def ddl_id(ddl: Column) -> Column:
    """A table's id: SHA-256 of the statement that makes it, in hex."""
    return F.sha2(ddl.cast("binary"), 256)


def compare_and_set(base: DataFrame, swaps: DataFrame) -> DataFrame:
    """(key, value, old, swapped) of the whole store after swaps (key, expected, value), a row for each key.

    A null ``expected`` is met by an absent key.  ``swapped`` is null where
    nothing was asked.  For a single writer.
    """
    s = swaps.select("key", "expected", F.col("value").alias("new"), F.lit(True).alias("asked"))
    j = base.select("key", F.col("value").alias("old")).join(s, "key", "full_outer")
    swapped = F.when(F.col("asked"), F.col("old").eqNullSafe(F.col("expected")))
    j = j.withColumn("swapped", swapped).filter(F.col("old").isNotNull() | F.col("swapped"))
    return j.select("key", F.when(F.col("swapped"), F.col("new")).otherwise(F.col("old")).alias("value"), "old", "swapped")


def read_through(wanted: DataFrame, cached: DataFrame, storage: DataFrame, convert) -> DataFrame:
    """(key, value, hit, error) of wanted keys: from ``cached`` (key, value), else ``storage`` (key, raw) converted.

    ``error`` is NotFound, Convert (``convert`` gives null) or null.  Rows that
    aren't hits and have no error are what to add to the cache.
    """
    c = cached.select("key", F.col("value").alias("kept"), F.lit(True).alias("in_cache"))
    s = storage.select("key", "raw", F.lit(True).alias("stored"))
    j = wanted.select("key").join(c, "key", "left").join(s, "key", "left").withColumn("made", convert(F.col("raw")))
    hit = F.coalesce("in_cache", F.lit(False))
    error = F.when(hit, None).when(F.col("stored").isNull(), "NotFound").when(F.col("made").isNull(), "Convert")
    return j.select("key", F.when(hit, F.col("kept")).otherwise(F.col("made")).alias("value"), hit.alias("hit"), error.alias("error"))


def clear(base: DataFrame) -> DataFrame:
    return base.limit(0)


def create_table(spark, name: str, location: str | None = None) -> None:
    """The document table, if absent."""
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (pk BINARY, sk BINARY, value BINARY) USING parquet{where}")


def attach(spark, name: str, tables: dict[str, str]) -> None:
    """A second schema of that name whose tables are Parquet files elsewhere; what is attached already stays."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")
    for table, path in tables.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}`.`{table}` USING parquet LOCATION '{path}'")


def detach(spark, name: str) -> None:
    """The schema goes; the files of its tables stay."""
    spark.sql(f"DROP DATABASE IF EXISTS `{name}` CASCADE")


def drop_table(spark, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
