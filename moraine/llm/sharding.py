"""Sharding by fixed virtual slots (DataFrame operations only).

Records are hashed into thousands of fixed slots, bytes are summed per slot,
and a small versioned table maps every slot, empty ones too, to a shard.  The
map is stored (``save_map``, ``load_map``), a version a folder; new records go by
the stored map, and only an edit (``grow``, ``rebalance``) moves slots, as a new
version beside the old ones.  A record never changes its slot.

Law: ``bytes``.  A first map deals slots, heaviest first, to the shard with the
fewest bytes.

Defined results: a null text counts one byte (its size is 0 + 1); texts of any
length are only measured; null ids are hashed like any value; repeated rows are
numbered, so that copies spread over the slots; slots of equal bytes go by
their number, shards of equal load by theirs; an empty table gives an empty
result (and a map of empty slots); columns other than doc_id and text are not
looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, new_dir

N_SLOTS = 4096
N_SHARDS = 16
#: Copies of one row that a single task numbers.
COPY_BLOCK = 100_000


def record_keys(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and copy (0, 1, ... among rows alike in all three).

    Rows alike are counted (with map-side sums) and then numbered in blocks, so
    a row that makes up a third of the table doesn't land in one task.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    counted = keys.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    blocks = counted.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPY_BLOCK).cast("long"))))
    last = F.least(F.col("start") + COPY_BLOCK, F.col("n")) - 1
    return blocks.select("doc_id", "size", "text_crc32", F.explode(F.sequence("start", last)).alias("copy"))


def slot_of(n_slots: int, *cols: Column) -> Column:
    """The fixed slot of a record; depends on its key columns alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(n_slots)).cast("int")


def slot_bytes(records: DataFrame) -> DataFrame:
    """Bytes and rows of each slot that has any: n_slots rows at most."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


#: The stored map.
MAP = "version int, virtual_slot int, shard int, bytes long, rows long"


def all_slots(stats: DataFrame, n_slots: int) -> DataFrame:
    """``stats`` with a row of no bytes for each slot that has none."""
    slots = stats.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return slots.join(F.broadcast(stats), "virtual_slot", "left").select("virtual_slot", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))


def first_map(stats: DataFrame, n_shards: int) -> DataFrame:
    """Version 1 of the map: slots by falling bytes, each to the lightest shard so far.

    The fold runs over one array of at most n_slots entries.
    """
    item = F.struct((-F.col("bytes")).alias("neg"), F.col("virtual_slot"), F.col("bytes"), F.col("rows"))
    every = stats.agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), n_shards).alias("loads"), F.expr("cast(array() as array<int>)").alias("picks"))

    def step(state: Column, x: Column) -> Column:
        k = (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        loads = F.transform(state["loads"], lambda load, i: F.when(i == k, load + x["bytes"]).otherwise(load))
        return F.struct(loads.alias("loads"), F.array_append(state["picks"], k).alias("picks"))

    picks = every.select("items", F.aggregate("items", start, step)["picks"].alias("picks"))
    rows = picks.select(F.explode(F.arrays_zip("items", "picks")).alias("z"))
    return rows.select(F.lit(1).alias("version"), F.col("z.items.virtual_slot").alias("virtual_slot"), F.col("z.picks").alias("shard"), F.col("z.items.bytes").alias("bytes"), F.col("z.items.rows").alias("rows"))


def save_map(slot_map: DataFrame, path: str) -> int:
    """Stores the map as a version of its own below ``path`` and gives its number; a version that is there stays as it is (an error)."""
    slot_map = slot_map.selectExpr("cast(version as int) version", "virtual_slot", "shard", "bytes", "rows")
    made = materialize(slot_map, "slot-map")
    version = made.agg(F.max("version")).first()[0]
    made.coalesce(1).write.parquet(f"{path}/map-{version:06d}")
    return version


def load_map(spark, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the latest if none is named."""
    name = "map-*" if version is None else f"map-{version:06d}"
    found = spark.read.schema(MAP).parquet(f"{path}/{name}")
    return found if version is not None else found.join(found.agg(F.max("version").alias("version")), "version", "left_semi")


def grow(slot_map: DataFrame, n_shards: int) -> DataFrame:
    """The next version for ``n_shards`` + 1 shards: slots move into the new shard alone.

    Each old shard gives, lightest slots last, what it holds above the new mean.
    """
    mean = F.sum("bytes").over(Window.partitionBy(F.lit(1))) / F.lit(n_shards + 1)
    of_shard = Window.partitionBy("shard")
    upto = of_shard.orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    moved = slot_map.withColumn("kept", F.sum("bytes").over(upto)).withColumn("mean", mean)
    shard = F.when(F.col("kept") > F.col("mean"), F.lit(n_shards)).otherwise(F.col("shard"))
    return moved.select((F.col("version") + 1).alias("version"), "virtual_slot", shard.cast("int").alias("shard"), "bytes", "rows")


def rebalance(slot_map: DataFrame, stats: DataFrame, n_shards: int) -> DataFrame:
    """The next version, for bytes that have changed: shards above the mean give slots, the others keep all of theirs.

    ``stats``: bytes and rows of all slots now.  A shard keeps its heaviest
    slots up to the mean; what is over goes, heaviest first, to the lightest
    shard so far.  The fold runs over one array of at most n_slots entries.
    """
    now = slot_map.select("version", "virtual_slot", "shard").join(stats, "virtual_slot")
    upto = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    mean = F.sum("bytes").over(Window.partitionBy(F.lit(1))) / F.lit(n_shards)
    marked = now.withColumn("upto", F.sum("bytes").over(upto)).withColumn("over", F.col("upto") > mean)
    item = F.struct("over", (-F.col("bytes")).alias("neg"), "virtual_slot", "shard", "bytes", "rows", "version")
    every = marked.agg(F.array_sort(F.collect_list(item)).alias("items"))  # what stays comes first
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), n_shards).alias("loads"), F.expr("cast(array() as array<int>)").alias("picks"))

    def step(state: Column, x: Column) -> Column:
        lightest = (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        k = F.when(x["over"], lightest).otherwise(x["shard"])
        loads = F.transform(state["loads"], lambda load, i: F.when(i == k, load + x["bytes"]).otherwise(load))
        return F.struct(loads.alias("loads"), F.array_append(state["picks"], k).alias("picks"))

    picks = every.select("items", F.aggregate("items", start, step)["picks"].alias("picks"))
    z = picks.select(F.explode(F.arrays_zip("items", "picks")).alias("z")).select("z.items", "z.picks")
    return z.select((F.col("items.version") + 1).alias("version"), F.col("items.virtual_slot").alias("virtual_slot"), F.col("picks").alias("shard"), F.col("items.bytes").alias("bytes"), F.col("items.rows").alias("rows"))


def keyed(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """The records with their fixed slots, written to the shared folder."""
    records = record_keys(docs).withColumn("virtual_slot", slot_of(n_slots, F.col("doc_id"), F.col("size"), F.col("text_crc32"), F.col("copy")))
    return materialize(records, "shard-records")


def placed(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Records by a map: doc_id, size, text_crc32, law, shard, slot (place within the shard, from 0), grown_shard, virtual_slot, map_version."""
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    # both have n_slots rows at most, so their broadcast is bounded by a parameter
    now = slot_map.select("version", "virtual_slot", "shard").join(F.broadcast(slot_bytes(records)), "virtual_slot")
    now = now.withColumn("first_row", F.coalesce(F.sum("rows").over(before), F.lit(0)).cast("long"))
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "copy")) - 1
    joined = records.withColumn("place", place).join(F.broadcast(now.select("version", "virtual_slot", "shard", "first_row")), "virtual_slot")
    return joined.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("first_row") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("virtual_slot"), F.col("version").alias("map_version"),
    )


def assign(docs: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS, path: str | None = None) -> DataFrame:
    """Every record by the latest map stored below ``path``; where there is none, a first one is made of these records and stored.

    Without a ``path`` the map goes to a fresh folder.
    """
    from pyspark.errors import AnalysisException

    spark, records = docs.sparkSession, keyed(docs, n_slots)
    fresh, path = path is None, path or new_dir(spark, "slot-maps")
    if not fresh:
        try:
            return placed(records, load_map(spark, path))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    save_map(first_map(all_slots(slot_bytes(records), n_slots), n_shards), path)
    return placed(records, load_map(spark, path, 1))


def assign_grown(docs: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS, path: str | None = None) -> DataFrame:
    """Every record by the stored map after a shard was added to it: doc_id, size, text_crc32, virtual_slot, shard (before), grown (after), map_version."""
    spark, records = docs.sparkSession, keyed(docs, n_slots)
    path = path or new_dir(spark, "slot-maps")
    old = save_map(first_map(all_slots(slot_bytes(records), n_slots), n_shards), path)
    new = save_map(grow(load_map(spark, path), n_shards), path)
    was = load_map(spark, path, old).select("virtual_slot", "shard")
    now = load_map(spark, path, new).select("virtual_slot", F.col("shard").alias("grown"), F.col("version").alias("map_version"))
    both = was.join(F.broadcast(now), "virtual_slot")
    return records.join(F.broadcast(both), "virtual_slot").select("doc_id", "size", "text_crc32", "virtual_slot", "shard", "grown", "map_version")
