"""Helpers shared by the operators: the shared folder, hashing, word splitting, guarded joins."""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes of their strings, up to which a side may be broadcast.
BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 32_000_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where that is unset a temporary folder is made, of a local master alone:
    on a cluster each machine would write to a disk of its own, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="moraine-shared-")
        atexit.register(shutil.rmtree, root.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/moraine/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Deletes what this library wrote to the shared folder; for the end of a job, once no DataFrame of it is read any more."""
    remove(spark, f"{shared_root(spark)}/moraine")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of this library's that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets go of shuffle files that nothing refers to any more: the driver's collector has executors delete them."""
    gc.collect()
    spark._jvm.System.gc()


def hand_back(spark: SparkSession) -> None:
    """``release``, and executors hand back heap that they don't use.

    An executor's heap else stays as large as it once was, and many steps one
    after another take it to its limit, beside the Python workers and what
    Java has outside of the heap.
    """
    release(spark)
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # there the driver is the executor
        n = spark.sparkContext.defaultParallelism
        spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives the loss of any executor."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def is_small(df: DataFrame) -> bool:
    """Whether ``df`` may be broadcast: its rows and the bytes of its strings have been found to be bounded."""
    width = sum((F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in df.schema if f.dataType.simpleString() in ("string", "binary")), F.lit(0))
    rows, size = df.select(width.cast("long").alias("w")).limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.sum("w")).first()
    return rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def join_small(df: DataFrame, small: DataFrame, on, how: str = "left") -> DataFrame:
    """Join; ``small`` is broadcast if ``is_small`` finds that it may be."""
    return df.join(F.broadcast(small) if is_small(small) else small, on, how)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone, unlike lower()."""
    return F.translate(c, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of maximal runs of other than space and control 9 to 13; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def text_hash(text: Column | None = None) -> Column:
    """Tells rows of one doc_id apart; null and empty texts are alike."""
    return F.xxhash64(F.coalesce(F.col("text") if text is None else text, F.lit("")))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A column of strings as UTF-8 bytes; null is empty."""
    col = batch.column(name)
    return [b"" if x is None else x for x in col.cast(pa.binary()).to_pylist()]


# Raw arrays in the shared folder ------------------------------------------------------------------


def _fs(uri: str):
    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + os.path.abspath(uri)
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def put_bytes(uri: str, data) -> None:
    """Write a file whole: under a name of its own first, then renamed, so that retried tasks are harmless."""
    fs, path = _fs(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    temp = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(temp) as out:
        out.write(data)
    fs.move(temp, path)


def get_bytes(uri: str) -> bytes:
    """A file of put_bytes."""
    fs, path = _fs(uri)
    with fs.open_input_stream(path) as src:
        return src.read()


#: Copies of remote arrays that this process maps, all of one folder: tasks of a worker share them.
_COPIES: dict[str, np.ndarray] = {}


def map_array(uri: str, dtype) -> np.ndarray:
    """Memory-map a raw array.

    A remote file can't be mapped where it is: each worker process copies those
    it searches, once for all its tasks, and unlinks the copy while mapped.
    """
    if uri in _COPIES:
        return _COPIES[uri].view(dtype)
    fs, path = _fs(uri)
    size = fs.get_file_info(path).size
    if not size:
        return np.empty(0, dtype)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with tempfile.NamedTemporaryFile(prefix="moraine-map-") as local:
        with fs.open_input_stream(path) as src:
            shutil.copyfileobj(src, local)
        local.flush()
        if any(os.path.dirname(x) != os.path.dirname(uri) for x in _COPIES):
            _COPIES.clear()
        _COPIES[uri] = np.memmap(local.name, np.uint8, "r")
        return _COPIES[uri].view(dtype)
