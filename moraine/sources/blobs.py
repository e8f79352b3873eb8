"""JSON blobs and files: whole-object reads and writes, configuration, byte streams, event streams, replicas."""

from __future__ import annotations

import io
import os
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException


def read_json_blob(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) entries of the JSON object at ``path``; a missing one is an empty map, other errors are raised."""
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "key string, value string")
    # values stay JSON text, so the map has one type whatever it holds
    return raw.select(F.explode(F.from_json("value", "map<string,string>", {"mode": "FAILFAST"}))).select("key", "value")


#: Bytes of an object's keys and values, which one task puts together.
BLOB_BYTES = 256_000_000


def write_json_blob(entries: DataFrame, path: str, most_bytes: int = BLOB_BYTES) -> None:
    """Overwrites the object; entries (key, value) are one map, and more than ``most_bytes`` of them are an error."""
    size = entries.agg(F.sum(F.coalesce(F.octet_length("key"), F.lit(0)) + F.coalesce(F.octet_length("value"), F.lit(0)))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"an object has at most {most_bytes} bytes, not {size}")
    pairs = entries.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("m"))
    pairs.select(F.to_json("m").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_config(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Strict JSON: malformed text, or a field the schema lacks, is an error."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)
    unknown = set(spark.read.option("multiLine", True).json(path).columns) - set(schema.names)
    if unknown:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    return df


def parse_env(text: str) -> dict[str, str]:
    """KEY=value lines; comments, blank lines and quotes around a value go."""
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith("#") and "=" in line:
            k, v = line.split("=", 1)
            v = v.strip()
            out[k.strip().removeprefix("export ").strip()] = v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "'\"" else v
    return out


def load_env(base: str, overlay: str, required: list[str]) -> dict[str, str]:
    """Base settings with a mode's over them; all missing required keys are told at once."""
    found = parse_env(base) | parse_env(overlay)
    if missing := [k for k in required if not found.get(k)]:
        raise KeyError(f"missing: {', '.join(missing)}")
    return found


def consume(chunks: DataFrame) -> DataFrame:
    """(stream_id, bytes, text) of chunks (stream_id, seq, chunk): joined as bytes first, so characters across chunks survive."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda x: F.hex(x["chunk"]))
    return chunks.groupBy("stream_id").agg(F.unhex(F.array_join(ordered, "")).alias("bytes")).withColumn("text", F.decode("bytes", "UTF-8"))


def event_data(lines: Column) -> Column:
    """Data of the events of a text/event-stream: lines of an event joined, events parted by blank lines."""
    events = F.filter(F.split(F.regexp_replace(lines, "\r\n?", "\n"), "\n\n+"), lambda e: e.rlike(r"(?m)^data:"))
    return F.transform(events, lambda e: F.array_join(F.transform(F.filter(F.split(e, "\n"), lambda x: x.startswith("data:")), lambda x: F.regexp_replace(x, "^data: ?", "")), "\n"))


def blob_slice(b: Column, start: int, end: int) -> Column:
    """Bytes from start to end, negative ones counted from the end, clamped."""
    n = F.octet_length(b)
    at = lambda i: F.least(F.lit(i), n) if i >= 0 else F.greatest(n + i, F.lit(0))
    return F.substring(b, at(start) + 1, F.greatest(at(end) - at(start), F.lit(0)))


#: Bytes that a copy holds at once.
COPY_BYTES = 65_536


def _opened(uri: str):
    """(file system, path) of a URI or a local path."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri))


def copy_stream(read, uri: str, size: int = COPY_BYTES) -> int:
    """The bytes of a readable to the object ``uri``, a piece at a time; written under a name of its own and renamed, so that a retry is harmless."""
    fs, path = _opened(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part, n = f"{path}.{uuid.uuid4().hex}.part", 0
    with fs.open_output_stream(part) as out:
        while piece := read(size):
            out.write(piece)
            n += len(piece)
    fs.move(part, path)
    return n


def copy_file(source: str, target: str) -> int:
    """A file through a stream to another, with the bytes as they are; gives their number."""
    fs, path = _opened(source)
    with fs.open_input_stream(path) as src:
        return copy_stream(src.read, target)


def replicate(spark: SparkSession, source: str, targets: list[str]) -> list:
    """Files, byte for byte and under their own names, to every target folder; (path, n_bytes) of what was written.

    A file is read once; its copies are tasks' side effects under fixed names,
    and any failure is raised.  binaryFile bounds a file to 2 GB.
    """

    def run(batches):
        for batch in batches:
            done = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                for t in targets:
                    to = f"{t.rstrip('/')}/{path.rsplit('/', 1)[1]}"
                    done.append((to, copy_stream(io.BytesIO(content).read, to)))
            yield pa.RecordBatch.from_pydict({"path": [d[0] for d in done], "n_bytes": pa.array([d[1] for d in done], pa.int64())})

    done = spark.read.format("binaryFile").load(source).select("path", "content").mapInArrow(run, "path string, n_bytes long").collect()
    for name in _empty_files(spark, source):  # a scan has no part for them
        done += [Row(path=to, n_bytes=copy_stream(io.BytesIO().read, to)) for to in (f"{t.rstrip('/')}/{name}" for t in targets)]
    return done


def _empty_files(spark: SparkSession, source: str) -> list[str]:
    """Names of the files of no bytes at a path, folder or pattern."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(path) or []
    files = [x for s in found for x in (fs.listStatus(s.getPath()) if s.isDirectory() else [s])]
    return [f.getPath().getName() for f in files if f.isFile() and not f.getLen() and f.getPath().getName()[0] not in "._"]


def created(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """A stream of (path, modificationTime, length) of the objects that come into a folder, each once."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", pattern).load(folder)
    return stream.select("path", "modificationTime", "length")


def unexpired(objects: DataFrame, now: Column, days: int = 1) -> DataFrame:
    return objects.filter(F.col("created_at") > now - F.expr(f"interval {days} days"))
