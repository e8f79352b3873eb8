"""Blobs, configuration, paged lists, replicas and probes, written to and read from the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import handlers
from ..sources import blobs, paged
from .registry import query, table
from .streams import work_dir


def _regions(spark, sf_dir):
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("key"), F.col("r_name").alias("value"))


@query("SELECT cast(r_regionkey AS varchar) AS key, r_name AS value FROM region")
def source_json_blob(spark, sf_dir):
    path = work_dir(spark, "blob")
    blobs.write_json_blob(_regions(spark, sf_dir), path)
    return blobs.read_json_blob(spark, path)


@query("SELECT r_regionkey AS region, r_name AS name FROM region WHERE r_regionkey = 1")
def source_config(spark, sf_dir):
    path = work_dir(spark, "config")
    table(spark, sf_dir, "region").filter("r_regionkey = 1").select(F.to_json(F.struct(F.col("r_regionkey").alias("region"), F.col("r_name").alias("name"))).alias("value")).write.text(path)
    return blobs.read_config(spark, path, T.StructType([T.StructField("region", T.IntegerType()), T.StructField("name", T.StringType())]))


@query("SELECT r_name AS key, CASE WHEN r_regionkey = 1 THEN 'overlaid' ELSE cast(r_regionkey AS varchar) END AS value FROM region")
def source_env(spark, sf_dir):
    """Settings of a base file with a mode's over them."""
    rows = table(spark, sf_dir, "region").collect()  # settings are a few lines
    base = "# regions\n" + "\n".join(f'export {r["r_name"]}="{r["r_regionkey"]}"' for r in rows)
    overlay = "\n".join(f'{r["r_name"]} = overlaid' for r in rows if r["r_regionkey"] == 1)
    found = blobs.load_env(base, overlay, [r["r_name"] for r in rows])
    return spark.createDataFrame(sorted(found.items()), "key string, value string")


LISTED, PER_PAGE = 25, 10


def pages(name: str, token: str | None):
    """A list of 25 items in pages of 10."""
    begin = int(token or 0)
    end = min(begin + PER_PAGE, LISTED)
    return [{"id": f"{name}-{i}", "name": f"item {i}"} for i in range(begin, end)], str(end) if end < LISTED else None


@query("SELECT l || '-' || i AS id, 'item ' || i AS name FROM (SELECT unnest(['hosts', 'images']) AS l), range(25) r(i)")
def source_paged_list(spark, sf_dir):
    spark.dataSource.register(paged.PagedSource)
    return spark.read.format("paged").option("fetch", f"{__name__}:pages").option("lists", "hosts,images").load()


@query("SELECT t AS target, 'ALPHA' AS text FROM (SELECT unnest(['a', 'b']) AS t)")
def source_replicate(spark, sf_dir):
    d = work_dir(spark, "replicas")
    spark.range(1).select(F.lit("ALPHA").alias("value")).write.text(f"{d}/source")
    blobs.replicate(spark, f"{d}/source/*.txt", [f"{d}/a", f"{d}/b"])
    got = [spark.read.text(f"{d}/{t}").select(F.lit(t).alias("target"), F.col("value").alias("text")) for t in ("a", "b")]
    return got[0].union(got[1])


@query("SELECT r_regionkey, r_name, t AS target FROM region, (SELECT unnest(['a', 'b']) AS t)")
def source_replicated_tables(spark, sf_dir):
    """Parquet files copied byte for byte are tables again."""
    d = work_dir(spark, "replicated")
    table(spark, sf_dir, "region").coalesce(1).write.parquet(f"{d}/source")
    blobs.replicate(spark, f"{d}/source/*.parquet", [f"{d}/a", f"{d}/b"])
    got = [spark.read.parquet(f"{d}/{t}").select("r_regionkey", "r_name", F.lit(t).alias("target")) for t in ("a", "b")]
    return got[0].union(got[1])


@query("SELECT r_regionkey, r_name FROM region")
def source_file_copied(spark, sf_dir):
    """A file through a stream to another."""
    d = work_dir(spark, "copied")
    table(spark, sf_dir, "region").coalesce(1).write.parquet(f"{d}/source")
    for r in spark.read.format("binaryFile").load(f"{d}/source/*.parquet").select("path").collect():
        blobs.copy_file(r["path"], f"{d}/copy/{r['path'].rsplit('/', 1)[1]}")
    return spark.read.parquet(f"{d}/copy").select("r_regionkey", "r_name")


HOSTS, HOSTS_PER_PAGE = 30, 7


def host_pages(name: str, token: str | None):
    """30 hosts in pages of 7."""
    begin = int(token or 0)
    end = min(begin + HOSTS_PER_PAGE, HOSTS)
    return [{"id": f"host-{i}", "ip": f"10.0.0.{i}", "role": None if i % 3 == 0 else "worker" if i % 3 == 1 else "leader"} for i in range(begin, end)], str(end) if end < HOSTS else None


@query("SELECT 'host-' || i AS id, '10.0.0.' || i AS ip, CASE i % 3 WHEN 1 THEN 'worker' WHEN 2 THEN 'leader' END AS role FROM range(30) r(i)")
def source_hosts(spark, sf_dir):
    spark.dataSource.register(paged.PagedSource)
    return spark.read.format("paged").option("fetch", f"{__name__}:host_pages").option("lists", "hosts").option("schema", paged.HOSTS).load()


@query("SELECT o_orderkey FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY")
def source_unexpired(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderdate", "created_at")
    now = o.agg(F.max("created_at").alias("now"))
    return blobs.unexpired(o.crossJoin(F.broadcast(now)), F.col("now"), 30).select("o_orderkey")


@query("SELECT p_partkey, substr(p_name, 2, 3) AS middle, right(p_name, 3) AS tail, '' AS nothing FROM part")
def blob_slices(spark, sf_dir):
    b = F.col("p_name").cast("binary")
    text = lambda start, end: blobs.blob_slice(b, start, end).cast("string")
    return table(spark, sf_dir, "part").select("p_partkey", text(1, 4).alias("middle"), text(-3, 10_000).alias("tail"), text(3, 2).alias("nothing"))


def answer(host: str):
    """What a host says: by its number good, shutting down, an error status, or no answer at all."""
    k = int(host) % 4
    if k == 3:
        raise TimeoutError(host)
    return (200, "good") if k == 0 else (200, "graceful_shutting_down") if k == 1 else (503, "good")


@query("SELECT s_suppkey AS host, CASE s_suppkey % 4 WHEN 0 THEN 'Good' WHEN 1 THEN 'GracefulShuttingDown' END AS status FROM supplier")
def source_probe(spark, sf_dir):
    ask = handlers.probe(answer)
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("host"), X.health_status(ask(F.col("s_suppkey").cast("string"))).alias("status"))
