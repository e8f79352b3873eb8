import datetime as dt

import pytest
from pyspark.sql import functions as F

from moraine.functions import codecs, floats, ints, lanes
from moraine.functions import text as X
from moraine.operators import fleet, handlers, listing, log, store
from moraine.sources import blobs, paged
from moraine.streaming import tails


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_key_value_golden(spark):
    kv = spark.createDataFrame([("atomics_key", 5)], "key string, value bigint")
    assert store.increment(kv, spark.createDataFrame([("atomics_key", 1)], "key string, delta bigint")).collect() == [("atomics_key", 6)]
    assert [r.key for r in store.list_keys(kv, None, 10).collect()] == ["atomics_key"]
    abc = store.upsert(kv, spark.createDataFrame([(k, 1) for k in ("a1", "b1", "c1")], "key string, value bigint"), ["key"])
    left = store.delete_many(abc, spark.createDataFrame([("a1",), ("c1",), ("none",)], "key string"), ["key"])
    want = spark.createDataFrame([(0, "a1"), (1, "b1"), (2, "c1")], "pos int, key string")
    assert [(r.key, r.value) for r in store.get_many(left, want).orderBy("pos").collect()] == [("a1", None), ("b1", 1), ("c1", None)]
    with pytest.raises(Exception, match="quota"):
        store.set_items(kv, spark.createDataFrame([("x" * 50, 1)], "key string, value bigint"), 20).collect()


def test_deployment_bytes(spark):
    top = b"\xff" * 8 + b"\x01" + b"\x00" * 7
    df = spark.createDataFrame([(bytearray(top),)], "value binary")
    assert tuple(df.select(store.decode_deployment(F.col("value")).alias("d")).first().d) == (2**64 - 1, 1)
    with pytest.raises(Exception, match="16 bytes"):
        spark.createDataFrame([(bytearray(15),)], "value binary").select(store.decode_deployment(F.col("value"))).collect()


def test_liveness_at_the_timeout(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t), (2, t - dt.timedelta(seconds=6)), (3, t - dt.timedelta(seconds=5.999999))]
    s = spark.createDataFrame(rows, "host int, received_at timestamp")
    assert {r.host: r.a for r in s.select("host", fleet.alive(F.lit(t), F.col("received_at")).alias("a")).collect()} == {1: True, 2: False, 3: True}


def test_log_shapes(spark):
    dense = spark.createDataFrame([(i, i * 10) for i in (0, 1, 2)], "seq bigint, value bigint")
    gap = spark.createDataFrame([(1, 10), (3, 30)], "seq bigint, value bigint")
    assert [r.seq for r in log.slice_after(dense, 1).collect()] == [1, 2]
    assert [r.seq for r in log.slice_after(gap, 1).collect()] == [3] and log.slice_after(gap, 2).count() == 0
    with pytest.raises(ValueError):
        log.slice_after(gap, 3)
    assert tuple(log.ends(gap).first()) == (3, 2, False)
    assert [tuple(r) for r in log.gaps(gap).collect()] == [(1, 1)]
    far = spark.createDataFrame([(i,) for i in (-7, 0, 1, 2, 9, 10, 10, 35, None)], "seq bigint")
    for span in (1, 3, 10, 1000):
        assert sorted(tuple(r) for r in log.gaps(far, span).collect()) == [(-7, 6), (2, 6), (10, 24)]
    hosts = spark.createDataFrame([(1, 0), (2, 3)], "host int, deployment_id bigint")
    assert {r.host: r.updates for r in log.deltas(hosts, gap).collect()} == {1: [10, 30], 2: []}


def test_addresses(spark):
    ips = spark.createDataFrame([(x,) for x in ("10.0.0.10", "::1", "10.0.0.9", "10.0.0.9", None, "fe80::1")], "ip string")
    assert [r.ip for r in fleet.address_set(ips).collect()] == ["10.0.0.9", "10.0.0.10", "::1", "fe80::1"]


def test_tagged_json_golden(spark):
    got = one(spark, X.tagged(F.lit("Unit")), X.tagged(F.lit("Newtype"), F.lit("42")), X.tagged(F.lit("Tuple"), X.json_of(F.lit("1"), X.json_string(F.lit('a"b')))), X.tagged(F.lit("Struct"), F.to_json(F.struct(F.lit(1).alias("x"), F.lit("t").alias("y")))))
    assert got == ('{"t":"Unit","v":null}', '{"t":"Newtype","v":42}', '{"t":"Tuple","v":[1,"a\\"b"]}', '{"t":"Struct","v":{"x":1,"y":"t"}}')


def test_query_string_golden(spark):
    m = one(spark, X.parse_query(F.lit("a=hello&b=5&c=true&d=foo&d=bar&e&f=x%3Dy")))[0]
    assert m == {"a": ["hello"], "b": ["5"], "c": ["true"], "d": ["foo", "bar"], "e": [""], "f": ["x=y"]}


def test_text(spark):
    assert one(spark, X.btoa(F.lit("a" * 100 + "é")), X.btoa(F.lit("€")), X.atob(F.lit("YWI=")), X.atob(F.lit("a"))) == ("YWFh" * 33 + "Yek=", None, "ab", None)
    assert one(spark, X.common_prefix(F.array(F.lit("a/b/c"), F.lit("a/b/d"))), X.common_prefix(F.array(F.lit("a"), F.lit("b"))), X.pad_start(F.lit("abcd"), 2), X.at(F.lit("abc"), 5)) == ("a/b/", "", "abcd", None)
    assert one(spark, X.list_format(F.array(F.lit("a"), F.lit("b"), F.lit("c"))), X.percent_encode(F.lit("a b!")), X.date_utc(F.lit(1970), F.lit(0), F.lit(1), F.lit(0), F.lit(0), F.lit(1.5))) == ("a, b, and c", "a%20b!", 1500)
    assert one(spark, codecs.domain_to_ascii(F.lit("münchen.de")), codecs.domain_to_ascii(F.lit("a..b"))) == ("xn--mnchen-3ya.de", "")


def test_integer_goldens(spark):
    b = lambda x: F.lit(x).cast("bigint")
    assert one(spark, ints.popcnt(b(-1), 8), ints.clz(b(0), 8), ints.clz(b(1), 64), ints.ctz(b(8), 64), ints.cls(b(-1), 8), ints.bitrev(b(1), 8), ints.bswap(b(0x0102), 16)) == (8, 8, 63, 3, 7, -128, 0x0201)
    assert one(spark, ints.iadd(b(2**63 - 1), b(1), 64), ints.avg_round(b(-1), b(0), 8), ints.srem(b(-128), b(-1), 8), ints.rotl(b(-128), b(1), 8), ints.smulhi(b(2**62), b(4), 64), ints.sshr(b(-2), b(1), 64)) == (-(2**63), -128, 0, 1, 1, -1)
    assert one(spark, ints.udiv(b(-1), b(2), 64), ints.udiv(b(1), b(0), 8), ints.ushr(b(-1), b(60), 64), ints.ireduce(b(300), 8)) == (2**63 - 1, None, 15, 44)


def test_float_goldens(spark):
    nan, inf = float("nan"), float("inf")
    got = one(spark, floats.fmin(F.lit(nan), F.lit(1.0)), floats.fdiv(F.lit(1.0), F.lit(0.0)), floats.fdiv(F.lit(-1.0), F.lit(0.0)), floats.nearest(F.lit(2.5)), floats.trunc(F.lit(-1.5)), floats.to_sint_sat(F.lit(nan), 64), floats.to_sint_sat(F.lit(1e30), 64), floats.to_uint_sat(F.lit(1e30), 64), floats.fcmp("eq", F.lit(nan), F.lit(nan)))
    assert got[0] != got[0] and got[1:] == (inf, -inf, 2.0, -1.0, 0, 2**63 - 1, 2**64 - 1, False)
    assert one(spark, lanes.unarrow(F.array(F.lit(300), F.lit(-3)), 8), lanes.uwiden_low(F.array(F.lit(-1), F.lit(5)), 8)) == ([255, 0], [255])


def test_listing(spark):
    df = spark.createDataFrame([(1, "A"), (2, None), (3, "Z")], "id int, s string")
    assert [r.x for r in df.select(listing.open_enum(F.col("s"), ["A"]).alias("x"), "id").orderBy("id").collect()] == ["A", None, "UNKNOWN"]
    with pytest.raises(ValueError):
        listing.list_request(df, "list_drgs", "id", route_type="x")
    assert [r.id for r in listing.page(df, "id", 1, (1,)).collect()] == [2]


def pages(name, token):
    items = [{"id": f"{name}{i}", "name": None} for i in range(5)]
    at = int(token or 0)
    return items[at : at + 2], str(at + 2) if at + 2 < 5 else None


def test_paged_source(spark):
    spark.dataSource.register(paged.PagedSource)
    df = spark.read.format("paged").option("fetch", "tests.test_operators:pages").option("lists", "a,b").load()
    assert sorted(r.id for r in df.collect()) == [f"{x}{i}" for x in "ab" for i in range(5)]


def test_blobs(spark, tmp_path):
    assert blobs.read_json_blob(spark, str(tmp_path / "none")).count() == 0
    blobs.write_json_blob(spark.createDataFrame([("a", "1"), ("b", "x")], "key string, value string"), str(tmp_path / "blob"))
    assert {r.key: r.value for r in blobs.read_json_blob(spark, str(tmp_path / "blob")).collect()} == {"a": "1", "b": "x"}
    euro = "€".encode()
    c = spark.createDataFrame([(1, 2, bytearray(euro[1:])), (1, 1, bytearray(euro[:1]))], "stream_id int, seq int, chunk binary")
    assert blobs.consume(c).first().text == "€"
    with pytest.raises(KeyError, match="B, C"):
        blobs.load_env("A=1", "", ["A", "B", "C"])
    assert bytes(one(spark, blobs.blob_slice(F.lit(bytearray(b"hello")), -3, 99))[0]) == b"llo"


def test_typescript():
    from pyspark.sql.types import _parse_datatype_string  # noqa: F401
    from pyspark.sql import types as T

    t = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("tags", T.ArrayType(T.StringType()), True)])
    assert codecs.typescript(t) == "{ id: number; tags?: string[] }" and codecs.split_required(t) == (["id"], ["tags"])


def test_dead_letters_in_order(spark):
    m = spark.createDataFrame([("test",)], "value string")
    out = tails.route_letters(m, lambda k: F.lit(True), ["queue_failed/a", "queue_failed/b"]).orderBy("to_pos").collect()
    assert [(r.to_key, r.value, r.attempts) for r in out] == [("queue_failed/a", "test", 3), ("queue_failed/b", "test", 3)]


def test_compare_and_set(spark):
    kv = spark.createDataFrame([("a", 1), ("b", 2)], "key string, value bigint")
    swaps = spark.createDataFrame([("a", 1, 5), ("b", 1, 5), ("c", None, 5), ("d", 1, 5)], "key string, expected bigint, value bigint")
    got = {r.key: (r.value, r.old, r.swapped) for r in store.compare_and_set(kv, swaps).collect()}
    assert got == {"a": (5, 1, True), "b": (2, 2, False), "c": (5, None, True)}
    assert store.clear(kv).count() == 0


def test_read_through(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = store.read_through(df([("a",), ("b",), ("c",), ("d",)], "key string"), df([("a", 1)], "key string, value bigint"), df([("a", "9"), ("b", "2"), ("c", "x")], "key string, raw string"), lambda raw: raw.try_cast("bigint"))
    assert {r.key: (r.value, r.hit, r.error) for r in out.collect()} == {"a": (1, True, None), "b": (2, False, None), "c": (None, False, "Convert"), "d": (None, False, "NotFound")}


def test_document_table(spark, tmp_path):
    store.create_table(spark, "docs_made", f"file://{tmp_path}/docs")
    store.create_table(spark, "docs_made", f"file://{tmp_path}/docs")
    assert spark.table("docs_made").columns == ["pk", "sk", "value"]
    store.drop_table(spark, "docs_made")
    store.drop_table(spark, "docs_made")
    assert not spark.catalog.tableExists("docs_made")


def test_handlers(spark):
    with pytest.raises(TypeError):
        handlers.respond("no function")
    df = spark.createDataFrame([("1",), ("x",), (None,)], "s string").select("s", handlers.respond(lambda s: int(s) + 1)(F.col("s")).alias("r"))
    assert {r.s: tuple(r.r) for r in df.collect()} == {"1": (200, "2"), "x": (500, None), None: (500, None)}
    assert one(spark, handlers.broken_limit(F.lit(131072), F.lit(0)), handlers.broken_limit(F.lit(131073), F.lit(0)), handlers.broken_limit(F.lit(1), F.lit(104857601))) == (None, "headers", "body")


def test_bitcasts(spark):
    got = one(spark, floats.bitcast(F.lit(1.0), "bigint"), floats.bitcast(F.lit(-0.0).cast("float"), "int"), floats.bitcast(F.lit(0x3F800000), "float"), floats.bitcast(F.lit(None).cast("double"), "bigint"), floats.bitcast(F.lit(2**63 - 1), "double"))
    assert got[:4] == (0x3FF0000000000000, -(2**31), 1.0, None) and got[4] != got[4]


def test_queue(spark, tmp_path):
    q = tails.Queue(spark, f"file://{tmp_path}/queue", f"file://{tmp_path}/state", "value string")
    got = []
    sent = q.enqueue(spark.createDataFrame([("test",)], "value string"))
    q.listen(lambda df, batch: got.extend(r.value for r in df.collect()))
    q.listen(lambda df, batch: got.extend(r.value for r in df.collect()))
    assert sent["ok"] and sent["versionstamp"] is not None and got == ["test"]
    q.close()
    with pytest.raises(RuntimeError, match="Queue already closed"):
        q.listen(print)


def test_gauges(spark):
    from pyspark.sql import Observation

    seen = Observation("hosts")
    assert tails.with_gauges(spark.range(5), seen, hosts=F.count(F.lit(1)), last=F.max("id")).count() == 5
    assert seen.get == {"hosts": 5, "last": 4}


def test_entries_and_tags(spark):
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), F.lit(v).alias("v"))
    assert one(spark, X.from_entries(F.array(pair("a", 1), pair("b", 2), pair("a", 3))), X.external_tag(F.lit("Unit")), X.external_tag(F.lit("N"), F.lit("1"))) == ({"b": 2, "a": 3}, '"Unit"', '{"N":1}')


def test_include_exclude_with_null_versions(spark):
    items = spark.createDataFrame([("a", None), ("a", 1), ("b", None), ("b", 2)], "name string, version int")
    rows = [("INCLUDE", "a", None, None), ("INCLUDE", None, "b", None), ("EXCLUDE", "b", None, None)]
    got = listing.include_exclude(items, spark.createDataFrame(rows, "kind string, name string, pattern string, version int"))
    assert sorted(got.collect(), key=str) == sorted([("a", None), ("a", 1)], key=str)
