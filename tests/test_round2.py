"""Reaping across batches, retries, tokens, quotas, replicas, remote tables, wide integers and fused floats."""

import datetime as dt
import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from moraine.functions import codecs, floats, ints
from moraine.operators import listing, log, store
from moraine.sources import blobs, paged, remote
from moraine.streaming import tails

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def reaped(spark, tmp_path, batches):
    """What is evicted, batch by batch: each list of (host, seconds) is a file."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = []
    for i, rows in enumerate(batches):
        spark.createDataFrame([(h, at(s)) for h, s in rows], "host bigint, received_at timestamp").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema("host bigint, received_at timestamp").parquet(f"file://{tmp_path}/in")
        got = tails.run_once(tails.reaped(stream), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
        base = int((T0 - dt.datetime(1970, 1, 1)).total_seconds()) * 10**6
        now = sorted((r.host, (r.last_us - base) / 1e6, (r.died_us - base) / 1e6) for r in got.collect())
        out.append(now)
    return out


def test_silent_hosts_are_evicted_in_later_batches(spark, tmp_path):
    assert reaped(spark, tmp_path / "exact", [[(1, 0), (2, 6)]]) == [[(1, 0, 6)]] and reaped(spark, tmp_path / "before", [[(1, 0), (2, 5.999)]]) == [[]]
    got = reaped(spark, tmp_path, [[(1, 0), (2, 0), (2, 4)], [(2, 8)], [(2, 12), (3, 12)], [(3, 17.999), (2, 18)], [(3, 40), (1, 40)]])
    assert got[0] == [] and got[1] == [(1, 0, 6)] == got[2]
    assert got[3] == [(1, 0, 6), (2, 12, 18)], "silent for exactly the timeout is dead"
    assert got[4] == sorted([(1, 0, 6), (2, 12, 18), (2, 18, 24), (3, 17.999, 23.999)])


def test_eviction_does_not_depend_on_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = sorted([(h, round(s, 3)) for h in range(5) for s in np.cumsum([rng.choice([0.5, 2, 5.999, 6, 9]) for _ in range(12)]).tolist()], key=lambda r: r[1])
    want = []
    for h in range(5):
        times = [s for x, s in rows if x == h]
        want += [(h, round(a, 3)) for a, b in zip(times, [*times[1:], rows[-1][1]]) if round(b - a, 3) >= 6]
    for n in (1, 4):
        cuts = [rows[i * len(rows) // n : (i + 1) * len(rows) // n] for i in range(n)]
        got = reaped(spark, tmp_path / str(n), cuts)[-1]
        assert [(h, round(s, 3)) for h, s, _ in got] == sorted(want)


def test_retries_and_dead_letters(spark, tmp_path):
    tries, q = [], tails.Queue(spark, f"file://{tmp_path}/q", f"file://{tmp_path}/s", "value string")

    def fail_twice(df, batch):
        tries.append(batch)
        if len(tries) < 3:
            raise RuntimeError("not yet")

    q.enqueue(spark.createDataFrame([("test",)], "value string"))
    q.listen(fail_twice, backoff_ms=(1, 2))
    assert len(tries) == 3

    def never(df, batch):
        raise RuntimeError("never")

    q.enqueue(spark.createDataFrame([("again",)], "value string"))
    with pytest.raises(Exception, match="never"):
        q.listen(never, backoff_ms=(1,))
    q.listen(never, backoff_ms=(1, 2), dead_letters=[f"file://{tmp_path}/a", f"file://{tmp_path}/b"])
    for k in "ab":
        assert [r.value for r in spark.read.parquet(f"file://{tmp_path}/{k}").collect()] == ["again"]
    with pytest.raises(ValueError):
        tails.ready([])


def test_quota_is_of_the_whole_store(spark):
    kv = lambda rows: spark.createDataFrame(rows, "key string, value string")
    base = kv([("a", "xxxx")])
    assert store.set_items(base, kv([("b", "yyyy")]), 10).count() == 2
    with pytest.raises(Exception, match="quota"):
        store.set_items(base, kv([("b", "yyyyyy")]), 10).collect()
    with pytest.raises(Exception, match="quota"):
        store.set_items(base, kv([("b", "123456"), ("c", "123456")]), 10).collect()
    assert {r.key: r.value for r in store.set_items(base, kv([("a", "123456789")]), 10).collect()} == {"a": "123456789"}


def test_cache(spark):
    cache = spark.createDataFrame([("u", 1), ("v", 2)], "url string, value bigint")
    asked = spark.createDataFrame([("u",), ("w",)], "url string")
    assert {r.url: r.response for r in store.cache_match(cache, asked).collect()} == {"u": 1, "w": None}
    assert {r.url: r.deleted for r in store.cache_delete(cache, asked).collect()} == {"u": True, "w": False}
    assert [r.url for r in store.cache_after(cache, asked).collect()] == ["v"]


def test_slices_of_repeated_numbers(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (3, 3)], "seq bigint, value bigint")
    assert [r.seq for r in log.slice_after(rows, 1).collect()] == [1, 3]
    assert log.slice_after(rows, 3).count() == 0


@pytest.mark.parametrize("span", [1, 4, 1000])
def test_delta_rows(spark, span):
    entries = [(s, s * 10) for s in (-3, 0, 1, 2, 7, 8, 20)]
    rows = spark.createDataFrame(entries, "seq bigint, value bigint")
    hosts = [(1, -100), (2, 0), (3, 7), (4, 20), (5, 10**9)]
    got = log.delta_rows(spark.createDataFrame(hosts, "host int, deployment_id bigint"), rows, span).collect()
    assert sorted(map(tuple, got)) == sorted((h, s, v) for h, d in hosts for s, v in entries if s > d)
    assert {r.host: r.updates for r in log.deltas(spark.createDataFrame(hosts, "host int, deployment_id bigint"), rows, span).collect()} == {h: [v for s, v in entries if s > d] for h, d in hosts}


def test_pages_by_tokens(spark):
    rows = spark.createDataFrame([(i, i % 3, f"n{i % 4}") for i in range(23)], "id int, time_created int, display_name string")
    for sort, order in ((None, "ASC"), ("TIMECREATED", "DESC"), ("DISPLAYNAME", "ASC")):
        seen, token, before = [], None, None
        while True:
            got = listing.list_response(rows, "list_drgs", "id", 5, token, sort, order).orderBy("place").collect()
            assert [r.place for r in got] == list(range(1, len(got) + 1)) and {r.previous_token for r in got} == {token}
            seen += [r.id for r in got]
            before, token = token, got[-1].next_token
            if token is None:
                break
        key = {None: lambda i: i, "TIMECREATED": lambda i: (i % 3, i), "DISPLAYNAME": lambda i: (f"n{i % 4}", i)}[sort]
        assert seen == sorted(range(23), key=key, reverse=order == "DESC") and before is not None


def test_many_patterns(spark, monkeypatch):
    items = spark.createDataFrame([("blue bolt", 1), ("blue gear", 2), ("red", None), ("small", 3), (None, 1)], "name string, version int")
    rows = [("INCLUDE", None, "blue .*", None), ("INCLUDE", "red", None, None), ("EXCLUDE", None, ".*gear", None), ("INCLUDE", "small", None, 4)]
    filters = spark.createDataFrame(rows, "kind string, name string, pattern string, version int")
    want = sorted(map(tuple, listing.include_exclude(items, filters).collect()), key=str)
    monkeypatch.setattr(listing, "MOST_PATTERNS", 1)
    assert sorted(map(tuple, listing.include_exclude(items, filters).collect()), key=str) == want == [("blue bolt", 1), ("red", None)]


def test_copies_are_byte_exact(spark, tmp_path):
    (tmp_path / "in").mkdir()
    data = {f"f{i}.bin": random.Random(i).randbytes(i * 70_000) for i in range(4)}
    for name, b in data.items():
        (tmp_path / "in" / name).write_bytes(b)
    done = blobs.replicate(spark, f"file://{tmp_path}/in", [f"file://{tmp_path}/a", f"file://{tmp_path}/b"])
    assert sorted(r.n_bytes for r in done) == sorted([len(b) for b in data.values()] * 2)
    for t in "ab":
        assert {p.name: p.read_bytes() for p in (tmp_path / t).iterdir()} == data
    assert blobs.copy_file(str(tmp_path / "in" / "f3.bin"), str(tmp_path / "c" / "x.bin")) == 210_000
    assert (tmp_path / "c" / "x.bin").read_bytes() == data["f3.bin"]
    with pytest.raises(Exception):
        blobs.replicate(spark, f"file://{tmp_path}/in", [f"file://{tmp_path}/in/f0.bin/no"])
    with pytest.raises(ValueError, match="at most"):
        blobs.write_json_blob(spark.createDataFrame([("a", "x" * 50)], "key string, value string"), str(tmp_path / "blob"), 20)


def test_remote_tables(spark, tmp_path):
    db = remote.Remote(spark, f"jdbc:derby:{tmp_path}/db;create=true", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    try:
        db.append(spark.range(40).selectExpr("id", "concat('v', id) as val"), "docs")
    except Exception as e:
        if "ClassNotFound" in str(e):
            pytest.skip("no JDBC driver here")
        raise
    back = db.read("docs", "id", 0, 40, 4)
    assert back.rdd.getNumPartitions() == 4 and sorted(r.id for r in back.filter("id >= 30").collect()) == list(range(30, 40))


def hosts(name, token):
    return [{"id": "h", "ip": "10.0.0.1", "role": None}], None


def test_host_source(spark):
    spark.dataSource.register(paged.PagedSource)
    df = spark.read.format("paged").option("fetch", "tests.test_round2:hosts").option("schema", paged.HOSTS).load()
    assert [tuple(r) for r in df.collect()] == [("h", "10.0.0.1", None)]


NUMBERS = [0, 1, -1, 2**63 - 1, -(2**63), 0x0102030405060708, -0x0102030405060708, 2**62, 12345678901234567, 2**32, -(2**32) - 1]


def test_wide_integers(spark):
    rows = [(a, b) for a in NUMBERS for b in NUMBERS]
    a, b, u = F.col("a"), F.col("b"), lambda x: x % 2**64
    s = lambda x: (x + 2**63) % 2**64 - 2**63
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    got = df.select("a", "b", ints.umulhi(a, b, 64).alias("h"), ints.smulhi(a, b, 64).alias("sh"), ints.clz(a, 64).alias("clz"), ints.ctz(a, 64).alias("ctz"), ints.cls(a, 64).alias("cls"), ints.bitrev(a, 64).alias("rev"), ints.bswap(a, 64).alias("swap")).collect()
    for r in got:
        x, y = u(r.a), u(r.b)
        bits = format(x, "064b")
        assert r.h == s(x * y >> 64) and r.sh == r.a * r.b >> 64
        assert r.clz == (bits.index("1") if x else 64) and r.ctz == (bits[::-1].index("1") if x else 64)
        assert r.rev == s(int(bits[::-1], 2)) and r.swap == int.from_bytes(x.to_bytes(8, "little"), "big", signed=True)
        sign = bits[0]
        assert r.cls == len(bits) - len(bits.lstrip(sign)) - 1


@pytest.mark.parametrize("bits", [8, 16, 32])
def test_narrow_bits(spark, bits):
    rng = random.Random(bits)
    values = [0, -1, 1, 2 ** (bits - 1) - 1, -(2 ** (bits - 1))] + [rng.randrange(-(2 ** (bits - 1)), 2 ** (bits - 1)) for _ in range(40)]
    x = F.col("x")
    df = spark.createDataFrame([(v,) for v in values], "x bigint")
    for r in df.select("x", ints.clz(x, bits).alias("clz"), ints.ctz(x, bits).alias("ctz"), ints.bitrev(x, bits).alias("rev"), ints.bswap(x, bits).alias("swap")).collect():
        text = format(r.x % 2**bits, f"0{bits}b")
        s = lambda v: (v + 2 ** (bits - 1)) % 2**bits - 2 ** (bits - 1)
        assert r.clz == (text.index("1") if "1" in text else bits) and r.ctz == (text[::-1].index("1") if "1" in text else bits)
        assert r.rev == s(int(text[::-1], 2)) and r.swap == int.from_bytes((r.x % 2**bits).to_bytes(bits // 8, "little"), "big", signed=True)


def test_fused_multiply_add_rounds_once(spark):
    rng = random.Random(5)
    rows = [(1 + 2**-30, 1 + 2**-30, -1.0), (0.1, 10.0, -1.0), (1e308, 10.0, 0.0), (float("inf"), 0.0, 1.0), (None, 1.0, 1.0)]
    rows += [(rng.uniform(-9, 9), rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(50)]
    got = spark.createDataFrame(rows, "a double, b double, c double").select("a", "b", "c", floats.fma(F.col("a"), F.col("b"), F.col("c")).alias("r")).collect()
    for r in got:
        if r.a is None:
            assert r.r is None
        elif math.isinf(r.a):
            assert math.isnan(r.r)
        elif r.a == 1e308:
            assert r.r == math.inf
        else:
            assert r.r == float(Fraction(r.a) * Fraction(r.b) + Fraction(r.c))
    assert any(r.a is not None and math.isfinite(r.r) and r.r != r.a * r.b + r.c for r in got)


def test_payloads_of_nan_survive(spark):
    bits = [0x7FF8000000000001, 0x7FF0000000000123, -1, 0x3FF0000000000000]
    df = spark.createDataFrame([(b,) for b in bits], "b bigint")
    back = df.select(floats.bitcast(floats.bitcast(F.col("b"), "double"), "bigint").alias("x")).collect()
    assert [r.x for r in back] == bits


def test_functions_of_text(spark):
    df = spark.createDataFrame([("password", "NaCl"), (None, "x")], "p string, s string")
    got = [None if r.k is None else bytes(r.k) for r in df.select(codecs.scrypt(F.col("p"), F.col("s"), 64, 1024, 8, 16).alias("k")).collect()]
    assert got == [hashlib.scrypt(b"password", salt=b"NaCl", n=1024, r=8, p=16, maxmem=2**26, dklen=64), None]
    assert got[0].hex().startswith("fdbabe1c9d3472007856e7190d01e9fe")  # the value its standard gives
    assert spark.range(1).select(F.sha2(F.lit("abc"), 512).alias("h")).first().h == hashlib.sha512(b"abc").hexdigest()
    with pytest.raises(ValueError, match="nope"):
        codecs.fields(df, {"nope": "x"})
    assert codecs.fields(df, {"p": "secret"}, ["s"]).columns == ["secret"]


def test_entry_without_what_the_operators_need(monkeypatch):
    """A package that they need is missing: the other queries are registered."""
    import builtins
    import importlib
    import sys

    import __spark_entry__ as e

    real = builtins.__import__

    def no_xxhash(name, *a, **k):
        if name == "xxhash":
            raise ImportError(name)
        return real(name, *a, **k)

    for m in [m for m in sys.modules if m == "xxhash" or m.startswith(("moraine.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", no_xxhash)
    with pytest.warns(UserWarning):
        importlib.reload(e)
    assert "doc_keyset_after" in e.queries() and not [q for q in e.queries() if q.startswith("op")] and set(e.oracle_sql()) == set(e.queries())
    monkeypatch.undo()
    importlib.reload(e)
