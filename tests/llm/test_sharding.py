"""The slot map: by hand, stored, edited and used again."""

import collections

import pytest
from pyspark.sql import functions as F

from moraine.llm import sharding as S


def docs(spark, n, step=1):
    return spark.range(0, n, step).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 53).cast("int")).alias("text"))


def shards(rows):
    return {(r.doc_id, r.text_crc32): (r.virtual_slot, r.shard) for r in rows}


def test_first_map_by_hand(spark):
    records = S.keyed(docs(spark, 700), 64)
    size = collections.Counter()
    for r in records.collect():
        size[r.virtual_slot] += r["size"]
    want, loads = {}, [0] * 5
    for slot in sorted(range(64), key=lambda s: (-size[s], s)):
        want[slot] = loads.index(min(loads))
        loads[want[slot]] += size[slot]
    m = S.first_map(S.all_slots(S.slot_bytes(records), 64), 5).collect()
    assert {r.virtual_slot: r.shard for r in m} == want and {r.virtual_slot: r.bytes for r in m} == {s: size[s] for s in range(64)}


def test_new_records_go_by_the_stored_map(spark, tmp_path):
    path = f"file://{tmp_path}/map"
    first = shards(S.assign(docs(spark, 40), 4, 256, path).collect())  # most slots are empty
    assert S.load_map(spark, path).count() == 256
    more = S.assign(docs(spark, 900), 4, 256, path)
    rows = more.collect()
    assert len(rows) == 900 and {r.map_version for r in rows} == {1}
    assert all(shards(rows)[k] == v for k, v in first.items())
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_growth_and_reload(spark, tmp_path):
    path = f"file://{tmp_path}/map"
    before = shards(S.assign(docs(spark, 2000), 8, 512, path).collect())
    assert S.save_map(S.grow(S.load_map(spark, path), 8), path) == 2
    after = shards(S.assign(docs(spark, 2000), 8, 512, path).collect())
    moved = [k for k in before if before[k] != after[k]]
    size = lambda keys: sum(i % 53 + 1 for i, _ in keys)
    assert all(after[k] == (before[k][0], 8) for k in moved) and size(moved) == pytest.approx(size(before) / 9, rel=0.1)
    assert set(before.values()) <= {(r.virtual_slot, r.shard) for r in S.load_map(spark, path, 1).collect()}
    with pytest.raises(Exception, match="exists"):
        S.save_map(S.load_map(spark, path, 1), path)
    assert {r.map_version for r in S.assign(docs(spark, 2000), 8, 512, path).collect()} == {2}


def test_rebalance_moves_what_is_over(spark, tmp_path):
    path = f"file://{tmp_path}/map"
    S.assign(docs(spark, 300), 4, 128, path)
    m = S.load_map(spark, path)
    heavy = {r.virtual_slot for r in m.filter("shard = 0").collect()}
    stats = m.select("virtual_slot", F.when(F.col("virtual_slot").isin(*heavy), F.col("bytes") * 5 + 40).otherwise(F.col("bytes")).cast("long").alias("bytes"), "rows")
    new = {r.virtual_slot: (r.shard, r.bytes, r.version) for r in S.rebalance(m, stats, 4).collect()}
    old = {r.virtual_slot: r.shard for r in m.collect()}
    assert len(new) == 128 and all(new[s][0] == old[s] for s in old if old[s] != 0) and {v[2] for v in new.values()} == {2}
    load = collections.Counter()
    for shard, size, _ in new.values():
        load[shard] += size
    assert max(load.values()) <= sum(load.values()) / 4 + max(v[1] for v in new.values())


def test_grown_query_rows(spark):
    rows = S.assign_grown(docs(spark, 1500), 8, 512).collect()
    assert len(rows) == 1500 and all(r.grown in (r.shard, 8) for r in rows) and {r.map_version for r in rows} == {2}
    assert any(r.grown == 8 for r in rows)
    assert S.assign_grown(docs(spark, 0), 8, 512).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, None), (1, ""), (1, "")], "doc_id long, text string")
    assert S.assign(nulls, 2, 16).count() == 4
