"""Targets of many sources, over several ranges, against water-filling source by source."""

from __future__ import annotations

import random

import pytest

from moraine.llm import mixing

from .test_llm import water


def test_many_sources(spark):
    rng = random.Random(7)
    sizes = {f"s{rng.random()}": int(10 ** rng.uniform(0, 7)) for _ in range(1500)} | {None: 40, "": 9, "é": 500, "\U0001f600": 7}
    rows = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n long")
    want = water(sizes)
    for coalesced in ("true", "false"):
        old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
        try:
            out = mixing.targets(rows).collect()
        finally:
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
        got = {r.source: r.target for r in out}
        assert len(out) == len(sizes) and got == pytest.approx(want)
        assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_running_sums_are_those_of_the_whole_order(spark):
    rows = [(i, (i * 37) % 101, i % 3) for i in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = mixing.running(spark.createDataFrame(rows, "i long, k long, v long"), [mixing.F.col("k"), mixing.F.col("i")], before=mixing.F.col("v"))
        got = {r.i: r.before for r in ranged.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total, want = 0, {}
    for i, _, v in sorted(rows, key=lambda r: (r[1], r[0])):
        want[i] = total
        total += v
    assert got == want


def test_no_source(spark):
    assert mixing.targets(spark.createDataFrame([], "source string, source_size long, n long")).count() == 0
