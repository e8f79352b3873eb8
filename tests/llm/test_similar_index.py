"""The SimHash index of the near-duplicate stage, without the bands that complete it."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from moraine.llm import simhash, similar
from moraine.llm.components import components

from .test_similar import WORDS, brute_kept, edited


def no_bands(monkeypatch):
    marks = similar._marks
    monkeypatch.setattr(similar, "_marks", lambda texts: marks(texts).withColumn("keys", F.array("t")))


def test_stage_links_by_fingerprints(spark, monkeypatch):
    no_bands(monkeypatch)
    rng, texts = random.Random(7), [None, "", " \n", "One two", "one TWO", "one two three"]
    for _ in range(12):
        base = rng.choices(WORDS, k=rng.randint(120, 250))
        texts += [" ".join(base), " ".join(base).upper(), *(edited(rng, base, n) for n in (1, 1, 2, 25))]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == brute_kept(rows)


@pytest.mark.parametrize("crowd", [3, 12, 1000])
def test_dense_groups_are_compared_exactly(spark, crowd):
    """A group of which many are at 0.8 or more, and many are not: its crowded segments give what all pairs give."""
    rng = random.Random(11)
    hub = rng.choices(WORDS, k=200)
    rows = [(i, edited(rng, hub, rng.randint(0, 6))) for i in range(70)] + [(100 + i, " ".join(rng.choices(WORDS, k=90))) for i in range(10)]
    texts = spark.createDataFrame(rows, "t long, text string")
    prints = similar._marks(texts).select("t", "fps").cache()
    assert simhash.crowds(prints, crowd).isEmpty() == (crowd == 1000)
    found = {r.node: r.component for r in components(similar.simhash_links(prints, texts, crowd)).collect()}
    want = brute_kept(rows)
    assert 12 < len(want) < 70 and sorted({found.get(t, t) for t, _ in rows}) == want


def test_prefixes_hold_every_pair(spark):
    rng, rows = random.Random(2), []
    for base in range(0, 400, 40):
        rows += [(len(rows) + k, sorted(rng.sample(range(base, base + 24), rng.randint(1, 24)))) for k in range(30)]
    sets = spark.createDataFrame(rows, "t long, shingles array<long>").withColumn("c", F.col("t"))
    got = {(r.a, r.b) for r in similar.prefix_pairs(sets).collect()}
    s = [set(x) for _, x in rows]
    want = {(i, j) for i in range(len(s)) for j in range(i + 1, len(s)) if len(s[i] & s[j]) / len(s[i] | s[j]) >= 0.8}
    assert len(want) > 20 and want <= got and len(got) < len(rows) ** 2 / 20


@pytest.mark.parametrize("n", [1, 2, 3, 254, 255, 256, 9001])
def test_set_fingerprints_bit_by_bit(n):
    hashes = np.unique(np.random.default_rng(n).integers(0, 2**64, n, np.uint64))
    least = [] if n % 2 else [int(hashes[0])]
    want = []
    for salt in simhash._SALTS.tolist():
        ones = [0] * 64
        for x in hashes.tolist() + least:
            x = (x ^ salt) * 0xBF58476D1CE4E5B9 % 2**64
            x = (x ^ x >> 32) * 0x94D049BB133111EB % 2**64
            x ^= x >> 29
            for b in range(64):
                ones[b] += x >> b & 1
        want.append(sum(1 << b for b in range(64) if 2 * ones[b] > n + len(least)))
    assert simhash.set_fingerprints(hashes).tolist() == want


def test_pairs_of_the_index_are_verified_before_they_are_rows(spark):
    """The pairs of the index by brute force, each once: nothing that is only near in a segment and one fingerprint, and none of one c or of two crowded rows."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, (40, simhash.PRINTS), np.uint64)
    fps = np.concatenate([base, base, base])
    for row in fps[40:]:
        for n in range(simhash.PRINTS):
            for b in rng.choice(64, rng.integers(0, 14), replace=False):
                row[n] ^= np.uint64(1) << np.uint64(b)
    fps = np.concatenate([fps, rng.integers(0, 2**64, (200, simhash.PRINTS), np.uint64)])
    fps[120:, 0] = fps[0, 0]  # alike in one fingerprint alone
    rows = [(i, [int(x) for x in f.view(np.int64)], i if i % 5 else 0, i % 3 == 0) for i, f in enumerate(fps)]
    apart = lambda i, j: np.bitwise_count(fps[i] ^ fps[j])
    want, shares = set(), 0
    for i in range(len(fps)):
        for j in range(i):
            bits, x = apart(i, j), fps[i] ^ fps[j]
            met = any(bits[n] <= simhash.APART and any(np.bitwise_count(x[n] >> np.uint64(at) & np.uint64((1 << w) - 1)) <= 1 for at, w in simhash.SEGMENTS) for n in range(simhash.PRINTS))
            shares += met
            if met and bits.sum() <= simhash.APART_IN_ALL and rows[i][2] != rows[j][2] and not (rows[i][3] and rows[j][3]):
                want.add((j, i))
    prints = spark.createDataFrame(rows, "t long, fps array<long>, c long, crowded boolean")
    got = [(r.a, r.b) for r in simhash.near_pairs(prints, 1000).collect()]
    assert 20 < len(want) < shares / 20 and sorted(got) == sorted(want)


def test_members_of_a_crowd_have_a_pair_each(spark):
    """Those apart from most of the crowd, with the nearest of another component; not all pairs."""
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 2**64, (90, simhash.PRINTS), np.uint64)
    c = [0 if i < 50 else i // 10 for i in range(90)]
    prints = spark.createDataFrame([(i, [int(x) for x in f.view(np.int64)]) for i, f in enumerate(fps)], "t long, fps array<long>")
    filed = spark.createDataFrame([(7, i, 90, c[i]) for i in range(90)], "key long, t long, n long, c long")
    got = {(r.a, r.b) for r in similar.nearest_pairs(filed, prints).collect()}
    near = lambda i: min((j for j in range(90) if c[j] != c[i]), key=lambda j: (int(np.bitwise_count(fps[i] ^ fps[j]).sum()), j))
    assert got == {(min(i, near(i)), max(i, near(i))) for i in range(50, 90)}
