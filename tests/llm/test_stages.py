"""The pipeline's stages one after the other: empty tables, nulls, ties, repeated rows, clashing names, reruns."""

import collections
import random

import corpus_pipeline as pipeline
import pytest

from moraine.llm import simhash, similar

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, path, docs, items=(), labels=()):
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    return f"file://{path}"


def test_empty_tables_through_every_stage(spark, tmp_path):
    sf = write(spark, tmp_path, [])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0, name
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
    assert pipeline.run(spark, sf).count() == 0


def rows():
    rng = random.Random(4)
    word = lambda: rng.choice(["river", "stone", "walked", "over", "quietly", "the", "and", "house", "morning", "light"])
    docs = [(i, " ".join(word() for _ in range(rng.randint(20, 90))), "en", f"s{i % 3}", i) for i in range(60)]
    docs += [(100, None, None, None, None), (101, "", "en", "s0", 0), (None, "no id at all", None, None, None), (None, None, None, None, None)]
    docs += [docs[3], docs[3], (3, docs[3][1], "de", "s1", 9), (102, docs[3][1], "en", "s2", 1), (103, "z " * 30_000, "en", "s0", 60_000)]
    items = [(1, " ".join(docs[8][1].split()[3:16])), (2, None), (2, "")]
    return docs, items, [(i, int(i % 2), 0) for i in range(0, 60, 3)] + [(None, 1, 0), (5, None, None)]


def test_nulls_ties_and_reruns(spark, tmp_path):
    docs, items, labels = rows()
    sf = write(spark, tmp_path, docs, items, labels)
    out = [collections.Counter(map(str, pipeline.run(spark, sf).collect())) for _ in range(2)]
    assert out[0] == out[1] and sum(out[0].values()) > 0
    seen = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        before, seen = seen, stage(spark, seen, sf).cache()
        assert seen.columns == before.columns and {r.doc_id for r in seen.collect()} <= {r.doc_id for r in before.collect()}
    assert 8 not in {r.doc_id for r in seen.collect()}


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_one_row_of_rows_alike_but_for_other_columns(spark, parts):
    docs = [(1, "a b c d e f", "en", "x", 1), (1, "a b c d e f", "de", "x", 1), (1, "a b c d e f", None, "x", 1), (2, "quite another text here", "en", "y", 1), (2, "quite another text here", "en", "y", 1)]
    df = spark.createDataFrame(docs, COLUMNS).repartition(parts)
    for find in (simhash.near_duplicates, similar.near_duplicates):
        assert sorted(map(tuple, simhash.one_of_each(df, find).collect())) == [(1, "a b c d e f", "de", "x", 1), (2, "quite another text here", "en", "y", 1)]


def test_run_over_clashing_names(spark, tmp_path):
    names = "row string, known string, mix_copies int, mix_copy int, virtual_slot int, hit string, size long, score double, component long, `a.b` int"
    docs = [(i, f"word{i} some other text of {i} words", "en", "s", 1, "r", "k", 7, 7, 7, "h", 7, 0.5, 7, 7) for i in range(12)]
    spark.createDataFrame(docs, f"{COLUMNS}, {names}").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert pipeline.run(spark, f"file://{tmp_path}").count() > 0
    seen = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        columns, seen = seen.columns, stage(spark, seen, f"file://{tmp_path}")
        assert seen.columns == columns


def test_a_segment_of_more_than_heavy_fingerprints(spark):
    """Over 1,024 distinct fingerprints of one segment, so that links go by midpoints, against all pairs."""
    import numpy as np

    from moraine.llm import components

    rng = np.random.default_rng(6)
    low, centres = int(rng.integers(1, 2**32)), rng.integers(0, 2**32, 150, np.uint64)
    highs = {int(c) ^ sum(1 << int(b) for b in rng.choice(32, int(rng.integers(0, 6)), replace=False)) for c in centres for _ in range(10)}
    prints = np.array(sorted(h << 32 | low for h in highs), np.uint64)
    assert len(prints) > simhash.HEAVY
    root = np.arange(len(prints))
    for i in range(len(prints)):  # the least index that is linked, until nothing changes
        near = np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= simhash.DISTANCE)
        for r in {int(root[j]) for j in near}:
            root[root == r] = min(int(root[j]) for j in near)
    found = components.components(simhash.links(spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")))
    got = {r.node & (2**64 - 1): r.component for r in found.collect()}
    groups = {}
    for x, r in zip(prints.tolist(), root.tolist()):
        groups.setdefault(r, set()).add(got.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups) > 100
