import random

import corpus_pipeline
from moraine.llm import similar

WORDS = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("a", "el", "in", "or", "um", "ysh")]


def sets(t):
    w = (t or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_kept(rows):
    """The least id of each component of the pairs at 0.8 or more, every pair compared."""
    s, root = [sets(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(s[i] & s[j]) / len(s[i] | s[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted(rows[i][0] for i in range(len(rows)) if find(i) == i)


def edited(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = rng.choice(WORDS)
    return " ".join(out)


def test_stage_keeps_one_of_texts_at_similarity_of_08(spark):
    rng, texts = random.Random(5), [None, "", " \n", "One two", "one TWO", "one two three"]
    for _ in range(12):
        base = rng.choices(WORDS, k=rng.randint(80, 250))
        texts += [" ".join(base), " ".join(base), " ".join(base).upper(), *(edited(rng, base, n) for n in (1, 2, 3, 4, 6, 9, 20))]
    hub = rng.choices(WORDS, k=300)  # one large group, in one bucket of most bands
    texts += [edited(rng, hub, 2) for _ in range(60)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_kept(rows)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == want
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_distant_texts_of_a_crowded_bucket_are_compared_beyond_its_least(spark):
    """Texts that share a band with a text at under 0.8 from each of them, but are alike in pairs."""
    rng = random.Random(1)
    base = rng.choices(WORDS, k=200)
    texts = []
    for _ in range(10):
        far = edited(rng, base, 6).split()
        texts += [" ".join(far), edited(rng, far, 1)]
    rows = list(enumerate(texts))
    found = {r.doc_id: r.component for r in similar.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(set(found.values())) == len(brute_kept(rows))


def test_filter_before_the_exact_join(spark, monkeypatch):
    """All rows that are named pass, and few others; with more names than its blocks are for, more others."""
    from pyspark.sql import functions as F

    from moraine.llm import urls

    rows = spark.range(20_000).select(F.xxhash64("id").alias("t"), F.col("id").alias("a.b"))
    names = spark.range(2000).select(F.xxhash64("id").alias("t"))
    got = urls.maybe_in(rows, "t", names, 2000)
    assert got.columns == ["t", "a.b"] and got.join(names, "t", "left_semi").count() == 2000 and got.count() < 2500
    monkeypatch.setattr(urls, "BROADCAST_ROWS", 2)
    assert urls.maybe_in(rows, "t", names, 2000).join(names, "t", "left_semi").count() == 2000
    assert urls.maybe_in(rows, "t", names.limit(0), 0).count() == 0
