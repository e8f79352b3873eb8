"""The language model at several orders against counts by hand, texts cut into parts, the stored arrays."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from moraine.llm import common
from moraine.llm import kneser_ney as K

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) + ["</s>"]


class ByHand:
    def __init__(self, texts, order):
        self.order, raw = order, collections.Counter()
        for t in texts:
            s = ["<s>", *tokens(t)]
            raw.update(tuple(s[i - k + 1 : i + 1]) for k in range(1, order + 1) for i in range(1, len(s)) if i >= k - 1)
        self.words = {g[0] for g in raw if len(g) == 1}
        self.count = {order: {g: c for g, c in raw.items() if len(g) == order}}
        for k in range(order - 1, 0, -1):
            before = collections.Counter(g[1:] for g in raw if len(g) == k + 1)
            self.count[k] = {g: raw[g] if g[0] == "<s>" else before[g] for g in raw if len(g) == k}
        of = {k: [sum(c == x for c in self.count[k].values()) for x in range(5)] for k in self.count}
        self.d = {k: K.discounts(np.array([0, *v[1:]])) for k, v in of.items()}

    def p(self, context, w, k=None):
        k = self.order if k is None else k
        counts, d, v = self.count[k], self.d[k], len(self.words)
        if k == 1:
            total = sum(counts.values())
            c = counts.get((w,), 0)
            return (c - d[min(c, 3)]) / total + sum(d[min(x, 3)] for x in counts.values()) / total / (v + 1)
        lower = self.p(context[1:], w, k - 1)
        if len(context) < k - 1:
            return self.p(context, w, k - 1)
        after = [x for g, x in counts.items() if g[:-1] == context]
        if not after:
            return lower
        c = counts.get((*context, w), 0)
        return (c - d[min(c, 3)] + sum(d[min(x, 3)] for x in after) * lower) / sum(after)

    def score(self, t):
        s, out = ["<s>", *tokens(t)], 0.0
        for i in range(1, len(s)):
            out += math.log10(self.p(tuple(s[max(0, i - self.order + 1) : i]), s[i], min(self.order, i + 1)))
        return out


def some_texts():
    rng = random.Random(3)
    words = "the of Alpha beta. gamma, delta éa über 東京 x1 | ** go stop run".split()
    out = [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(45)]
    return [*out, None, "", "  \n\t ", "one", "Two words", out[0], out[0], out[1] + " extra", "\n".join(out[:20]), "new unseen words here"]


@pytest.mark.parametrize("order, shard_bytes, chunk, piece_bytes", [(2, 10**6, 10**6, 10**6), (3, 700, 120, 50), (3, 10**6, 10**6, 10**6), (4, 900, 60, 9), (6, 3000, 10**6, 10**6)])
def test_scores_by_hand(spark, order, shard_bytes, chunk, piece_bytes):
    texts = some_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    fold = [zlib.crc32(str(i).encode()) % 7 for i in range(len(texts))]
    learnt = [t for t, f in zip(texts, fold) if f != 2]
    model = ByHand(learnt, order)
    counts = collections.Counter(w for t in learnt for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    assert sum(model.p(("the", "of")[: order - 1], w, min(order, 3)) for w in [*counts, "nowhere"]) == pytest.approx(1)
    rows = {r.doc_id: r for r in K.report(docs, order, shard_bytes, chunk, piece_bytes).collect()}
    assert sorted(rows) == list(range(len(texts)))
    for i, t in enumerate(texts):
        r, w = rows[i], tokens(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold[i] == 2, len(w), sum(x in counts for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        assert r.score == pytest.approx(model.score(t)), (i, t)
        assert r.perplexity == pytest.approx(10 ** (-r.score / len(w)))


def test_lookups_in_blocks(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(some_texts())), "doc_id long, text string").coalesce(1)
    chunks = K.tokenized(docs, docs.doc_id >= 0)
    model = K.train(chunks, 3, 3)
    one = next(K.chunk_rows(chunks.toArrow().to_batches()))[1]
    first = model.levels[0].find(one.words)[one.codes]
    want = model.log10(first, one)
    monkeypatch.setattr(K, "LOOKUP", 17)
    assert np.array_equal(model.log10(first, one), want) and np.array_equal(model.levels[0].find(one.words)[one.codes], first)


def test_orders_and_empty_training(spark):
    docs = spark.createDataFrame([(i, "a b c") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    assert {(r.score, r.base_score, r.n_known, r.train_tokens) for r in K.report(docs, 3).collect()} == {(0.0, 0.0, 0, 0)}
    assert K.report(docs.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        K.report(docs, K.OVERLAP + 2)


def test_a_hot_context_is_in_no_larger_shard(spark):
    """A context before a third of all tokens: n-grams are dealt by their whole hash."""
    rng = random.Random(1)
    texts = [" ".join(x for _ in range(300) for x in ("hot", f"w{rng.randrange(4000)}")) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    chunks = K.tokenized(docs, docs.doc_id >= 0, 2000)
    model = K.train(chunks, 8, 2)
    assert model.levels[1].sizes.max() < 1.3 * model.levels[1].sizes.mean()


def test_stored_keys(tmp_path):
    rng = np.random.default_rng(1)
    for n, size in ((1, 0), (1, 1), (1, 5000), (7, 3000), (64, 20_000)):
        keys = np.unique(rng.integers(2, 2**64 - 1, size, np.uint64))
        shard, sizes = K.by_range(keys, n), np.zeros(n, np.int64)
        for s in range(n):
            own = keys[shard == s]
            sizes[s] = len(own)
            K.put_keys(f"file://{tmp_path}/keys2-{s}", own, s, n)
        level = K.Level(2, f"file://{tmp_path}", sizes)
        other = rng.integers(2, 2**64 - 1, 1000, np.uint64)
        assert np.array_equal(level.find(keys), np.arange(len(keys))) and (level.find(np.setdiff1d(other, keys)) == -1).all()
        values = rng.integers(0, 2**40, (len(keys), 4)) * (rng.random((len(keys), 4)) < 0.3)
        for s in range(n):
            K.put_small(f"file://{tmp_path}/f2-{s}", values[shard == s].reshape(-1))
        again = K.Level(2, f"file://{tmp_path}", sizes)
        assert np.array_equal(again.values("f", np.arange(-1, len(keys)), 4), np.concatenate([np.zeros((1, 4), np.int64), values]))


def test_pieces_of_long_texts():
    rng = random.Random(2)
    for t in (b"", b" ", b"x" * 500, b"a b  c\n" * 90, bytes(rng.choice(b"ab \n\xc3") for _ in range(900))):
        for size in (1, 3, 50, 10**6):
            got = list(K.text_pieces(t, size))
            assert b"".join(got) == t and [w for p in got for w in p.split()] == t.split()


def test_arrays_of_a_remote_store(spark, tmp_path, monkeypatch):
    """The same scores where files can't be mapped in place."""
    import pyarrow.fs as pafs

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(some_texts())], "doc_id long, text string")
    chunks = K.tokenized(docs, docs.doc_id >= 0)
    model = K.train(chunks, 2, 3)
    one = next(K.chunk_rows(chunks.select("*").toArrow().to_batches()))[1]
    want = model.log10(model.levels[0].find(one.words)[one.codes], one)
    real = common._fs
    monkeypatch.setattr(common, "_fs", lambda uri: (pafs.SubTreeFileSystem("/", pafs.LocalFileSystem()), real(uri)[1]))
    far = K.Model(**{**model.__dict__, "levels": [K.Level(x.k, x.path, x.sizes) for x in model.levels]})
    assert np.array_equal(far.log10(far.levels[0].find(one.words)[one.codes], one), want)
    common._COPIES.clear()
