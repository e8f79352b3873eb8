"""Interpolated modified Kneser-Ney n-gram model of any order, counted in Spark and scored from memory-mapped arrays.

Texts are tokenised once: ``tokenized`` stores chunks of token hashes, from which
all passes read.  Level 1 is the vocabulary: sorted hashes, whose place is a
token's rank.  An n-gram is known by the ranks of its first and of its last n - 1
tokens, so level k has sorted hashes of pairs of ranks of level k - 1, and the
place of an n-gram in them is its own rank.  Levels are counted upwards; then the
numbers of words before each n-gram and the sums of what follows each context go
downwards, as counts by rank.

Shards are ranges of hashes, as many as the bytes of the texts need (SHARD_BYTES
each), so no context or word, however frequent, makes one larger; what leaves a
task has been summed within it.  A shard's arrays are files in the shared folder
which workers map into memory and search; no worker loads a model.

With c the count of an n-gram at the highest order, and of words before it below
(n-grams that begin a text have none and keep their count), D by counts of counts,
V distinct tokens:
P(w | v) = (c(vw) - D(c)) / c(v.) + g(v) P(w | v without its first), and at order 1
P(w) = (c(w) - D(c)) / c(.) + g / (V + 1).

Defined results: a null or empty text has one token, its end; unseen tokens share
what P(w) leaves to V + 1 words; a text of any length is cut into parts that keep
the tokens before them, and their sums are added; a null doc_id is the text '';
repeated rows count as often as they occur and are each scored; an empty training
set has V = N = 0 and scores 0; empty tables give an empty result; columns other
than doc_id and text are not looked at.  Two n-grams of a level count as one if
their 64-bit hashes are equal, and an n-gram that isn't there is taken for one that
is with a chance of some 2e-9 (32 bits are kept beyond its bucket); words are
compared by 64 bits.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_array, materialize, new_dir, put_bytes, release, remove, texts_of

FOLDS, HELD_OUT = 7, 2
ORDER = 2
#: Tokens kept before a part of a text, so the highest order is one more.
OVERLAP = 5
#: Tokens of a chunk, bytes of text that are tokenised at once, and bytes of text to a shard; shards are MOST_SHARDS at most.
CHUNK = 1_000_000
PIECE_BYTES = 2_000_000
SHARD_BYTES = 8_000_000
MOST_SHARDS = 50_000
#: Hashes of the marks before and after a text; words have larger ones.
BEGIN, END = np.uint64(0), np.uint64(1)
#: Tokens whose n-grams are looked up at once.
LOOKUP = 250_000
#: Entries of a bucket of n-gram hashes, and arrays that a worker keeps mapped.
BUCKET = 6
MOST_MAPS = 20_000


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def token_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words, A-Z lower-cased; bytes.split() parts at space and controls 9 to 13."""
    w = text.lower().split()
    return np.maximum(np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w)), 2)


SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def text_pieces(text: bytes, size: int):
    """The text in pieces of about ``size`` bytes, cut after space; a longer word stays whole."""
    at = 0
    while len(text) - at > size:
        end = at + size
        while end < len(text):
            found = np.flatnonzero(SPACE[np.frombuffer(text, np.uint8, min(size, len(text) - end), end)])
            if len(found):
                end += int(found[0]) + 1
                break
            end += min(size, len(text) - end)
        yield text[at:end]
        at = end
    yield text[at:]


def hash_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of pairs of ranks."""
    return mixed(mixed(a) + b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))


def by_range(hashes: np.ndarray, n: int) -> np.ndarray:
    """Shard of a hash; grows with the hash, so shards are ranges."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def firsts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal sorted keys begin."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)


def summed(keys: np.ndarray, *columns: np.ndarray) -> tuple:
    """Distinct keys, sorted, and the sums of each column over them."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = firsts(keys)
    return keys[at], *(np.add.reduceat(c[order], at, axis=0) if len(keys) else c for c in columns)


def pack(a: np.ndarray, rising: bool = True) -> bytes:
    """Integers with equal bytes side by side, compressed; of ``rising`` ones the differences."""
    a = np.ascontiguousarray(np.diff(a, prepend=a[:1] * 0) if rising else a)
    planes = a.view(np.uint8).reshape(-1, a.itemsize).T
    return len(a).to_bytes(8, "little") + bytes([a.itemsize | (0 if rising else 128)]) + pa.compress(np.ascontiguousarray(planes).tobytes(), "zstd", asbytes=True)


def unpack(b: bytes) -> np.ndarray:
    n, size, rising = int.from_bytes(b[:8], "little"), b[8] & 127, b[8] < 128
    raw = pa.decompress(b[9:], n * size, "zstd", asbytes=True) if n else b""
    a = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(f"<u{size}").reshape(-1)
    return np.cumsum(a, dtype=f"<u{size}") if rising else a


def least_width(a: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as the largest needs."""
    top = int(a.max()) if len(a) else 0
    return a.astype("u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


# What goes between tasks: for each shard its keys and values --------------------------------------

PIECE = "shard int, kind string, a binary, b binary, c binary, sums array<long>"
PIECE_SCHEMA = pa.schema([("shard", pa.int32()), ("kind", pa.string()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("sums", pa.list_(pa.int64()))])


def piece_rows(rows: list[tuple]) -> pa.RecordBatch:
    """rows: (shard, kind, a, b, c, sums); arrays are packed already."""
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 6, PIECE_SCHEMA.types)], schema=PIECE_SCHEMA)


def dealt(shard: np.ndarray, kind: str, a: np.ndarray, b: np.ndarray | None, c: np.ndarray) -> list[tuple]:
    """A row for each shard (rising) of arrays in the same order; a rises within a shard."""
    at = firsts(shard)
    ends = np.append(at[1:], len(shard))
    return [(int(shard[i]), kind, pack(a[i:j]), pack(b[i:j], False) if b is not None else None, pack(least_width(c[i:j].reshape(-1)), False), None) for i, j in zip(at, ends)]


def merged(rows: DataFrame, n: int, merge) -> DataFrame:
    """What ``merge`` (shard, its rows) gives for each shard; a shard is a task of its own."""

    def run(batches):
        held = defaultdict(list)
        for batch in batches:
            for r in batch.select(["shard", "kind", "a", "b", "c"]).to_pylist():
                held[r["shard"]].append(r)
        for shard in sorted(held):
            yield piece_rows(merge(shard, held.pop(shard)))

    return rows.repartitionById(n, F.col("shard")).mapInArrow(run, PIECE)


def of_kind(rows: list[dict], kind: str, name: str) -> np.ndarray:
    """A column of the rows of a kind, as 64-bit integers, one after the other."""
    found = [unpack(r[name]) for r in rows if r["kind"] == kind]
    return np.concatenate(found).astype(np.uint64) if found else np.empty(0, np.uint64)


# Arrays in the shared folder ----------------------------------------------------------------------


def put_small(path: str, values: np.ndarray) -> None:
    """Counts as bytes; those of 255 and more in a second array of (place, value)."""
    large = np.flatnonzero(values >= 255)
    put_bytes(path, np.minimum(values, 255).astype(np.uint8).tobytes())
    put_bytes(f"{path}-large", np.stack([large, values[large].astype(np.int64)], axis=1).astype("<u8").tobytes())


def bucket_bits(size: int, n: int) -> int:
    """Leading bits of a hash that name its bucket."""
    return min(32, max(0, (n - 1).bit_length() + (max(size, 1) // BUCKET).bit_length() - 1))


def first_hash(shard: int, n: int) -> int:
    return -(-(shard << 32) // n) << 32


def put_keys(path: str, keys: np.ndarray, shard: int, n: int) -> None:
    """Sorted hashes: where each bucket begins, and the next 32 bits of each hash."""
    bits = bucket_bits(len(keys), n)
    shift, low = np.uint64(64 - bits), first_hash(shard, n) >> (64 - bits)
    high = (first_hash(shard + 1, n) - 1) >> (64 - bits)
    bucket = (keys >> shift).astype(np.int64) - low if bits else np.zeros(len(keys), np.int64)
    put_bytes(f"{path}-at", np.append(0, np.cumsum(np.bincount(bucket, minlength=high - low + 1))).astype("<u4").tobytes())
    put_bytes(path, ((keys >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes())


@dataclass
class Level:
    """The n-grams of one order: entries by shard, and where each shard's ranks begin."""

    k: int
    path: str
    sizes: np.ndarray
    _maps: dict = field(default_factory=dict)

    def __post_init__(self):
        self.bases = np.append(0, np.cumsum(self.sizes))

    def __getstate__(self):
        return self.__dict__ | {"_maps": {}}

    @property
    def n(self) -> int:
        return len(self.sizes)

    def array(self, name: str, shard: int, dtype) -> np.ndarray:
        if (name, shard) not in self._maps:
            if len(self._maps) >= MOST_MAPS:
                self._maps.clear()
            self._maps[name, shard] = map_array(f"{self.path}/{name}{self.k}-{shard}", dtype)
        return self._maps[name, shard]

    def small(self, name: str, shard: int, at: np.ndarray) -> np.ndarray:
        """Values of put_small at places."""
        c = self.array(name, shard, np.uint8)[at].astype(np.int64)
        if (big := c == 255).any():
            rest = map_array(f"{self.path}/{name}{self.k}-{shard}-large", "<u8").reshape(-1, 2)
            c[big] = rest[np.searchsorted(rest[:, 0], at[big].astype(np.uint64)), 1]
        return c

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ranks, -1 where there is no such n-gram."""
        return self.look(hashes)[0]

    def look(self, keys: np.ndarray, stats=lambda ranks: (), by_hash: bool = True) -> list[np.ndarray]:
        """Ranks of hashes (or the ranks themselves), and what ``stats`` gives for the distinct ones, LOOKUP keys at once."""
        out = None
        for at in range(0, max(len(keys), 1), LOOKUP):
            distinct, back = np.unique(keys[at : at + LOOKUP], return_inverse=True)
            ranks = self._ranks(distinct) if by_hash else distinct
            columns = (ranks, *stats(ranks))
            out = out or [np.empty(len(keys), c.dtype) for c in columns]
            for o, c in zip(out, columns):
                o[at : at + len(back)] = c[back]
        return out

    def _ranks(self, distinct: np.ndarray) -> np.ndarray:
        """Ranks of sorted hashes; those that are found rise."""
        out = np.full(len(distinct), -1, np.int64)
        edges = np.searchsorted(by_range(distinct, self.n), np.arange(self.n + 1))
        for s in np.flatnonzero((np.diff(edges) > 0) & (self.sizes > 0)).tolist():
            q = distinct[edges[s] : edges[s + 1]]
            at = self._words(s, q) if self.k == 1 else self._grams(s, q)
            out[edges[s] : edges[s + 1]] = np.where(at >= 0, at + self.bases[s], -1)
        return out

    def _words(self, s: int, q: np.ndarray) -> np.ndarray:
        keys = self.array("keys", s, "<u8")
        at = np.minimum(np.searchsorted(keys, q), len(keys) - 1)
        return np.where(keys[at] == q, at, -1)

    def _grams(self, s: int, q: np.ndarray) -> np.ndarray:
        keys, begins, bits = self.array("keys", s, "<u4"), self.array("keys", f"{s}-at", "<u4"), bucket_bits(int(self.sizes[s]), self.n)
        bucket = (q >> np.uint64(64 - bits)).astype(np.int64) - (first_hash(s, self.n) >> (64 - bits)) if bits else np.zeros(len(q), np.int64)
        want = ((q >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        lo, end = begins[bucket].astype(np.int64), begins[bucket + 1].astype(np.int64)
        hi, last = end.copy(), len(keys) - 1
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            less = open_ & (keys[np.minimum(mid, last)] < want)
            lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        return np.where((lo < end) & (keys[np.minimum(lo, last)] == want), lo, -1)

    def values(self, name: str, ranks: np.ndarray, width: int = 1) -> np.ndarray:
        """Counts by rank, ``width`` of them each; 0 for -1.  Ranks rise, but for those."""
        out, on = np.zeros((len(ranks), width), np.int64), np.flatnonzero(ranks >= 0)
        edges = np.searchsorted(ranks[on], self.bases)
        for s in np.flatnonzero(np.diff(edges) > 0).tolist():
            own = on[edges[s] : edges[s + 1]]
            at = (ranks[own] - self.bases[s])[:, None] * width + np.arange(width)
            out[own] = self.small(name, s, at.reshape(-1)).reshape(-1, width)
        return out

    def owner(self, ranks: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bases, ranks, "right") - 1


def discounts(n: np.ndarray) -> np.ndarray:
    """D(0..3) of counts of counts n[1..4]; where those can't give one, 0.5 of a step as bounded by the count."""
    n1, n2, n3, n4 = (float(x) for x in n[1:5])
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(x, 0.05), k * 0.95) for k, x in enumerate(d, 1))])


@dataclass
class Model:
    """What the driver keeps: sizes by shard, sums and discounts; the arrays are in the shared folder."""

    order: int
    levels: list[Level]
    tokens: int = 0
    discounts: dict[int, np.ndarray] = field(default_factory=dict)
    kinds: int = 0
    gap: float = 1.0

    @property
    def v(self) -> int:
        """Distinct tokens; the mark before a text has a rank and is none."""
        return int(self.levels[0].sizes.sum()) - 1 if self.tokens else 0

    def ranks(self, first: np.ndarray, chunk: Chunk, upto: int) -> list[np.ndarray]:
        """Ranks at levels 1 to ``upto`` of the n-grams that end at each place; -1 where there is none."""
        out = [first]
        for k in range(2, upto + 1):
            r = np.full(len(first), -1, np.int64)
            i = chunk.ends(k)
            i = i[(out[-1][i - 1] >= 0) & (out[-1][i] >= 0)]
            r[i] = self.levels[k - 1].find(hash_of(out[-1][i - 1], out[-1][i]))
            out.append(r)
        return out

    def log10(self, first: np.ndarray, chunk: Chunk) -> np.ndarray:
        """log10 P of the token at each place given those before it."""
        p = np.full(len(first), 1.0 / (self.v + 1))
        if not self.tokens:
            return np.log10(p)
        rank, less, total, gap = self.levels[0].look(first, lambda r: self._stats(1, r), by_hash=False)
        p = less / self.kinds + self.gap * p
        for k in range(2, self.order + 1):
            i = chunk.ends(k)
            known = i[(rank[i - 1] >= 0) & (rank[i] >= 0)]
            found = self.levels[k - 1].look(hash_of(rank[known - 1], rank[known]), lambda r, k=k: self._stats(k, r))
            less = np.zeros(len(first))
            less[known] = found[1]
            on = i[total[i - 1] > 0]
            p[on] = (less[on] + gap[on - 1] * p[on]) / total[on - 1]
            if k < self.order:
                rank, total, gap = np.full(len(first), -1, np.int64), np.zeros(len(first)), np.zeros(len(first))
                rank[known], total[known], gap[known] = found[0], *found[2:]
        return np.log10(p, out=p)

    def _stats(self, k: int, ranks: np.ndarray) -> tuple:
        """By rank: the count less its discount, and, below the highest order, the sum of what follows and the discounts of that."""
        c, d = self.levels[k - 1].values("c", ranks)[:, 0], self.discounts[k]
        less = c - d[np.minimum(c, 3)]
        if k == self.order:
            return (less,)
        f = self.levels[k - 1].values("f", ranks, 4)
        return less, f[:, 0].astype(np.float64), f[:, 1:] @ self.discounts[k + 1][1:]


# Chunks of tokens ---------------------------------------------------------------------------------


class Chunk:
    """Tokens of parts of texts, one after the other.

    ``words``: distinct hashes; ``codes``: the tokens as places in them;
    by part: ``sizes`` (tokens), ``skips`` (leading ones that are there for what follows),
    ``begins`` (place in its text of the first).
    """

    def __init__(self, words, codes, sizes, skips, begins):
        self.words, self.codes, self.sizes, self.skips, self.begins = words, codes, sizes, skips, begins
        self.offset = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)

    @property
    def own(self) -> np.ndarray:
        """Which tokens are counted and scored here."""
        return self.offset >= np.repeat(self.skips, self.sizes)

    def ends(self, k: int) -> np.ndarray:
        """Places where an n-gram of k tokens ends."""
        return np.flatnonzero(self.offset >= k - 1)

    def only(self, parts: np.ndarray) -> Chunk:
        return Chunk(self.words, self.codes[np.repeat(parts, self.sizes)], self.sizes[parts], self.skips[parts], self.begins[parts])


CHUNKS = "rows array<long>, doc_ids array<{}>, learn array<boolean>, sizes array<int>, skips array<int>, begins array<long>, words binary, codes binary"


def tokenized(docs: DataFrame, learn: Column, chunk: int = CHUNK, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The stored chunks of all texts; ``learn``: which rows a model is counted from."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        parts, n, id_type = [], 0, pa.int64()

        def flush():
            words, codes, counts = np.unique(np.concatenate([p[3] for p in parts]), return_inverse=True, return_counts=True)
            by = np.argsort(-counts, kind="stable")  # frequent words have small codes, which pack better
            words, place = words[by], np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            codes = place[codes]
            one = lambda x, t: pa.array([x], pa.list_(t))
            cols = [one([p[0] for p in parts], pa.int64()), one([p[1] for p in parts], id_type), one([p[2] for p in parts], pa.bool_()), one([len(p[3]) for p in parts], pa.int32()), one([p[4] for p in parts], pa.int32()), one([p[5] for p in parts], pa.int64())]
            cols += [pa.array([pack(words, False)], pa.binary()), pa.array([pack(least_width(codes), False)], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["rows", "doc_ids", "learn", "sizes", "skips", "begins", "words", "codes"])

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for row, doc_id, is_learnt, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("learn").to_pylist(), texts_of(batch)):
                held, skip, begin = [np.array([BEGIN])], 1, 0
                pieces = list(text_pieces(text, piece_bytes))
                for i, piece in enumerate(pieces):
                    held.append(token_hashes(piece))
                    if i + 1 == len(pieces):
                        held.append(np.array([END]))
                    whole = np.concatenate(held)
                    if i + 1 < len(pieces) and n + len(whole) < chunk:
                        held = [whole]
                        continue
                    parts.append((row, doc_id, is_learnt, whole, skip, begin))
                    n += len(whole)
                    kept = whole[-OVERLAP:]
                    held, skip, begin = [kept], len(kept), begin + len(whole) - len(kept)
                    if n >= chunk:
                        yield flush()
                        parts, n = [], 0
        if parts:
            yield flush()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", learn.alias("learn"), "text")
    return materialize(rows.mapInArrow(run, CHUNKS.format(kind)), "lm-chunks")


def chunk_rows(batches):
    """(row of the record batch, Chunk, which parts are learnt from) of stored chunks."""
    for batch in batches:
        for i in range(batch.num_rows):
            get = lambda name, i=i: np.asarray(batch.column(name)[i].values.to_numpy(zero_copy_only=False))
            raw = lambda name, i=i: unpack(batch.column(name)[i].as_py())
            yield batch.slice(i, 1), Chunk(raw("words"), raw("codes").astype(np.int64), get("sizes").astype(np.int64), get("skips").astype(np.int64), get("begins")), get("learn")


# Counting -----------------------------------------------------------------------------------------


def _rows(chunks: DataFrame, make) -> DataFrame:
    """Pieces that ``make`` gives for the learnt parts of each chunk."""

    def run(batches):
        for _, chunk, learn in chunk_rows(batches):
            if learn.any():
                yield piece_rows(make(chunk.only(learn)))

    return chunks.select("learn", "sizes", "skips", "begins", "words", "codes").mapInArrow(run, PIECE)


def _sizes(rows, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(entries by shard, other sums) of the rows about shards themselves."""
    sizes, rest = np.zeros(n, np.int64), None
    for r in rows:
        sizes[-1 - r["shard"]] = r["sums"][0]
        more = np.array(r["sums"][1:], np.int64)
        rest = more if rest is None else rest + more
    return sizes, rest


def _of_counts(c: np.ndarray) -> list[int]:
    """How many are 1, 2, 3, 4; more than 2; the sum."""
    return [*(int((c == k).sum()) for k in range(1, 5)), int((c > 2).sum()), int(c.sum())]


def _follow(level: Level, context: np.ndarray, c: np.ndarray) -> list[tuple]:
    """Pieces for ``level``: of each context the sum of the counts of what follows, and how many are 1, 2, more."""
    ranks, *sums = summed(context, c, (c == 1).astype(np.int64), (c == 2).astype(np.int64), (c > 2).astype(np.int64))
    return dealt(level.owner(ranks.astype(np.int64)), "follow", ranks, None, np.stack(sums, axis=1)) if len(ranks) else []


def _left(level: Level, last: np.ndarray) -> list[tuple]:
    """Pieces for ``level``: how many distinct n-grams end in each."""
    ranks, sums = summed(last, np.ones(len(last), np.int64))
    return dealt(level.owner(ranks.astype(np.int64)), "left", ranks, None, sums) if len(ranks) else []


def train(chunks: DataFrame, n_shards: int, order: int = ORDER) -> Model:
    """The model of the learnt parts of stored chunks."""
    if not 2 <= order <= OVERLAP + 1:
        raise ValueError(f"orders 2 to {OVERLAP + 1}")
    spark, n = chunks.sparkSession, n_shards
    path = new_dir(spark, "lm")
    every = spark.range(n).select(F.col("id").cast("int").alias("shard"), F.lit("none").alias("kind"), *[F.lit(None).cast("binary").alias(c) for c in "abc"], F.lit(None).cast("array<long>").alias("sums"))

    def words(chunk: Chunk):
        counts = np.bincount(chunk.codes[chunk.own], minlength=len(chunk.words))
        seen = (counts > 0) | (chunk.words == BEGIN)
        keys, counts = chunk.words[seen], counts[seen]
        by = np.argsort(keys)
        return dealt(by_range(keys[by], n), "word", keys[by], None, counts[by])

    def merge_words(shard, rows):
        keys, counts = summed(of_kind(rows, "word", "a"), of_kind(rows, "word", "c").astype(np.int64))
        put_bytes(f"{path}/keys1-{shard}", keys.astype("<u8").tobytes())
        put_small(f"{path}/n1-{shard}", counts)
        return [(-1 - shard, "sums", None, None, None, [len(keys), int(counts.sum())])]

    sizes, rest = _sizes(merged(_rows(chunks, words), n, merge_words).collect(), n)
    model = Model(order, [Level(1, path, sizes)], int(rest[0]) if rest is not None else 0)
    if not model.tokens:
        model.levels += [Level(k, path, np.zeros(n, np.int64)) for k in range(2, order + 1)]
        return model
    given = {}  # what level k gives level k - 1
    for k in range(2, order + 1):
        release(spark)
        given[k] = _count_level(model, chunks, n, k, path)
    above = given[order]
    for k in range(order - 1, 0, -1):
        release(spark)
        spread = _spread(model, above.unionByName(every), n, k, path)
        above = spread.unionByName(given[k]) if k > 1 else None
        if k > 1:  # the level's arrays are whole: what they were made from can go
            for s in range(n):
                remove(spark, f"{path}/context{k}-{s}")
                remove(spark, f"{path}/own{k}-{s}")
    release(spark)
    return model


def _count_level(model: Model, chunks: DataFrame, n: int, k: int, path: str) -> DataFrame:
    """Finds the n-grams of order k, adds their level, and gives the pieces for the level below."""
    top, below = k == model.order, model.levels[-1]

    def grams(chunk: Chunk):
        r = model.ranks(model.levels[0].find(chunk.words)[chunk.codes], chunk, k - 1)[-1]
        i = chunk.ends(k)
        i = i[chunk.own[i]]
        a, b = r[i - 1], r[i]
        h = hash_of(a, b)
        by = np.argsort(h)
        at = firsts(h[by])
        counts, by = np.diff(np.append(at, len(h))), by[at]
        a, b, h = a[by], b[by], h[by]
        if not top:  # below the highest order only n-grams that begin a text have a count of their own
            starts = (np.repeat(chunk.begins, chunk.sizes) + chunk.offset)[i] == k - 1
            counts = np.where(starts[by], counts, 0)
        shard = by_range(h, n)
        by = np.argsort((shard << 48) | a)
        return dealt(shard[by], "gram", a[by].astype(np.uint64), least_width(b[by]), counts[by])

    def merge(shard, rows):
        a, b, c = (of_kind(rows, "gram", x) for x in "abc")
        h = hash_of(a, b)
        by = np.argsort(h)
        at = firsts(h[by])
        c = np.add.reduceat(c[by].astype(np.int64), at) if len(at) else c.astype(np.int64)
        by = by[at]
        a, b, h = a[by], b[by], h[by]
        put_keys(f"{path}/keys{k}-{shard}", h, shard, n)
        if top:
            put_small(f"{path}/c{k}-{shard}", c)
        else:
            own = np.flatnonzero(c)
            put_bytes(f"{path}/own{k}-{shard}", np.stack([own, c[own]]).astype("<i8").tobytes())
            put_bytes(f"{path}/context{k}-{shard}", pack(least_width(a), False))
        out = (_follow(below, a, c) if top else []) + _left(below, b)
        return [*out, (-1 - shard, "sums", None, None, None, [len(h), *_of_counts(c)])]

    made = materialize(merged(_rows(chunks, grams), n, merge), f"lm-{k}")
    sizes, of = _sizes(made.filter("shard < 0").select("shard", "sums").collect(), n)
    model.levels.append(Level(k, path, sizes))
    if top:
        model.discounts[k] = discounts(np.append(0, of[:4]))
    return made.filter("shard >= 0")


def _spread(model: Model, rows: DataFrame, n: int, k: int, path: str) -> DataFrame:
    """Writes the counts of level k and the sums of its contexts, from the pieces that the level above gave."""
    level, below = model.levels[k - 1], model.levels[k - 2] if k > 1 else None

    def merge(shard, found):
        base, size = int(level.bases[shard]), int(level.sizes[shard])
        c, f = np.zeros(size, np.int64), np.zeros((size, 4), np.int64)
        np.add.at(c, of_kind(found, "left", "a").astype(np.int64) - base, of_kind(found, "left", "c").astype(np.int64))
        np.add.at(f, of_kind(found, "follow", "a").astype(np.int64) - base, of_kind(found, "follow", "c").astype(np.int64).reshape(-1, 4))
        out = []
        if k > 1:
            at, own = level.array("own", shard, "<i8").reshape(2, -1)
            c[at] += own
            out = _follow(below, unpack(bytes(level.array("context", shard, np.uint8))).astype(np.uint64), c) if size else []
        put_small(f"{path}/c{k}-{shard}", c)
        put_small(f"{path}/f{k}-{shard}", f.reshape(-1))
        return [*out, (-1 - shard, "sums", None, None, None, [size, *_of_counts(c)])]

    made = materialize(merged(rows, n, merge), f"lm-spread-{k}")
    _, of = _sizes(made.filter("shard < 0").select("shard", "sums").collect(), n)
    model.discounts[k] = d = discounts(np.append(0, of[:4]))
    if k == 1:
        model.kinds = int(of[5])
        model.gap = float(d[1] * of[0] + d[2] * of[1] + d[3] * of[4]) / model.kinds
    return made.filter("shard >= 0")


def score(chunks: DataFrame, model: Model) -> DataFrame:
    """(row, doc_id, n_tokens, n_known, base_score, score) of each part of a text; workers map the model's arrays."""

    def run(batches):
        norm = np.log10(model.tokens + model.v + 1)
        for part, chunk, _ in chunk_rows(batches):
            first, seen = model.levels[0].look(chunk.words, lambda r: (model.levels[0].values("n", r)[:, 0],))
            first, seen, own = first[chunk.codes], seen[chunk.codes], chunk.own
            at = np.cumsum(chunk.sizes) - chunk.sizes
            sums = lambda x, at=at, own=own: np.add.reduceat(np.where(own, x, 0), at)
            cols = [part.column("rows").flatten(), part.column("doc_ids").flatten(), pa.array(chunk.sizes - chunk.skips, pa.int64()), pa.array(sums((seen > 0).astype(np.int64)), pa.int64()), pa.array(sums(np.log10(seen + 1.0) - norm), pa.float64()), pa.array(sums(model.log10(first, chunk)), pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "n_tokens", "n_known", "base_score", "score"])

    kind = chunks.schema["doc_ids"].dataType.elementType.simpleString()
    return chunks.mapInArrow(run, f"row long, doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def shards_for(texts: DataFrame, shard_bytes: int = SHARD_BYTES) -> int:
    """As many shards as the bytes of the column ``text`` need."""
    n = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(min(MOST_SHARDS, max(1, -(-n // shard_bytes))))


def report(docs: DataFrame, order: int = ORDER, shard_bytes: int = SHARD_BYTES, chunk: int = CHUNK, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity; the held-out fold isn't learned from."""
    learn = ~held_out(F.col("doc_id"))
    chunks = tokenized(docs, learn, chunk, piece_bytes)
    model = train(chunks, shards_for(docs.filter(learn), shard_bytes), order)
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    out = score(chunks, model).groupBy("row").agg(F.first("doc_id").alias("doc_id"), *sums)
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), F.least(F.lit(300.0), -F.col("score") / F.col("n_tokens"))).alias("perplexity"),
    )


def crc_fold(doc_id) -> int:
    return zlib.crc32(str(doc_id if doc_id is not None else "").encode()) % FOLDS
