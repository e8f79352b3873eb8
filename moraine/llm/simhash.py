"""SimHash near-duplicates by multi-index hashing.

Fingerprints (64 bits over the XXH64 of word shingles) are made distinct first,
so a group of exact copies is one row.  Each is filed under its two 32-bit
segments.  Two fingerprints at 3 bits or fewer differ in at most 1 bit of some
segment: each probes its segment's value and, of the ball of radius 1, the
values with one more bit set (the other half of the ball is found from the
other side), and whole distances are verified.

A segment value that very many distinct fingerprints share (HEAVY or more)
would give all pairs of a dense cluster.  There the links are found through
midpoints instead, in linear work: two members at 3 bits or fewer have a point
at 1 bit or fewer of the one and at 2 or fewer of the other, so members are tied
to a member near the point.  This leaves out no link's connection.

Components come from star contraction.  Neither fingerprints nor links nor
components are collected.

For similarities that 3 bits don't reach, as in ``similar``, a text has several
fingerprints over its set of shingles (``set_fingerprints``), each filed under
three segments of 21 or 22 bits; ``near_pairs`` probes balls of radius 1 and
verifies whole distances in the same way.  The texts of a segment's first bits
meet in one group, so that only flips of these bits are rows, and a pair is a
row once its distance in all fingerprints is verified.  Texts that probe a
segment value that CROWD or more share are left to the caller, which compares
them exactly.

Defined results: a null or empty text, or one without words, has fingerprint
zero, which links like any other; repeated rows share a component; a null
doc_id takes part but never names a component; an empty table gives an empty
result; texts of any length are hashed whole; further columns pass through
``one_of_each``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_small, join_small, materialize, text_hash, texts_of
from .components import components
from .urls import maybe_in

SHINGLE = 3
SEED = 42
DISTANCE = 3
HEAVY = 1024
MASK = 0xFFFFFFFF
#: Hashes whose bits are counted at once, to bound memory.
BITS_AT_ONCE = 65_536
#: Fingerprints of a set, their segments (first bit, bits), and the bits by which a candidate pair may differ in the one that names it and in all.
PRINTS = 6
SEGMENTS = [(0, 21), (21, 21), (42, 22)]
APART, APART_IN_ALL = 20, 90
#: Texts from which on a segment value is crowded.
CROWD = 32
#: First bits of a segment that name its group, rows beyond which there are more of them, and pairs of a group compared at once.
FIRST, ROWS_BY_FIRST = 4, 1 << 20
PAIRS_AT_ONCE = 1 << 20
#: Hashes of a set whose bits are counted at once; sums of 255 fit a byte.
SUM = 255
SET_AT_ONCE = 32 * SUM

_SALTS = np.random.default_rng(SEED).integers(0, 2**64, PRINTS, np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A-Z lower-cased; bytes.split() parts at space and controls 9 to 13."""
    words = text.lower().split()
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return h(joined, seed) if len(words) else 0
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = (end - size)[: len(words) - shingle + 1].tolist()
    end = end[shingle - 1 :].tolist()
    counts, n = np.zeros(64, np.int64), len(begin)
    for at in range(0, n, BITS_AT_ONCE):
        hs = np.array([h(joined[a:b], seed) for a, b in zip(begin[at : at + BITS_AT_ONCE], end[at : at + BITS_AT_ONCE])], "<u8")
        counts += np.unpackbits(hs.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp): fp is the fingerprint's 64 bits as a long."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(x) for x in texts_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(fp, pa.int64())], ["doc_id", "text_hash", "fp"])

    return docs.select("doc_id", text_hash().alias("text_hash"), "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long")


def set_fingerprints(hashes: np.ndarray) -> np.ndarray:
    """The PRINTS fingerprints of a set of 64-bit hashes, sorted: of each a mix of the hashes of its own.

    Of an even number the least counts twice, so that no bit is a tie, which
    would make fingerprints of small sets alike.
    """
    if len(hashes) % 2 == 0:
        hashes = np.append(hashes, hashes[0])
    counts = np.zeros((PRINTS, 64), np.int64)
    for at in range(0, len(hashes), SET_AT_ONCE):
        x = (hashes[at : at + SET_AT_ONCE] ^ _SALTS[:, None]) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        full = np.zeros((PRINTS, -(-x.shape[1] // SUM) * SUM), "<u8")
        full[:, : x.shape[1]] = x ^ (x >> np.uint64(29))
        bits = np.unpackbits(full.view(np.uint8).reshape(PRINTS, -1, SUM, 8), axis=3, bitorder="little")
        counts += bits.sum(2, dtype=np.uint8).sum(1, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), axis=1, bitorder="little").view("<u8")[:, 0]


def _flip(c: Column, bit: Column) -> Column:
    return c.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int")))


def _is_set(c: Column, bit: Column) -> Column:
    return F.call_function("shiftright", c, bit.cast("int")).bitwiseAND(F.lit(1)) == 1


def filed(fps: DataFrame) -> DataFrame:
    """(j, seg, rest, fp): each fingerprint under either of its segments."""
    low, high = F.col("fp").bitwiseAND(F.lit(MASK)), F.shiftrightunsigned("fp", 32)
    both = F.array(F.struct(F.lit(0).alias("j"), low.alias("seg"), high.alias("rest")), F.struct(F.lit(1).alias("j"), high.alias("seg"), low.alias("rest")))
    return fps.select("fp", F.explode(both).alias("x")).select("x.j", "x.seg", "x.rest", "fp")


def links(fps: DataFrame, distance: int = DISTANCE, heavy: int = HEAVY) -> DataFrame:
    """(a, b): links between distinct fingerprints fps (column fp).

    Beyond heavy buckets these are all pairs at ``distance`` or fewer; of heavy
    ones, true links that connect the same components.
    """
    if distance > 3:
        raise ValueError("two segments of which one differs in at most 1 bit: distances to 3")
    table = materialize(filed(fps), "simhash-table")
    crowded = materialize(table.groupBy("j", "seg").count().filter(F.col("count") >= heavy).select("j", "seg", F.lit(True).alias("crowded")), "simhash-crowded")
    dense = not crowded.isEmpty()
    if dense:
        table = table.join(crowded, ["j", "seg"], "left")
    bits = F.sequence(F.lit(-1), F.lit(31))
    ball = table.withColumn("bit", F.explode(F.filter(bits, lambda b: (b < 0) | ~_is_set(F.col("seg"), F.greatest(b, F.lit(0))))))
    probe = ball.withColumn("want", F.when(F.col("bit") < 0, F.col("seg")).otherwise(_flip(F.col("seg"), F.greatest("bit", F.lit(0)))))
    p, t = probe.alias("p"), table.alias("t")
    near = F.bit_count(F.col("p.fp").bitwiseXOR(F.col("t.fp"))) <= distance
    once = (F.col("p.bit") >= 0) | (F.col("p.fp") < F.col("t.fp"))
    if not dense:
        return p.join(t, (F.col("p.j") == F.col("t.j")) & (F.col("p.want") == F.col("t.seg"))).filter(near & once).select(F.col("p.fp").alias("a"), F.col("t.fp").alias("b"))
    # a probe between buckets of which one is crowded goes by midpoints
    target = crowded.select("j", F.col("seg").alias("want"), F.col("crowded").alias("crowded2"))
    probe = materialize(probe.join(target, ["j", "want"], "left").withColumn("by_point", F.col("crowded2").isNotNull() | F.col("crowded").isNotNull()), "simhash-probes")
    p = probe.filter(~F.col("by_point")).alias("p")
    pairs = p.join(t, (F.col("p.j") == F.col("t.j")) & (F.col("p.want") == F.col("t.seg"))).filter(near & once).select(F.col("p.fp").alias("a"), F.col("t.fp").alias("b"))
    return pairs.union(midpoint_links(table, probe.filter("by_point").select("j", "seg", "bit", "want", "rest", "fp"), distance))


def midpoint_links(table: DataFrame, probe: DataFrame, distance: int) -> DataFrame:
    """Links through points for the probes (j, seg, bit, want); linear in the members of the buckets.

    In one bucket (bit < 0) the rests may differ in ``distance`` bits, between
    two (bit >= 0) in one less.  A point's tie is to its least member within 1
    bit; members at 1 bit or fewer tie to it, and in one bucket those at 2.
    Distances are verified, so a point gives true links alone.
    """
    one = F.concat(F.array(F.col("rest")), F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: _flip(F.col("rest"), b)))
    two = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(31)), lambda b: F.transform(F.sequence(F.lit(0), b - 1), lambda c: _flip(_flip(F.col("rest"), b), c))))
    own = probe.filter("bit < 0").select("j", F.col("seg").alias("k1"), F.col("seg").alias("k2"), "rest", "fp")
    left = probe.filter("bit >= 0").select("j", F.col("seg").alias("k1"), F.col("want").alias("k2"), "rest", "fp")
    ways = left.select("j", "k1", "k2").distinct()
    right = table.select("j", F.col("seg").alias("k2"), "rest", "fp").join(ways, ["j", "k2"]).select("j", "k1", "k2", "rest", "fp")
    members = own.union(left).union(right)
    points = members.select("j", "k1", "k2", "fp", F.explode(one).alias("m"))
    centres = points.groupBy("j", "k1", "k2", "m").agg(F.min("fp").alias("centre"))
    far = own.select("j", "k1", "k2", "fp", F.explode(two).alias("m"))
    tied = points.union(far).join(centres, ["j", "k1", "k2", "m"]).filter("fp <> centre")
    return tied.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("centre"))) <= distance).select(F.col("centre").alias("a"), F.col("fp").alias("b")).distinct()


def _under(fp: Column, n: int, ball: bool) -> Column:
    """The keys of fingerprint number n: its segments or, as probes, those and the values with one more bit set."""
    keys = []
    for j, (at, width) in enumerate(SEGMENTS):
        seg, number = F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)), F.lit((n * len(SEGMENTS) + j) << 32)
        unset = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda b: ~_is_set(seg, b))  # noqa: B023
        more = F.transform(unset, lambda b: _flip(seg, b) + number)  # noqa: B023
        keys.append(F.concat(F.array(seg + number), more) if ball else F.array(seg + number))
    return F.concat(*keys)


def _keyed(prints: DataFrame, ball: bool) -> DataFrame:
    """(key, t): the rows of prints (t, fps) by the keys of all their fingerprints."""
    return prints.select(F.explode(F.concat(*[_under(F.col("fps")[n], n, ball) for n in range(PRINTS)])).alias("key"), "t")


def crowds(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(key, t, n): the rows of prints (t, fps) under segment values that n of them, crowd or more, share."""
    own = _keyed(prints, False)
    keys = materialize(own.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= crowd), "simhash-crowded-keys")
    return materialize(join_small(own, keys, "key", "inner"), "simhash-crowds")


def print_columns() -> list[Column]:
    """The fingerprints as columns f0, f1 and so on."""
    return [F.col("fps")[n].alias(f"f{n}") for n in range(PRINTS)]


def prints_in(table: pa.Table) -> np.ndarray:
    """Those columns, a row for each fingerprint."""
    return np.stack([table.column(f"f{n}").to_numpy() for n in range(PRINTS)]).view(np.uint64)


def probing(prints: DataFrame, filed: DataFrame) -> DataFrame:
    """(key, t): the rows of prints that probe a crowded key, and so all that are under one; filed: their ``crowds``."""
    keys, probes = materialize(filed.select("key").distinct(), "simhash-crowded-keys"), _keyed(prints, True)
    if not is_small(keys):
        probes = maybe_in(probes, "key", keys, keys.count())
    return materialize(join_small(probes, keys, "key", "left_semi"), "simhash-probing")


def _met(f: np.ndarray, a: np.ndarray, b: np.ndarray, number: int) -> np.ndarray:
    """Whether rows a and b of the fingerprints f are near, and segment ``number`` is the first that has them meet."""
    near, met = np.zeros(len(a), np.int64), np.zeros(len(a), bool)
    for n in range(PRINTS):
        apart = f[n][a] ^ f[n][b]
        bits = np.bitwise_count(apart)
        near += bits
        for j, (at, width) in enumerate(SEGMENTS):
            if n * len(SEGMENTS) + j < number:
                met |= (bits <= APART) & (np.bitwise_count(apart >> np.uint64(at) & np.uint64((1 << width) - 1)) <= 1)
    return (near <= APART_IN_ALL) & ~met


def near_pairs(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b): pairs of prints (t, fps, c, crowded) that in some fingerprint differ in at most 1 bit of a segment and in APART bits, and in APART_IN_ALL in all.

    All such pairs, each once, but those of one c and those of which both are
    crowded; the rows that ``probing`` has under a segment value that ``crowd``
    or more share have to be of one c or all crowded.
    """
    first = max(FIRST, (prints.count() // ROWS_BY_FIRST).bit_length())

    def groups(number: int) -> Column:
        """The group of a row by segment ``number``, and those of its flips, which have a 0 as last bit."""
        n, (at, width) = number // len(SEGMENTS), SEGMENTS[number % len(SEGMENTS)]
        head = F.shiftrightunsigned(F.col("fps")[n], at + width - first).bitwiseAND(F.lit((1 << first) - 1)).bitwiseOR(F.lit(number << first).cast("long"))
        unset = F.filter(F.sequence(F.lit(0), F.lit(first - 1)), lambda b: ~_is_set(head, b))
        return F.concat(F.array(head * 2 + 1), F.transform(unset, lambda b: _flip(head, b) * 2))

    def run(key, table):
        number = key[0].as_py() >> first
        n, (at, width) = number // len(SEGMENTS), SEGMENTS[number % len(SEGMENTS)]
        rest = width - first
        t, c, own, crowded = (table.column(x).to_numpy() for x in ("t", "c", "own", "crowded"))
        f = prints_in(table)
        seg = (f[n] >> np.uint64(at) & np.uint64((1 << rest) - 1)).astype(np.int64)
        filed = np.flatnonzero(own)
        filed = filed[np.argsort(seg[filed], kind="stable")]
        count = np.bincount(seg[filed], minlength=1 << rest)
        begin = np.cumsum(count) - count
        # of a crowded value the rows that probe it, and so all its own, are the caller's
        count[count >= crowd] = 0
        found = []

        def probe(rows: np.ndarray, want: np.ndarray, once: bool) -> None:
            many = count[want]
            rows, want, many = rows[many > 0], want[many > 0], many[many > 0]
            ends = np.cumsum(many)
            cuts = np.searchsorted(ends, np.arange(PAIRS_AT_ONCE, ends[-1] if len(ends) else 0, PAIRS_AT_ONCE))
            for x, y, k in zip(*(np.split(v, cuts) for v in (rows, want, many))):
                a = np.repeat(x, k)
                b = filed[np.repeat(begin[y] - (np.cumsum(k) - k), k) + np.arange(len(a))]
                keep = np.bitwise_count(f[n][a] ^ f[n][b]) <= APART
                keep &= (t[a] < t[b]) if once else (t[a] != t[b])
                a, b = a[keep], b[keep]
                keep = (c[a] != c[b]) & ~(crowded[a] & crowded[b])
                a, b = a[keep], b[keep]
                keep = _met(f, a, b, number)
                found.append(np.stack([t[a[keep]], t[b[keep]]]))

        probe(filed, seg[filed], True)
        flipped = np.flatnonzero(~own)
        probe(flipped, seg[flipped], False)
        for bit in range(rest):
            rows = filed[seg[filed] >> bit & 1 == 0]
            probe(rows, seg[rows] | 1 << bit, False)
        pairs = np.sort(np.concatenate([np.empty((2, 0), np.int64), *found], axis=1), axis=0)
        return pa.table({"a": pairs[0], "b": pairs[1]})

    x = prints.select("t", "c", "crowded", *print_columns(), F.explode(F.concat(*[groups(k) for k in range(PRINTS * len(SEGMENTS))])).alias("x"))
    x = x.select(F.shiftright("x", 1).alias("g"), (F.col("x") % 2 == 1).alias("own"), "t", "c", "crowded", *[f"f{n}" for n in range(PRINTS)])
    return x.groupBy("g").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, text_hash, fp, component, component_id): component_id is the least doc_id of the component."""
    prints = materialize(fingerprints(docs), "simhash-prints")
    fps = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
    found = components(links(fps.select("fp"), distance, heavy))
    member = fps.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component"))
    names = member.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_fp = materialize(member.join(names, "component").select("fp", "component", "component_id"), "simhash-components")
    return prints.join(of_fp, "fp").select("doc_id", "text_hash", "fp", "component", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, find=near_duplicates) -> DataFrame:
    """The rows of ``docs``, one for each component of ``find``: that of its least doc_id, then least text hash.

    A row is known by doc_id and text hash; of rows alike in both one stays,
    that whose other columns come first as JSON text, so reruns agree.  What
    goes is the smaller side of the last join, and only repeated rows are
    shuffled whole.
    """
    found = materialize(find(docs).select("doc_id", "text_hash", "component"), "simhash-members")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")
    best = found.groupBy("component").agg(F.min(order).alias("best")).withColumnRenamed("component", "c")
    members = found.distinct()
    gone = members.join(best, F.col("component") == F.col("c")).filter(order != F.col("best")).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
    known = lambda x, i, h: F.col("known.doc_id").eqNullSafe(F.col(f"{x}.{i}")) & (F.col("known.text_hash") == F.col(f"{x}.{h}"))
    every = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*every).alias("row"), F.struct("doc_id", text_hash().alias("text_hash")).alias("known"))
    left = rows.join(gone.alias("g"), known("g", "gone_id", "gone_hash"), "left_anti")
    repeated = materialize(found.groupBy("doc_id", "text_hash").count().filter("count > 1").select("doc_id", "text_hash"), "simhash-repeated").alias("r")
    if repeated.isEmpty():
        return left.select("row.*")
    rest = F.to_json(F.struct(F.lit(0).alias("_"), *[F.col(f"row.`{c}`") for c in docs.columns if c != "text"]))
    same = known("r", "doc_id", "text_hash")
    one = left.join(repeated, same, "left_semi").groupBy("known").agg(F.min_by("row", rest).alias("row"))
    return left.join(repeated, same, "left_anti").select("row.*").union(one.select("row.*"))
