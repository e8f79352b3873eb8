"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores the corpus's postings: the index is parted by documents,
a row for each segment of about SEGMENT_WORDS words, which has the sorted
hashes of its terms and the positions of each.  ``match`` sends the test
phrases to the segments in blocks; a segment drops every phrase that has a term
it lacks, then starts from a phrase's rarest term and intersects the
offset-adjusted lists of the next rarest ones until none or the matches are
left.  Exact matches are those of whole lists; proximity matches allow each
term SLOP places off its own.

Since postings never leave their segment, a term that is in every document
makes no task larger than its segment.

Defined results: a null or empty text has no words and is in no match; an item
without words has no window, one of under WINDOW words is one window; items
that share an id count once, and a window that several have is looked for once;
of equally rare terms the first goes first; repeated rows are each reported; empty tables give
an empty result (documents) or no hits (items); texts of any length are indexed
whole, in a segment of their own if need be; further columns pass through
``drop_contaminated``.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import get_bytes, materialize, new_dir, put_bytes, text_hash, texts_of

WINDOW = 10
SLOP = 2
SEGMENT_WORDS = 1_000_000
#: Places left between documents, so that no match spans two.
GAP = 64
#: Characters of test items that are sent to the segments at once.
BLOCK_CHARS = 4_000_000

#: Every byte that is no part of a word is a space; A-Z are lower-cased.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def term_hashes(text: bytes) -> np.ndarray:
    w = words(text)
    return np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))


class Segment:
    """Sorted term hashes, where each one's positions begin, and all positions."""

    def __init__(self, terms: np.ndarray, starts: np.ndarray, places: np.ndarray):
        self.terms, self.starts, self.places = terms, starts, places

    @classmethod
    def of(cls, hashes: np.ndarray, places: np.ndarray) -> Segment:
        order = np.argsort(hashes, kind="stable")
        terms, starts = np.unique(hashes[order], return_index=True)
        return cls(terms, np.append(starts, len(hashes)).astype(np.uint32), places[order].astype(np.uint32))

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Index of each term, or -1."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == terms, at, -1) if len(self.terms) else np.full(len(terms), -1)

    def postings(self, k: int) -> np.ndarray:
        return self.places[self.starts[k] : self.starts[k + 1]].astype(np.int64)


class Phrases:
    """Distinct windows of test items: rows of term numbers (-1 beyond their end), and which items have each."""

    def __init__(self, items: list[tuple[str, bytes]], width: int = WINDOW):
        rows, owners, all_terms = {}, [], {}
        for item, text in items:
            h = [all_terms.setdefault(x, len(all_terms)) for x in term_hashes(text).tolist()]
            for i in range(max(1, len(h) - width + 1) if h else 0):
                k = rows.setdefault(tuple(h[i : i + width]), len(rows))
                if k == len(owners):
                    owners.append({})
                owners[k][item] = None
        self.width, self.owners = width, [tuple(x) for x in owners]
        self.terms = np.array(list(all_terms), np.uint64)
        self.windows = np.full((len(rows), width), -1, np.int64)
        for row, k in rows.items():
            self.windows[k, : len(row)] = row

    def match(self, segment: Segment, slop: int):
        """(window, starts, near): where it is exactly, and the places of its rarest term which have the rest within slop only."""
        found = segment.find(self.terms) if len(self.terms) else np.empty(0, np.int64)
        if not len(self.windows) or not (found >= 0).any():
            return
        padded = np.append(found, 0)  # -1, beyond the end, is always present
        for k in np.nonzero((padded[self.windows] >= 0).all(1))[0]:
            row = self.windows[k]
            lists = sorted(((segment.postings(found[t]), o) for o, t in enumerate(row[row >= 0])), key=lambda x: len(x[0]))
            anchors, at = lists[0]
            near = anchors
            for places, o in lists[1:]:
                near = near[_within(places, near + (o - at), slop)]
                if not len(near):
                    break
            if not len(near):
                continue
            exact = near
            for places, o in lists[1:]:
                exact = exact[_within(places, exact + (o - at), 0)]
            yield int(k), exact - at, np.setdiff1d(near, exact, assume_unique=True)


def _within(sorted_places: np.ndarray, want: np.ndarray, slop: int) -> np.ndarray:
    i = np.searchsorted(sorted_places, want - slop)
    ok = i < len(sorted_places)
    ok[ok] = sorted_places[i[ok]] <= want[ok] + slop
    return ok


def build_index(docs: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The stored index: segment, doc_ids, text_hashes, n_words and bases (by document), terms, starts, places."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        part, k, held, count, id_type = TaskContext.get().partitionId(), 0, [], 0, pa.int64()

        def flush():
            n = np.array([len(h) for *_, h in held], np.int64)
            bases = np.cumsum(n + GAP) - n
            seg = Segment.of(np.concatenate([h for *_, h in held]), np.concatenate([np.arange(b, b + m) for b, m in zip(bases, n)]))
            one = lambda x, t: pa.array([x], pa.list_(t))
            names = ["segment", "doc_ids", "text_hashes", "n_words", "bases", "terms", "starts", "places"]
            arrays = [pa.array([f"{part}-{k}"]), one([h[0] for h in held], id_type), one([h[1] for h in held], pa.int64()), one(n, pa.int64()), one(bases, pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in (seg.terms, seg.starts, seg.places)]]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for i, t, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), texts_of(batch)):
                held.append((i, t, term_hashes(text)))
                count += len(held[-1][2])
                if count >= segment_words or len(held) >= segment_words // 8:
                    yield flush()
                    k, held, count = k + 1, [], 0
        if held:
            yield flush()

    index = docs.select("doc_id", text_hash().alias("text_hash"), "text").mapInArrow(
        run, f"segment string, doc_ids array<{kind}>, text_hashes array<long>, n_words array<long>, bases array<long>, terms binary, starts binary, places binary"
    )
    return materialize(index, "postings")


def item_blocks(items: DataFrame, block_chars: int = BLOCK_CHARS):
    """The test items (id as text, UTF-8 text) in blocks of bounded size; they come to the driver a partition at a time."""
    block, size = [], 0
    for r in items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce("text", F.lit("")).alias("t")).toLocalIterator():
        block.append((r["i"], r["t"].encode()))
        size += len(r["t"]) + 16
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


MATCHES = "segment string, ord int, items array<string>, spans array<struct<start:int,end:int>>, n_near long"


def match(index: DataFrame, items: DataFrame, width: int = WINDOW, slop: int = SLOP, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each block of items and document with a match: items and merged word spans of exact matches, and the number of proximity matches that aren't exact.

    The blocks' phrases are files in the shared folder.  The index is read once: a
    task has one block at a time in memory and goes through them for each batch of segments.
    """
    spark, folder, paths = index.sparkSession, new_dir(index.sparkSession, "phrases"), []
    for block in item_blocks(items, block_chars):
        paths.append(f"{folder}/{len(paths)}")
        put_bytes(paths[-1], pickle.dumps(Phrases(block, width)))
    if not paths:
        return spark.createDataFrame([], MATCHES)

    def run(batches):
        path, phrases = None, None
        for batch in batches:
            for p in paths:
                if p != path:
                    path, phrases = p, None  # the last block goes before the next is read
                    phrases = pickle.loads(get_bytes(p))
                for r in range(batch.num_rows):
                    yield _matches(batch, r, phrases, slop)

    return index.select("segment", "bases", "terms", "starts", "places").mapInArrow(run, MATCHES)


MATCH_SCHEMA = pa.schema([("segment", pa.string()), ("ord", pa.int32()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("n_near", pa.int64())])


def _matches(batch: pa.RecordBatch, r: int, phrases: Phrases, slop: int) -> pa.RecordBatch:
    """MATCHES of the segment in row r."""
    get = lambda name: batch.column(name)[r]
    raw = lambda name, dtype: np.frombuffer(get(name).as_buffer(), dtype)
    segment = Segment(raw("terms", np.uint64), raw("starts", np.uint32), raw("places", np.uint32))
    bases = get("bases").values.to_numpy()
    rows: dict[int, list] = {}
    for k, starts, near in phrases.match(segment, slop):
        size = int((phrases.windows[k] >= 0).sum())
        docs = np.searchsorted(bases, starts, "right") - 1
        for d, s in zip(docs.tolist(), (starts - bases[docs]).tolist()):
            row = rows.setdefault(d, [set(), [], 0])
            row[0].update(phrases.owners[k])
            row[1].append((s, s + size))
        for d in (np.searchsorted(bases, near, "right") - 1).tolist():
            rows.setdefault(d, [set(), [], 0])[2] += 1
    seg = get("segment").as_py()
    out = [{"segment": seg, "ord": d, "items": sorted(i), "spans": [{"start": a, "end": b} for a, b in merged(s)], "n_near": n} for d, (i, s, n) in rows.items()]
    return pa.RecordBatch.from_pylist(out, MATCH_SCHEMA)


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def documents_of(index: DataFrame) -> DataFrame:
    """(segment, ord, doc_id, text_hash, n_words) of an index."""
    return index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "text_hashes", "n_words")).alias("ord", "d")).select("segment", "ord", F.col("d.doc_ids").alias("doc_id"), F.col("d.text_hashes").alias("text_hash"), F.col("d.n_words").alias("n_words"))


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW, slop: int = SLOP, segment_words: int = SEGMENT_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Each document with n_words, n_hit, items (sorted ids), spans, n_near."""
    index = build_index(docs, segment_words)
    found = match(index, items, width, slop, block_chars)
    spans = F.array_sort(F.flatten(F.collect_list("spans")))
    by_doc = found.groupBy("segment", "ord").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), spans.alias("spans"), F.sum("n_near").alias("n_near"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    cover = F.aggregate("spans", zero, lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], s["end"]))).alias("n"), F.greatest(s["end"], x["end"]).alias("end")))["n"]
    j = documents_of(index).join(by_doc.withColumn("n_hit", cover), ["segment", "ord"], "left")
    none = F.expr("cast(array() as array<string>)")
    return j.select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), "spans", F.coalesce("n_near", F.lit(0)).alias("n_near"))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near."""
    return contamination(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near",
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without an exact match; rows are known by doc_id and text hash."""
    bad = contamination(docs, items).filter("n_hit > 0").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    bad = materialize(bad, "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (text_hash(docs["text"]) == bad["bad_hash"]), "left_anti")
