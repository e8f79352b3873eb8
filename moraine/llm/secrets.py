"""Secret scan: patterns, and sliding-window Shannon entropy per character class over candidate strings.

Candidates are runs of key-like characters.  Within a candidate every maximal
run of one class (hex, base64) is scanned with a window whose character counts
are kept incrementally; windows whose entropy reaches the class's threshold are
merged into a span.  An allow-list suppresses such spans, never pattern spans:
fixed strings, and strings built like words (see ``wordlike``).

Whole texts are scanned, in one pass without a shuffle.  Defined results: a null
or empty text has no spans; a text of any length is scanned whole, in time that
grows with it alone; repeated rows and equal texts get equal results; spans that
begin at one place come in the order of KINDS; positions are code points; an
empty table gives none; further columns are not looked at by ``scan``.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Of [0-9a-f]+, whose runs are whole matches, those that are long enough.
HEX_LONG = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "entropy")

#: What an entropy candidate is: a run of key-like characters.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: class: (its characters, bits per character that a window must reach)
CLASSES = {
    "hex": (frozenset("0123456789abcdefABCDEF"), 3.0),
    "base64": (frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), 3.7),
}
#: Strings that look random and aren't secret: digests of the empty string, UUIDs, numbers, runs of one character.
ALLOWED = re.compile(
    r"d41d8cd98f00b204e9800998ecf8427e"
    r"|da39a3ee5e6b4b0d3255bfef95601890afd80709"
    r"|e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
    r"|[0-9+/_=-]+"
    r"|(.)\1+"
)

# What words look like, for the allow-list.
SIGNS = re.compile(r"[-_/=+]+")
PART = re.compile(r"([A-Za-z]*)([0-9]*)")
CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
CONSONANTS = re.compile(r"[bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ]+")
LONGEST_WORD, LONGEST_NUMBER = 24, 8
#: Letters a word has on average at least, the share of vowels (with y) between which words are, and consonants in a row at most.
MEAN_WORD, VOWELS, MOST_CONSONANTS = 3.25, (0.28, 0.7), 5
_N_LOG = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def wordlike(s: str) -> bool:
    """Whether signs part ``s`` into words, each with a short number after it at most, or short numbers.

    Words are split where their case turns (aWordLikeThis); random letters
    give very short words, long ones, few vowels or rows of consonants.
    """
    letters = words = 0
    for part in SIGNS.split(s):
        m = PART.fullmatch(part)
        if not m or len(m.group(2)) > LONGEST_NUMBER:
            return False
        for w in CAMEL.findall(m.group(1)):
            if len(w) > LONGEST_WORD or any(len(c) > MOST_CONSONANTS for c in CONSONANTS.findall(w)):
                return False
            letters, words = letters + len(w), words + 1
    if not words:
        return True
    vowels = sum(map(s.lower().count, "aeiouy"))
    return letters >= MEAN_WORD * words and VOWELS[0] * letters <= vowels <= VOWELS[1] * letters


def allowed(s: str) -> bool:
    return ALLOWED.fullmatch(s) is not None or wordlike(s)


def windows(s: str, chars: frozenset, least: float, width: int = WINDOW) -> list[tuple[int, int]]:
    """Merged (start, end) of the windows over ``s``, within runs of ``chars``, whose entropy reaches ``least`` bits.

    With counts c of ``width`` characters the entropy is log2(width) - sum(c log2 c) / width; a
    step takes the old character out and then the new one in, so it costs the same for any width.
    """
    spans: list[tuple[int, int]] = []
    n_log = _N_LOG if width <= WINDOW else [0.0] + [n * math.log2(n) for n in range(1, width + 1)]
    bound = (math.log2(width) - least) * width + 1e-9
    counts: dict[str, int] = {}
    begin, total = 0, 0.0
    for i, c in enumerate(s):
        if c not in chars:
            counts, total, begin = {}, 0.0, i + 1
            continue
        if i - begin >= width:
            old = s[i - width]
            n = counts[old]
            counts[old] = n - 1
            total += n_log[n - 1] - n_log[n]
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += n_log[n + 1] - n_log[n]
        if i - begin >= width - 1 and total <= bound:
            start = i - width + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def entropy_spans(text: str, allow=allowed, classes=CLASSES) -> list[tuple[int, int]]:
    """Spans of text that some class finds random, merged; candidates or spans that ``allow`` knows are left out."""
    found: list[tuple[int, int]] = []
    for m in CANDIDATE.finditer(text):
        s = m.group()
        if allow(s):
            continue
        for a, b in sorted(x for chars, least in classes.values() for x in windows(s, chars, least)):
            if allow(s[a:b]):
                continue
            a, b = a + m.start(), b + m.start()
            if found and a <= found[-1][1]:
                found[-1] = (found[-1][0], max(b, found[-1][1]))
            else:
                found.append((a, b))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns' matches, sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]
    return sorted(out)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): spans is an array of struct(kind, start, end), by start and then kind."""

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                spans = base_spans(text)
                spans += [(a, 3, b) for a, b in entropy_spans(text)]
                rows.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(spans)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.list_(SPAN))], ["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text").mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:int,end:int>>")


def scan_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans (as text)."""
    from pyspark.sql import functions as F

    base = F.filter("spans", lambda x: x["kind"] != "entropy")
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return scan(docs).select(
        F.col("id").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
    )


def sha256(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()
