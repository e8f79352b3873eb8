"""WARC derivatives: responses become linked metadata and plain-text conversion records.

``read_responses`` takes the response records of an archive apart (HTTP head,
transfer and content encodings, character set), ``derive`` makes the derived
records, ``records`` and ``write`` put both into an archive.  A derived record
refers to its response's record id, repeats the source's target URI, date and
digest, has a digest of its own block, and its metadata keep the source's HTTP
headers.  Record ids are hashes of the source record's id, so reruns agree.

Defined results: a null URL or body is an empty one and its records are still
made; markup that is broken or never ends is text up to where it breaks, and
bodies of any length are converted whole; numeric references of no character are
U+FFFD; repeated rows give repeated records; rows of one URL are each converted;
a response without an HTTP head is all body; an empty table gives none; columns
other than page_id, url and html are not looked at.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The synthetic crawl has no time of its own.
CRAWLED = "2024-01-01T00:00:00Z"
#: Compressed bytes of a written file, and bytes of blocks that a reading task sends on at once.
FILE_BYTES = 64_000_000
BATCH_BYTES = 16_000_000
RECORD_SCHEMA = "record_id string, type string, headers map<string,string>, block string"


def uuid_of(c: Column) -> Column:
    """<urn:uuid:...> from a hash of the text."""
    h = F.md5(c.cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


REFERENCE = r"&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};"


def numeric_references(x: Column) -> Column:
    """Decimal and hexadecimal character references as their characters; those of none as U+FFFD."""

    def character(ref: Column) -> Column:
        digits = F.substr(ref, F.lit(3), F.length(ref) - 3)
        code = F.when(digits.rlike("^[xX]"), F.conv(F.substr(digits, F.lit(2)), 16, 10)).otherwise(digits).cast("long")
        known = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")

    def read(t: Column) -> Column:
        found = F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(REFERENCE), F.lit(0))))
        return F.when(F.contains(t, F.lit("&#")), F.aggregate(found, t, lambda text, ref: F.replace(text, ref, character(ref)))).otherwise(t)

    return F.get(F.transform(F.array(x), read), F.lit(0))  # x is made once, though it is looked at three times


def html_to_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and head go, block ends become lines, named entities of markup and all numeric ones are read."""
    x = F.regexp_replace(html, r"(?is)<(script|style|head|template|noscript)\b.*?</(script|style|head|template|noscript)\s*>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?i)<(br|hr)\s*/?>|</(p|div|li|ul|ol|h1|h2|h3|h4|h5|h6|tr|table|section|article|nav|header|footer|title|blockquote|pre)\s*>", "\n")
    x = F.regexp_replace(x, r"(?s)<[A-Za-z/!?][^>]*>", " ")
    x = numeric_references(x)
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    x = F.regexp_replace(x, r"[ \t\r\f]+", " ")
    x = F.regexp_replace(x, r" ?\n[ \n]*", "\n")
    return F.btrim(x, F.lit(" \n"))


def responses(pages: DataFrame) -> DataFrame:
    """Response records (page_id, record_id, uri, date, content_type, body, payload_digest) of crawled pages."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    ident = F.concat_ws("|", F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), url)
    return pages.select("page_id", uuid_of(ident).alias("record_id"), url.alias("uri"), F.lit(CRAWLED).alias("date"), F.lit("text/html; charset=utf-8").alias("content_type"), html.alias("body"), digest(html).alias("payload_digest"))


def derive(source: DataFrame) -> DataFrame:
    """Two records for each response, one after the other: conversion (its text) and metadata (what it was made from)."""
    text = html_to_text(F.col("body"))
    x = source.withColumn("text", text).withColumn("conversion_id", uuid_of(F.concat(F.lit("conversion|"), F.col("record_id"))))
    x = x.withColumn("title", F.regexp_replace(F.regexp_extract("body", r"(?is)<title[^>]*>(.*?)</title\s*>", 1), r"\s+", " "))
    x = x.withColumn("language", F.regexp_extract("body", r"(?i)<html[^>]*\blang=\"([A-Za-z-]*)\"", 1))
    meta = F.concat(
        F.lit("conversion: "), F.col("conversion_id"), F.lit("\r\nsource-content-type: "), F.col("content_type"), F.lit("\r\nsource-payload-digest: "), F.col("payload_digest"), F.lit("\r\nsource-length: "), F.octet_length("body").cast("string"),
        F.lit("\r\ntitle: "), F.col("title"), F.lit("\r\nlanguage: "), F.col("language"), F.lit("\r\n"),
    )
    if "http_headers" in source.columns:  # of an archive: status line and headers as they were
        lines = F.transform("http_headers", lambda h: F.concat(F.lit("source-http-"), F.lower(h["name"]), F.lit(": "), h["value"], F.lit("\r\n")))
        meta = F.concat(meta, F.lit("source-http-status: "), F.coalesce(F.col("http_status").cast("string"), F.lit("")), F.lit("\r\n"), F.array_join(lines, ""))
    made = F.array(
        F.struct(F.col("conversion_id").alias("id"), F.lit("conversion").alias("type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
        F.struct(uuid_of(F.concat(F.lit("metadata|"), F.col("record_id"))).alias("id"), F.lit("metadata").alias("type"), F.lit("application/warc-fields").alias("content_type"), meta.alias("block")),
    )
    x = x.select("page_id", "uri", "date", F.col("record_id").alias("refers_to"), F.col("payload_digest").alias("source_digest"), F.explode(made).alias("r"))
    return x.select(
        "page_id", F.col("r.type").alias("type"), F.col("r.id").alias("record_id"), "refers_to", "uri", "date", F.col("r.content_type").alias("content_type"),
        F.octet_length("r.block").cast("long").alias("length"), digest(F.col("r.block")).alias("block_digest"), "source_digest", F.col("r.block").alias("block"),
    )


def records(source: DataFrame, derived: DataFrame) -> DataFrame:
    """Responses and derived records in one schema, ready for write(): record_id, type, headers, block."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: "), F.col("content_type"), F.lit("\r\nContent-Length: "), F.octet_length("body").cast("string"), F.lit("\r\n\r\n"), F.col("body"))
    a = source.select(
        "record_id", F.lit("response").alias("type"),
        F.create_map(F.lit("WARC-Target-URI"), "uri", F.lit("WARC-Date"), "date", F.lit("WARC-Payload-Digest"), "payload_digest", F.lit("Content-Type"), F.lit("application/http; msgtype=response"), F.lit("WARC-Block-Digest"), digest(http)).alias("headers"),
        http.alias("block"),
    )
    b = derived.select(
        "record_id", "type",
        F.create_map(F.lit("WARC-Target-URI"), "uri", F.lit("WARC-Date"), "date", F.lit("WARC-Refers-To"), "refers_to", F.lit("WARC-Refers-To-Target-URI"), "uri", F.lit("WARC-Block-Digest"), "block_digest", F.lit("X-Source-Payload-Digest"), "source_digest", F.lit("Content-Type"), "content_type").alias("headers"),
        "block",
    )
    return a.unionByName(b)


RESPONSES = "page_id long, record_id string, uri string, date string, content_type string, body string, payload_digest string, http_status int, http_headers array<struct<name:string,value:string>>, warc_headers map<string,string>"


def http_response(block: bytes) -> tuple[int | None, list[tuple[str, str]], bytes]:
    """(status, headers in order, payload as sent) of an HTTP response; what has no head is all payload."""
    if not block.startswith(b"HTTP/"):
        return None, [], block
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        head, _, body = block.partition(b"\n\n")
    first, *lines = head.decode("latin-1").replace("\r\n", "\n").split("\n")
    parts, headers = first.split(" ", 2), []
    for line in lines:
        if line[:1] in (" ", "\t") and headers:  # a folded header
            headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            headers.append((name.strip(), value.strip()))
    return int(parts[1]) if len(parts) > 1 and parts[1].isdigit() else None, headers, body


def unchunked(body: bytes) -> bytes:
    """A body of chunked transfer coding put together; as it is where it isn't of that form."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0 or end + 2 + size > len(body):
            return body if not out else b"".join(out)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def decoded(body: bytes, headers: dict[str, str]) -> str:
    """The text of a payload: transfer coding, content coding and character set undone."""
    if headers.get("transfer-encoding", "").lower() == "chunked":
        body = unchunked(body)
    coding = headers.get("content-encoding", "").lower()
    try:
        if coding in ("gzip", "x-gzip", "deflate"):
            body = zlib.decompressobj(-15 if coding == "deflate" and body[:1] != b"\x78" else 47).decompress(body)
    except zlib.error:
        pass  # said to be compressed and isn't
    found = CHARSET.search(headers.get("content-type", "")) or CHARSET.search(body[:1024].decode("latin-1"))
    try:
        return body.decode(found.group(1) if found else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


CHARSET = re.compile(r"charset=[\"']?([A-Za-z0-9_-]+)", re.IGNORECASE)


def read_responses(spark, uri: str) -> DataFrame:
    """The response records of the .warc.gz files of a folder as ``derive`` takes them (page_id is null), with status, HTTP headers and WARC headers.

    The payload digest is the record's own if it has one, else of the payload as sent.
    """
    names = [x.strip().split(" ")[0] for x in RESPONSES.split(", ")]

    def run(batches):
        schema = pa.schema([(n, pa.int64() if n == "page_id" else pa.int32() if n == "http_status" else pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])) if n == "http_headers" else pa.map_(pa.string(), pa.string()) if n == "warc_headers" else pa.string()) for n in names])
        for batch in batches:
            for content in batch.column("content").to_pylist():
                rows, used = [], 0
                for h, block in parse(content):
                    if h.get("WARC-Type") != "response":
                        continue
                    status, headers, payload = http_response(block)
                    by_name = {k.lower(): v for k, v in headers}
                    given = h.get("WARC-Payload-Digest") or "sha256:" + hashlib.sha256(payload).hexdigest()
                    row = (None, h.get("WARC-Record-ID"), h.get("WARC-Target-URI", ""), h.get("WARC-Date", ""), by_name.get("content-type", ""), decoded(payload, by_name), given, status, [{"name": k, "value": v} for k, v in headers], list(h.items()))
                    rows.append(dict(zip(names, row)))
                    used += len(block)
                    if used >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, used = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(uri).select("content").mapInArrow(run, RESPONSES)


def record_bytes(record_id: str, kind: str, headers: dict, block: str) -> bytes:
    """One record as the format has it, in a gzip member of its own."""
    body = (block or "").encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", *(f"{k}: {v}" for k, v in sorted(headers.items())), f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", mtime=0)


def write(recs: DataFrame, uri: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes .warc.gz files of about ``file_bytes`` into a shared folder; returns file, n_records, n_bytes once acted on.

    A task holds one file at a time.  Files are written under names of their
    own and renamed, so retried tasks are harmless.
    """
    from .common import put_bytes

    def run(batches):
        from pyspark import TaskContext

        part, k, out, n, used = TaskContext.get().partitionId(), 0, [], 0, 0

        def flush():
            put_bytes(name := f"{uri}/part-{part:06d}-{k:04d}.warc.gz", b"".join(out))
            return pa.RecordBatch.from_pydict({"file": [name], "n_records": [n], "n_bytes": [used]})

        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                out.append(record_bytes(r["record_id"], r["type"], dict(r["headers"]), r["block"]))
                n, used = n + 1, used + len(out[-1])
                if used >= file_bytes:
                    yield flush()
                    k, out, n, used = k + 1, [], 0, 0
        if out:
            yield flush()

    return recs.select("record_id", "type", "headers", "block").mapInArrow(run, "file string, n_records long, n_bytes long")


def parse(data: bytes):
    """(headers, block) of each record of a .warc.gz or .warc file, a record at a time; stops at a broken tail."""
    src = io.BytesIO(data)
    src = gzip.GzipFile(fileobj=src) if data[:2] == b"\x1f\x8b" else src
    try:
        while line := src.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                return
            headers = {}
            while (line := src.readline()).strip():
                name, _, value = line.decode("utf-8", "replace").rstrip("\r\n").partition(":")
                headers[name] = value.strip(" ")
            n = int(headers.get("Content-Length", 0))
            block = src.read(n)
            if not line or len(block) < n:
                return
            yield headers, block
    except (EOFError, OSError, zlib.error):  # a member cut short
        return


def read(spark, uri: str) -> DataFrame:
    """Records of the .warc.gz files of a folder (record_id, type, headers, block), in any store that Spark reads.

    A file comes to its task compressed and is unpacked a record at a time;
    binaryFile bounds it to 2 GB.
    """
    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.string())])

    def run(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                rows, used = [], 0
                for h, b in parse(content):
                    rows.append({"record_id": h.get("WARC-Record-ID"), "type": h.get("WARC-Type"), "headers": list(h.items()), "block": b.decode("utf-8", "replace")})
                    used += len(b)
                    if used >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, used = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(uri).select("content").mapInArrow(run, RECORD_SCHEMA)
