"""Archives from elsewhere, character references, canonical URLs by hand, and what the Bloom filter lets through."""

import gzip
import hashlib
import html
import re

import pytest
from pyspark.sql import functions as F

from moraine.llm import urls, warc


def record(kind, headers, block):
    head = ["WARC/1.0", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_responses_of_an_archive(spark, tmp_path):
    page = "<html lang=\"de\"><head><title>Über</title></head><body><p>Grüße &#8364;5</p></body></html>"
    sent = page.encode("latin-1", "replace")
    packed = gzip.compress(page.encode())
    chunked = b"".join(f"{len(sent[i : i + 20]):x}\r\n".encode() + sent[i : i + 20] + b"\r\n" for i in range(0, len(sent), 20)) + b"0\r\n\r\n"
    blocks = [
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\nX-Long: a\r\n b\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked,
        b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html;charset=utf-8\r\nContent-Encoding: gzip\r\nServer: x\r\n\r\n" + packed,
        b"no head at all",
        b"",
    ]
    head = lambda i: {"WARC-Record-ID": f"<urn:uuid:{i}>", "WARC-Target-URI": f"http://a.example/{i}", "WARC-Date": f"2020-01-0{i + 1}T00:00:00Z"}
    data = record("warcinfo", {"WARC-Record-ID": "<urn:uuid:w>"}, b"x") + b"".join(record("response", head(i), b) for i, b in enumerate(blocks)) + record("request", head(9), b"GET / HTTP/1.1\r\n\r\n")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(data)
    src = warc.read_responses(spark, f"file://{tmp_path}/in")
    rows = {r.record_id: r for r in src.collect()}
    assert sorted(rows) == [f"<urn:uuid:{i}>" for i in range(4)]
    one, two = rows["<urn:uuid:0>"], rows["<urn:uuid:1>"]
    assert one.body == two.body == page and one.http_status == 200 and two.http_status == 404
    assert [(h.name, h.value) for h in one.http_headers] == [("Content-Type", "text/html; charset=ISO-8859-1"), ("X-Long", "a b"), ("Transfer-Encoding", "chunked")]
    assert one.payload_digest == "sha256:" + hashlib.sha256(chunked).hexdigest() and rows["<urn:uuid:2>"].body == "no head at all" and rows["<urn:uuid:3>"].body == ""
    out = warc.derive(src)
    by = {(r.refers_to, r.type): r for r in out.collect()}
    assert len(by) == 8
    assert by["<urn:uuid:0>", "conversion"].block == "Grüße €5" and by["<urn:uuid:1>", "conversion"].date == "2020-01-02T00:00:00Z"
    meta = by["<urn:uuid:1>", "metadata"].block.split("\r\n")
    assert {"source-http-status: 404", "source-http-server: x", "source-http-content-type: text/html;charset=utf-8", "title: Über", "language: de"} <= set(meta)
    warc.write(warc.records(src, out), f"file://{tmp_path}/out").collect()
    back = warc.read(spark, f"file://{tmp_path}/out")
    made = {r.record_id: r for r in back.filter("type <> 'response'").collect()}
    assert {k: (made[v.record_id].block, made[v.record_id].headers["WARC-Refers-To"]) for k, v in by.items()} == {k: (v.block, k[0]) for k, v in by.items()}


def test_character_references(spark):
    texts = ["&#65;&#x42;&#X43;", "&amp;#65;", "&#0;&#xD800;&#1114112;&#9999999;", "&#128512; &#x1F600;", "&#38;#65;", "no & ref; &#; &#x; &#12a;", "&apos;&quot;&lt;&#60;", "a&#10;b", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", warc.numeric_references(F.col("t")).alias("x")).collect()

    def by_hand(t):
        def one(m):
            n = int(m.group(2), 16) if m.group(1) else int(m.group(2))
            return chr(n) if 0 < n <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF else "�"

        return re.sub(r"&#([xX]?)([0-9A-Fa-f]+);", lambda m: one(m) if m.group(1) or m.group(2).isdigit() else m.group(), t)

    assert {r.i: r.x for r in df} == {i: by_hand(t) for i, t in enumerate(texts)}
    assert df[3].x == html.unescape(texts[3])


def test_broken_long_and_missing_markup(spark):
    long = "<p>" + "word &#233; " * 200_000
    rows = [(1, "http://a.example/", None), (2, None, "<p>x"), (3, "http://a.example/", "<script>never ends"), (4, "u", "<!-- open <p>a</p>"), (5, "u", "<" * 1000), (6, "u", long), (7, "u", "</p></p><p"), (8, "u", ""), (8, "u", "")]
    out = warc.derive(warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string")))
    got = {(r.page_id, r.type): r for r in out.collect()}
    assert out.count() == 18 and got[1, "conversion"].block == got[8, "conversion"].block == "" and got[2, "conversion"].block == "x"
    assert got[6, "conversion"].block == ("word é " * 200_000).strip()
    assert all(r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest() and r.length == len(r.block.encode()) for r in got.values())


def canonical_by_hand(url):
    if url is None or "://" not in url:
        return ""
    rest = url.split("://", 1)[1].split("#")[0]
    rest, _, query = rest.partition("?")
    host, slash, path = rest.partition("/")
    host = "".join(c.lower() if c.isascii() else c for c in host)
    if not host:
        return ""
    for lead in ("www.", "m."):
        if host.startswith(lead):
            host = host[len(lead) :]
            break
    for port in (":80", ":443"):
        host = host.removesuffix(port)
    kept = "&".join(p for p in query.split("&") if p and not p.startswith("utm_"))
    return host + (slash + path).rstrip("/") + ("?" + kept if kept else "")


URLS = [
    "http://a.com/x?utm_source=q&id=5", "http://a.com/x?id=5&utm_source=q", "http://a.com/x?id=5", "https://www.A.com:443/x/?utm_a&utm_b=1#f", "http://m.a.com/x?&&", "a.com/x", None, "", "http://", "http:///path",
    "http://a.com?q=1", "http://a.com/x?utm=1", "http://a.com/x?a=utm_b", "ftp://www.m.a.com//", "http://a.com/x?id=5#?utm_x",
]


def test_canonical_by_hand(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = {r.row.page_id: r.canonical_url for r in urls.judge(df, df.limit(0).select("url")).collect()}
    assert got == {i: canonical_by_hand(u) for i, u in enumerate(URLS)}
    listed = spark.createDataFrame([("a.com/x",)], "url string")
    verdict = {r.row.page_id: r.is_listed for r in urls.judge(df, listed).collect()}
    assert not verdict[0] and not verdict[1] and verdict[3] and verdict[4]


def test_false_positives_of_the_filter_are_removed(spark):
    listed = urls.block_list(spark, ("spam-farm",), 2000)
    n = listed.count()
    assert n == 3 * 4 * 3 * 2000 == listed.distinct().count() and listed.filter("url = 'spam-farm.example.net/es/1999.html'").count() == 1
    probes = spark.range(60_000).select(F.concat(F.lit("good.example.com/en/"), F.col("id").cast("string")).alias("canonical_url")).union(listed.limit(500).withColumnRenamed("url", "canonical_url"))
    maybe, exact = urls.hits(probes, listed)
    assert exact.count() == 500 and 500 < maybe.count() < 500 + 60_000 * 0.02  # some pass the filter, and go


def test_long_urls(spark):
    u = "http://spam.example/" + "a/" * 50_000
    df = spark.createDataFrame([(1, u), (2, u + "b"), (2, u + "b")], "page_id long, url string")
    listed = spark.createDataFrame([(canonical_by_hand(u),)], "url string")
    assert sorted((r.row.page_id, r.verdict) for r in urls.judge(df, listed).collect()) == [(1, "block"), (2, "allow"), (2, "allow")]


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_the_list_blocks_pages_of_every_scale(spark, sf):
    import os

    if not os.path.isdir(f"/root/testdata/sf{sf}"):
        pytest.skip("no test tables")
    pages = spark.read.parquet(f"/root/testdata/sf{sf}/pages.parquet")
    assert urls.judge(pages, urls.block_list(spark)).filter("is_listed").count() > 0
