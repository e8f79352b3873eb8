"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join of its hits.

The list is an input of its own (column url).  The filter's blocks are built by
aggregation and kept as rows; a URL probes one block.  Only possible hits reach
the exact join, which removes false positives.  Rules on host and path prefix go
before the list; the longest that fits wins.

Defined results: a null URL, or one without ://, has an empty host and path, is
on no list, fits no rule and is allowed; URLs of any length are compared whole;
URLs with one canonical form are judged alike; rules of one length go by their
text; repeated rows are each judged, and a URL listed twice counts once; an
empty table or list gives no hits; further columns pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, ascii_lower, join_small, materialize

#: (host, path, verdict)
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: What the registered query's list is made of: sites, endings, languages, numbers of pages, and forms of a page's address.
LISTED_SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
ENDINGS = ("com", "net", "org")
LANGUAGES = ("en", "de", "fr", "es")
FORMS = ("", ".html", "?page=2&ref=x")
NUMBERS = 5_000

#: A block is 8 words of 64 bits, of which a URL sets one bit each.
WORDS = 8
BITS_PER_URL = 12
#: After the scheme: host, path, query.
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"


def url_part(url: Column, k: int) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, k), F.lit(""))


def host_of(url: Column) -> Column:
    return ascii_lower(url_part(url, 1))


def path_of(url: Column) -> Column:
    return url_part(url, 2)


def canonical(url: Column) -> Column:
    """Host without www. or m. and default port, path without closing slashes, query without parameters that track or are empty; no scheme or fragment."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.|:(80|443)$", "")
    kept = F.array_join(F.filter(F.split(F.substr(url_part(url, 3), F.lit(2)), "&"), lambda p: (p != "") & ~p.startswith("utm_")), "&")
    return F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null; rules are a short list of parameters."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _block(url: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), url), F.lit(n_blocks))


def _bits(url: Column) -> list[Column]:
    """The bit of each word: 6 bits of a second hash."""
    h = F.xxhash64(F.lit("bits"), url)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def bloom(listed: DataFrame, n_listed: int) -> tuple[DataFrame, int]:
    """Blocks (block, w0..w7) that have a bit set, and how many blocks there are; listed: canonical URLs as url."""
    n_blocks = max(1, -(-n_listed * BITS_PER_URL // (64 * WORDS)))
    x = listed.select(_block(F.col("url"), n_blocks).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(_bits(F.col("url")))])
    return x.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]), n_blocks


def maybe_in(df: DataFrame, key: str, names: DataFrame, n_names: int) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be in ``names`` (a column of that name): all that are, and few others.

    The blocks are broadcast and BROADCAST_ROWS at most; of more names than fill
    these, more other rows pass.
    """
    k = F.col(key)
    most = BROADCAST_ROWS * 64 * WORDS // BITS_PER_URL
    blocks, n_blocks = bloom(names.select(k.alias("url")), min(n_names, most))
    marks = blocks.select(*[F.col(c).alias(f"bloom_{c}") for c in blocks.columns])
    probed = df.join(F.broadcast(marks), _block(k, n_blocks) == F.col("bloom_block"))
    return probed.filter(_all_set(k, "bloom_")).select(*[F.col(f"`{c}`") for c in df.columns])


def _all_set(url: Column, prefix: str = "") -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{prefix}w{i}").bitwiseAND(b) == b for i, b in enumerate(_bits(url))])


def hits(urls: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(maybe, exact): the distinct ``canonical_url`` of ``urls`` that the filter passes, and those of them that are in ``listed`` (column url, canonical).

    The blocks are broadcast if few by count (72 bytes each), else joined by
    block.  Hits are made distinct, with map-side combining, before the exact
    join, so a URL that many pages share is one row there.
    """
    listed = materialize(listed.select("url").filter(F.col("url") != "").distinct(), "listed-urls")
    blocks, n_blocks = bloom(listed, listed.count())
    if n_blocks <= BROADCAST_ROWS:
        blocks = F.broadcast(blocks)
    c = F.col("canonical_url")
    probed = urls.select("canonical_url").filter(c != "").withColumn("block", _block(c, n_blocks)).join(blocks, "block")
    maybe = probed.filter(_all_set(c))
    maybe = materialize(maybe.select("canonical_url").distinct(), "url-hits")
    return maybe, maybe.join(listed, F.col("canonical_url") == F.col("url"), "left_semi")


def on_list(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """The distinct ``canonical_url`` of ``urls`` that are in ``listed``."""
    return hits(urls, listed)[1]


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """row (a struct of all columns of ``pages``), host, path, rule, verdict, canonical_url, is_listed."""
    url = F.col("url")
    x = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), host_of(url).alias("host"), path_of(url).alias("path"), F.when(host_of(url) != "", canonical(url)).otherwise("").alias("canonical_url"))
    x = x.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    exact = materialize(on_list(x, listed), "url-exact").select(F.col("canonical_url").alias("hit"))
    j = join_small(x, exact, F.col("canonical_url") == F.col("hit"))
    is_listed = F.col("hit").isNotNull()
    verdict = F.coalesce(F.col("fit.verdict"), F.when(is_listed, "block").otherwise("allow"))
    return j.select("row", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "canonical_url", is_listed.alias("is_listed"))


def block_list(spark, sites=LISTED_SITES, numbers: int = NUMBERS) -> DataFrame:
    """A list of canonical URLs (url): every page number below ``numbers`` of the sites, under all endings, in all languages and forms."""
    parts, n = F.lit("").cast("string"), F.col("id")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    for values, before in ((sites, ""), (ENDINGS, ".example."), (LANGUAGES, "/")):
        parts, n = F.concat(parts, F.lit(before), pick(values)), F.floor(n / len(values))
    form, n = pick(FORMS), F.floor(n / len(FORMS))
    return spark.range(len(sites) * len(ENDINGS) * len(LANGUAGES) * len(FORMS) * numbers).select(F.concat(parts, F.lit("/"), n.cast("string"), form).alias("url"))


#: Site names below any subdomain and under any ending, for a list drawn from pages.
NAMES = rf"^([^:]*\.)?({'|'.join(LISTED_SITES)})\.[^:]+(:[0-9]+)?$"


def listed_names(pages: DataFrame, names: str = NAMES) -> DataFrame:
    """Canonical URLs (url) of the pages whose host fits ``names``."""
    return pages.filter(host_of(F.col("url")).rlike(names)).select(canonical(F.col("url")).alias("url"))
