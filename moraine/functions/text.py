"""String, URL and encoding functions with the guest language's semantics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad_start(s: Column, n: int, fill: str = " ") -> Column:
    """Never truncates, unlike lpad."""
    return F.when(F.length(s) >= n, s).otherwise(F.lpad(s, n, fill))


def pad_end(s: Column, n: int, fill: str = " ") -> Column:
    return F.when(F.length(s) >= n, s).otherwise(F.rpad(s, n, fill))


def trim_start(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+", "")


def trim_end(s: Column) -> Column:
    return F.regexp_replace(s, r"\s+$", "")


def at(s: Column, i: int) -> Column:
    """The i-th character, from the end if negative; null out of range."""
    c = F.substring(s, i + 1 if i >= 0 else i, 1)
    return F.when((F.length(s) > i) if i >= 0 else (F.length(s) >= -i), c)


def replace_all(s: Column, find: str, put: str) -> Column:
    return F.replace(s, F.lit(find), F.lit(put))


def match_all(s: Column, pattern: str) -> Column:
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(0))


def list_format(a: Column, word: str = "and") -> Column:
    """"a", "a and b", "a, b, and c"."""
    n = F.size(a)
    many = F.concat(F.array_join(F.slice(a, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(f", {word} "), F.element_at(a, -1))
    return F.when(n == 0, "").when(n == 1, F.get(a, F.lit(0))).when(n == 2, F.array_join(a, f" {word} ")).otherwise(many)


def percent_encode(s: Column) -> Column:
    """As encodeURIComponent: a space is %20 and !'()*~ stay."""
    out = F.url_encode(s)
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def query_string(pairs: Column) -> Column:
    """array<struct<k, v>> to k=v&...; a repeated key has an entry for each value."""
    return F.array_join(F.transform(pairs, lambda p: F.concat(percent_encode(p["k"]), F.lit("="), percent_encode(p["v"]))), "&")


def parse_query(q: Column) -> Column:
    """k=v&... to map<string, array<string>>: values of a key in order, keys by first use."""
    entries = F.filter(F.split(q, "&"), lambda x: x != "")
    key = lambda x: F.url_decode(F.substring_index(x, "=", 1))
    value = lambda x: F.when(F.contains(x, F.lit("=")), F.url_decode(F.regexp_replace(x, r"(?s)^[^=]*=", ""))).otherwise("")
    keys = F.array_distinct(F.transform(entries, key))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(entries, lambda x: key(x) == k), value)))


def url_parts(url: Column) -> Column:
    return F.struct(F.try_parse_url(url, F.lit("PROTOCOL")).alias("scheme"), F.try_parse_url(url, F.lit("HOST")).alias("host"), F.try_parse_url(url, F.lit("PATH")).alias("path"), F.try_parse_url(url, F.lit("QUERY")).alias("query"))


def url_pattern(pattern: str) -> tuple[str, list[str]]:
    """A path pattern with :name groups and * as (regular expression, group names)."""
    names, out = [], []
    for part in pattern.split("/"):
        if part.startswith(":"):
            names.append(part[1:])
            out.append("([^/?#]+)")
        else:
            out.append(".*".join("".join("\\" + c if not c.isalnum() and c not in "_-" else c for c in x) for x in part.split("*")))
    return "^[a-z][a-z0-9+.-]*://[^/]+" + "/".join(out) + "(?:[?#].*)?$", names


def match_url(url: Column, pattern: str) -> Column:
    """struct<test, groups...>"""
    regex, names = url_pattern(pattern)
    return F.struct(F.coalesce(url.rlike(regex), F.lit(False)).alias("test"), *[F.nullif(F.regexp_extract(url, regex, k), F.lit("")).alias(n) for k, n in enumerate(names, 1)])


def is_error(status: Column) -> Column:
    return F.when(status >= 400, True).otherwise(False)


def btoa(s: Column) -> Column:
    """Latin-1 to base 64 in one line; null if a character is beyond Latin-1."""
    return F.when(~s.rlike("[^\\x00-\\xFF]"), F.regexp_replace(F.base64(F.encode(s, "ISO-8859-1")), r"[\r\n]", ""))


def atob(s: Column) -> Column:
    """Null where the text isn't base 64."""
    clean = F.regexp_replace(s, r"\s", "")
    ok = clean.rlike(r"^[A-Za-z0-9+/]*={0,2}$") & (F.length(clean) % 4 != 1)
    return F.when(ok, F.decode(F.unbase64(F.when(ok, clean)), "ISO-8859-1"))


def md5_sha1(s: Column) -> Column:
    """The 36 bytes of MD5 and SHA-1, as hex."""
    return F.concat(F.md5(s.cast("binary")), F.sha1(s.cast("binary")))


def currency(x: Column) -> Column:
    return F.format_string("$ %.2f", x.cast("double"))


def health_status(body: Column) -> Column:
    return F.when(body == "good", "Good").when(body == "graceful_shutting_down", "GracefulShuttingDown")


def common_prefix(paths: Column, sep: str = "/") -> Column:
    """Longest common directory of paths, with the separator at its end; nothing shared gives ''."""
    parts = F.transform(paths, lambda p: F.split(p, sep))
    first = F.get(parts, F.lit(0))
    depth = F.array_min(F.transform(parts, lambda p: F.size(p))) - 1
    places = F.when(depth > 0, F.sequence(F.lit(0), F.greatest(depth - 1, F.lit(0)))).otherwise(F.expr("cast(array() as array<int>)"))
    differs = F.filter(places, lambda i: ~F.forall(parts, lambda p: F.get(p, i) == F.get(first, i)))
    n = F.coalesce(F.array_min(differs), F.greatest(depth, F.lit(0)))
    joined = F.array_join(F.slice(first, 1, n), sep)
    return F.when((F.size(paths) == 0) | (n == 0) | ((n == 1) & (joined == "") & (F.lit(sep) != "/")), "").otherwise(F.concat(joined, F.lit(sep)))


def ip_key(ip: Column) -> Column:
    """Sorts addresses by number, version 4 before 6; an address that isn't one sorts last."""
    four = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    parts = F.split(ip, r"\.")
    octets = F.concat(*[F.lpad(F.get(parts, F.lit(k)), 3, "0") for k in range(4)])
    groups = F.split(ip, "::")
    count = lambda s: F.when(s == "", 0).otherwise(F.size(F.split(s, ":")))
    head, tail = F.get(groups, F.lit(0)), F.coalesce(F.get(groups, F.lit(1)), F.lit(""))
    zeros = F.when(F.size(groups) == 2, F.repeat(F.lit("0000"), (F.lit(8) - count(head) - count(tail)).cast("int"))).otherwise("")
    pad = lambda s: F.array_join(F.transform(F.filter(F.split(s, ":"), lambda x: x != ""), lambda x: F.lpad(x, 4, "0")), "")
    return F.when(four, F.concat(F.lit("4"), octets)).when(ip.contains(":"), F.concat(F.lit("6"), F.lower(pad(head)), zeros, F.lower(pad(tail)))).otherwise(F.concat(F.lit("9"), ip))


def tagged(tag: Column, payload: Column | None = None) -> Column:
    """Adjacently tagged JSON, {"t": tag, "v": payload}; payload is JSON text, null for a unit variant."""
    return F.concat(F.lit('{"t":'), F.to_json(F.array(tag)).substr(F.lit(2), F.length(F.to_json(F.array(tag))) - 2), F.lit(',"v":'), F.coalesce(payload, F.lit("null")) if payload is not None else F.lit("null"), F.lit("}"))


def json_of(*cols: Column) -> Column:
    """A tuple as a JSON array, from JSON scalars."""
    return F.concat(F.lit("["), reduce(lambda a, b: F.concat(a, F.lit(","), b), cols), F.lit("]"))


def json_string(c: Column) -> Column:
    j = F.to_json(F.array(c))
    return F.substring(j, F.lit(2), F.length(j) - 2)


def free_text(cols: list[Column], q: str) -> Column:
    """Free-text search: the text occurs, in any case, in the columns put together."""
    return F.contains(F.lower(F.concat_ws(" ", *cols)), F.lit(q.lower()))


def date_utc(y, month_index, d, h, mi, s) -> Column:
    """Milliseconds; months count from 0."""
    return F.unix_millis(F.make_timestamp(y, month_index + 1, d, h, mi, s, F.lit("UTC")))


def external_tag(tag: Column, payload: Column | None = None) -> Column:
    """Externally tagged JSON: a unit variant is its name, others are {name: payload}; payload is JSON text."""
    return json_string(tag) if payload is None else F.concat(F.lit("{"), json_string(tag), F.lit(":"), payload, F.lit("}"))


def from_entries(entries: Column) -> Column:
    """A map of an array of structs (k, v); the last of a key's entries wins."""
    later = lambda i: F.slice(entries, i + 2, F.size(entries))
    return F.map_from_entries(F.filter(entries, lambda e, i: ~F.exists(later(i), lambda x: x["k"] == e["k"])))


def locale_compare(a: Column, b: Column, collation: str = "UNICODE") -> Column:
    """-1, 0 or 1 in the collation's order."""
    x, y = F.collate(a, collation), F.collate(b, collation)
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)


def is_well_formed(b: Column) -> Column:
    return F.is_valid_utf8(b)


def to_well_formed(b: Column) -> Column:
    """Bytes that aren't UTF-8 become U+FFFD."""
    return F.make_valid_utf8(b)
