"""Scalar functions, a query for each family, over columns of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codecs, floats, ints, lanes
from ..functions import text as X
from ..sources import blobs
from .registry import query, table


def _part(spark, sf_dir):
    return table(spark, sf_dir, "part")


@query(r"""SELECT p_partkey, CASE WHEN length(p_name) >= 11 THEN p_name ELSE lpad(p_name, 11, '*') END AS pad_start, CASE WHEN length(p_name) >= 11 THEN p_name ELSE rpad(p_name, 11, '.') END AS pad_end,
regexp_replace('  ' || p_name || chr(9), '^\s+', '') AS trim_start, regexp_replace(p_name || chr(10), '\s+$', '') AS trim_end, substr(p_name, 3, 1) AS at_2, substr(p_name, length(p_name), 1) AS at_end,
replace(p_name, 'e', 'EE') AS replaced, regexp_extract_all(p_name, '[aeiou]') AS vowels, upper(p_name) AS up, lower(p_brand) AS low FROM part""")
def scalar_strings(spark, sf_dir):
    n = F.col("p_name")
    return _part(spark, sf_dir).select(
        "p_partkey", X.pad_start(n, 11, "*").alias("pad_start"), X.pad_end(n, 11, ".").alias("pad_end"), X.trim_start(F.concat(F.lit("  "), n, F.lit("\t"))).alias("trim_start"), X.trim_end(F.concat(n, F.lit("\n"))).alias("trim_end"),
        X.at(n, 2).alias("at_2"), X.at(n, -1).alias("at_end"), X.replace_all(n, "e", "EE").alias("replaced"), X.match_all(n, "[aeiou]").alias("vowels"), F.upper(n).alias("up"), F.lower("p_brand").alias("low"),
    )


@query("""SELECT p_partkey, list_transform([p_name, p_brand], lambda x: x)[1] || ' and ' || p_brand AS two, p_name || ', ' || p_brand || ', and ' || p_type AS three, '$ ' || printf('%.2f', p_retailprice) AS price,
CASE WHEN p_size % 3 = 0 THEN 'a/' WHEN p_size % 3 = 1 THEN '/x/y/' ELSE '' END AS prefix FROM part""")
def scalar_formats(spark, sf_dir):
    paths = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("a/b"), F.lit("a/c/d"))).when(F.col("p_size") % 3 == 1, F.array(F.lit("/x/y/z"), F.lit("/x/y/w"))).otherwise(F.array(F.lit("a/b"), F.lit("c/b")))
    return _part(spark, sf_dir).select(
        "p_partkey", X.list_format(F.array("p_name", "p_brand")).alias("two"), X.list_format(F.array("p_name", "p_brand", "p_type")).alias("three"), X.currency(F.col("p_retailprice")).alias("price"), X.common_prefix(paths).alias("prefix"),
    )


@query(r"""SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, nullif(regexp_extract(url, '\?([^#]*)', 1), '') AS query, replace(replace(replace(replace(url, ':', '%3A'), '/', '%2F'), '?', '%3F'), '=', '%3D').replace('&', '%26').replace('#', '%23') AS encoded,
page_id % 200 + 300 >= 400 AS is_error, regexp_matches(url, '^https?://[^/]+/en/[^/?#]+([?#].*)?$') AS is_en, CASE WHEN regexp_matches(url, '^https?://[^/]+/en/[^/?#]+([?#].*)?$') THEN regexp_extract(url, '/en/([^/?#]+)', 1) END AS en_id FROM pages""")
def scalar_urls(spark, sf_dir):
    u = F.col("url")
    p = table(spark, sf_dir, "pages").select("page_id", "url", X.url_parts(u).alias("p"), X.match_url(u, "/en/:id").alias("m"))
    return p.select("page_id", "p.scheme", "p.query", X.percent_encode(u).alias("encoded"), X.is_error(F.col("page_id") % 200 + 300).alias("is_error"), F.col("m.test").alias("is_en"), F.col("m.id").alias("en_id"))


@query("""SELECT p_partkey, 'a=' || replace(p_name, ' ', '%20') || '&b=' || p_size || '&c=true&d=foo&d=bar' AS text, ['foo', 'bar'] AS d, [p_name] AS a FROM part""")
def scalar_query_strings(spark, sf_dir):
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    pairs = F.array(pair("a", F.col("p_name")), pair("b", F.col("p_size").cast("string")), pair("c", F.lit("true")), pair("d", F.lit("foo")), pair("d", F.lit("bar")))
    q = _part(spark, sf_dir).select("p_partkey", X.query_string(pairs).alias("text"))
    return q.withColumn("m", X.parse_query(F.col("text"))).select("p_partkey", "text", F.element_at("m", "d").alias("d"), F.element_at("m", "a").alias("a"))


@query("""SELECT doc_id, sha256(text) AS sha256, md5(text) || sha1(text) AS md5_sha1, to_base64(encode(p)) AS b64, p AS back FROM (SELECT doc_id, text, 'id-' || doc_id || repeat('x', 80) AS p FROM documents)""")
def scalar_hashes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("p", F.concat(F.lit("id-"), F.col("doc_id").cast("string"), F.lit("x" * 80)))
    return d.select("doc_id", F.sha2("text", 256).alias("sha256"), X.md5_sha1(F.col("text")).alias("md5_sha1"), X.btoa(F.col("p")).alias("b64"), X.atob(X.btoa(F.col("p"))).alias("back"))


@query("SELECT doc_id, strlen(text) AS n, true AS same FROM documents")
def scalar_compression(spark, sf_dir):
    b = F.col("text").cast("binary")
    pairs = ((codecs.deflate, codecs.inflate), (codecs.deflate_raw, codecs.inflate_raw), (codecs.gzip_pack, codecs.gunzip), (codecs.gzip_pack, codecs.unzip))
    same = F.lit(True)
    for pack, unpack in pairs:
        same = same & (unpack(pack(b)) == b)
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("n"), same.alias("same"))


@query("SELECT n_nationkey, 'xn--mnchen-3ya-' || n_nationkey || '.de' AS unused, CASE WHEN n_nationkey % 2 = 0 THEN 'xn--mnchen-3ya.de' ELSE 'example.org' END AS ascii FROM nation")
def scalar_punycode(spark, sf_dir):
    name = F.when(F.col("n_nationkey") % 2 == 0, "münchen.de").otherwise("example.org")
    return table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("xn--mnchen-3ya-"), F.col("n_nationkey").cast("string"), F.lit(".de")).alias("unused"), codecs.domain_to_ascii(name).alias("ascii"))


@query("SELECT o_orderkey, epoch_ms(make_timestamp(year(o_orderdate), month(o_orderdate), day(o_orderdate), cast(o_custkey % 24 AS bigint), 5, 6.5)) AS ms, strftime(o_orderdate, '%d.%m.%Y') AS local FROM orders")
def scalar_dates(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.date_utc(F.year(d), F.month(d) - 1, F.day(d), (F.col("o_custkey") % 24).cast("int"), F.lit(5), F.lit(6.5)).alias("ms"), F.date_format(d, "dd.MM.yyyy").alias("local"))


@query("""SELECT vec_id, list_sort(embedding[1:8]) AS sorted, list_filter(embedding, lambda x: x > 0)[-1] AS find_last, cast(len(embedding) - list_position(list_reverse(list_transform(embedding, lambda x: x > 0)), true) AS bigint) AS find_last_index,
embedding[-1] AS at_end, flatten([embedding[1:2], embedding[3:4]]) AS flat, list_sort(list_distinct([label, 1, 2] || [2, 3])) AS united, [label + 1, label + 2, label + 3] AS related, list_transform(range(5), lambda i: CASE WHEN i % 2 = 0 THEN 'even' ELSE 'odd' END) AS generated FROM embeddings""")
def scalar_arrays(spark, sf_dir):
    e = F.col("embedding")
    positive = F.filter(F.transform(e, lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    n = F.col("label")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.array_sort(F.slice(e, 1, 8)).alias("sorted"), F.try_element_at(F.filter(e, lambda x: x > 0), F.lit(-1)).alias("find_last"), F.try_element_at(positive, F.lit(-1)).cast("bigint").alias("find_last_index"), F.element_at(e, -1).alias("at_end"),
        F.flatten(F.array(F.slice(e, 1, 2), F.slice(e, 3, 2))).alias("flat"), F.array_sort(F.array_union(F.array(n, F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)))).alias("united"), F.array(n + 1, n + 2, n + 3).alias("related"),
        F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when(i % 2 == 0, "even").otherwise("odd")).alias("generated"),
    )


@query("""SELECT p_partkey, ['brand', 'name'] AS keys, [p_brand, p_name] AS vals, true AS has_name, p_partkey % 2 = 0 AS has_user, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS user_name FROM part""")
def scalar_maps(spark, sf_dir):
    m = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("name"), F.col("p_name"))
    headers = F.map_filter(F.create_map(F.lit("authorization"), F.col("p_name")), lambda k, v: F.col("p_partkey") % 2 == 0)
    p = _part(spark, sf_dir).select("p_partkey", m.alias("m"), headers.alias("h"), "p_name")
    has = F.map_contains_key("h", F.lit("authorization"))
    return p.select("p_partkey", F.map_keys("m").alias("keys"), F.map_values("m").alias("vals"), F.map_contains_key("m", F.lit("name")).alias("has_name"), has.alias("has_user"), F.when(has, F.struct("p_name"))["p_name"].alias("user_name"))


_I8 = "cast((l_partkey * 37 + l_linenumber) % 256 - 128 AS bigint) AS a, cast((l_suppkey * 91 + l_orderkey) % 256 - 128 AS bigint) AS b"
_W = "(a + 256) % 256 AS ua, (b + 256) % 256 AS ub"


def _s8(x: str) -> str:
    return f"((({x}) % 256 + 384) % 256 - 128)"


@query(f"""SELECT l_orderkey, l_linenumber, a, b, {_s8('a + b')} AS iadd, {_s8('a - b')} AS isub, {_s8('a * b')} AS imul, {_s8('-a')} AS ineg, {_s8('abs(a)')} AS iabs,
CASE WHEN b <> 0 THEN {_s8('ua // ub')} END AS udiv, CASE WHEN b <> 0 THEN {_s8('ua % ub')} END AS urem, CASE WHEN b <> 0 AND NOT (a = -128 AND b = -1) THEN cast(trunc(a / b) AS bigint) END AS sdiv, CASE WHEN b <> 0 THEN a % b END AS srem,
least(a, b) AS smin, greatest(a, b) AS smax, CASE WHEN ua <= ub THEN a ELSE b END AS umin, CASE WHEN ua >= ub THEN a ELSE b END AS umax, cast(floor(a * b / 256) AS bigint) AS smulhi, {_s8('(ua * ub) // 256')} AS umulhi,
{_s8('least(ua + ub, 255)')} AS uadd_sat, {_s8('greatest(ua - ub, 0)')} AS usub_sat, least(127, greatest(-128, a + b)) AS sadd_sat, least(127, greatest(-128, a - b)) AS ssub_sat, {_s8('(ua + ub + 1) // 2')} AS avg_round,
ua + ub > 255 AS carry, a * b > 127 OR a * b < -128 AS smul_over, ua < ub AS ult, a < b AS slt FROM (SELECT *, {_W} FROM (SELECT l_orderkey, l_linenumber, {_I8} FROM lineitem))""")
def scalar_ints(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_partkey") * 37 + F.col("l_linenumber")) % 256 - 128).alias("a"), ((F.col("l_suppkey") * 91 + F.col("l_orderkey")) % 256 - 128).alias("b"))
    a, b, w = F.col("a"), F.col("b"), 8
    two = {n: getattr(ints, n)(a, b, w).cast("bigint").alias(n) for n in ("iadd", "isub", "imul", "udiv", "urem", "sdiv", "srem", "umin", "umax", "smulhi", "umulhi", "uadd_sat", "usub_sat", "sadd_sat", "ssub_sat", "avg_round")}
    return li.select(
        "l_orderkey", "l_linenumber", "a", "b", *two.values(), ints.ineg(a, w).alias("ineg"), ints.iabs(a, w).alias("iabs"), F.least(a, b).alias("smin"), F.greatest(a, b).alias("smax"),
        ints.uadd_overflow(a, b, w)["overflow"].alias("carry"), ints.smul_overflow(a, b, w)["overflow"].alias("smul_over"), ints.icmp("ult", a, b, w).alias("ult"), ints.icmp("slt", a, b, w).alias("slt"),
    )


_M = "4294967295"


@query(f"""SELECT o_orderkey, x & y AS band, x | y AS bor, xor(x, y) AS bxor, ~x AS bnot, x & ~y AS band_not, x | ~y AS bor_not, xor(x, ~y) AS bxor_not, (k & x) | (~k & y) AS bitselect, bit_count(x) AS popcnt,
CASE WHEN x = 0 THEN 32 ELSE 32 - length(ltrim(bin(x), '0')) END AS clz, CASE WHEN x = 0 THEN 32 ELSE 32 - length(rtrim(lpad(bin(x), 32, '0'), '0')) END AS ctz,
CASE WHEN ((x << n) & {_M}) >= 2147483648 THEN ((x << n) & {_M}) - 4294967296 ELSE (x << n) & {_M} END AS ishl, x >> n AS ushr, CASE WHEN r >= 2147483648 THEN r - 4294967296 ELSE r END AS rotl
FROM (SELECT *, ((x << n) | (x >> (32 - n))) & {_M} AS r FROM (SELECT o_orderkey, (o_custkey * 2654435 + o_orderkey) % 2147483648 AS x, o_orderkey * 7919 % 2147483648 AS y, o_custkey * 131 AS k, cast(o_orderkey % 31 AS integer) AS n FROM orders))""")
def scalar_bits(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_custkey") * 2654435 + F.col("o_orderkey")) % 2147483648).alias("x"), (F.col("o_orderkey") * 7919 % 2147483648).alias("y"), (F.col("o_custkey") * 131).alias("k"), (F.col("o_orderkey") % 31).cast("int").alias("n"))
    x, y, k, n = F.col("x"), F.col("y"), F.col("k"), F.col("n")
    return o.select(
        "o_orderkey", x.bitwiseAND(y).alias("band"), x.bitwiseOR(y).alias("bor"), x.bitwiseXOR(y).alias("bxor"), F.bitwise_not(x).alias("bnot"), ints.band_not(x, y).alias("band_not"), ints.bor_not(x, y).alias("bor_not"), ints.bxor_not(x, y).alias("bxor_not"),
        ints.bitselect(k, x, y).alias("bitselect"), ints.popcnt(x, 32).cast("bigint").alias("popcnt"), ints.clz(x, 32).cast("bigint").alias("clz"), ints.ctz(x, 32).cast("bigint").alias("ctz"), ints.ishl(x, n, 32).alias("ishl"), ints.ushr(x, n, 32).alias("ushr"), ints.rotl(x, n, 32).alias("rotl"),
    )


_U64, _S63 = "18446744073709551616", "9223372036854775808"
_SIGNED = lambda x: f"cast(CASE WHEN {x} >= {_S63} THEN {x}::HUGEINT - {_U64} ELSE {x}::HUGEINT END AS bigint)"
_BITS64 = lambda x: f"cast(cast({x} AS bit) AS varchar)"


@query(f"""SELECT k, a, b, {_SIGNED(f"((ua + ub) % {_U64})")} AS iadd, {_SIGNED(f"((ua + {_U64}::UHUGEINT - ub) % {_U64})")} AS isub, {_SIGNED(f"((ua * ub) % {_U64}::UHUGEINT)")} AS imul, {_SIGNED(f"((ua * ub) // {_U64}::UHUGEINT)")} AS umulhi,
cast((a::HUGEINT * b - (((a::HUGEINT * b) % {_U64} + {_U64}) % {_U64})) // {_U64} AS bigint) AS smulhi, {_SIGNED("(ua // ub)")} AS udiv, {_SIGNED("(ua % ub)")} AS urem, CASE WHEN ua <= ub THEN a ELSE b END AS umin, {_SIGNED(f"(CASE WHEN ua + ub >= {_U64} THEN {_U64}::UHUGEINT - 1 ELSE ua + ub END)")} AS uadd_sat,
position('1' IN {_BITS64("a")}) - 1 AS clz, position('1' IN reverse({_BITS64("a")})) - 1 AS ctz, bit_count(a) AS popcnt, cast(cast(reverse({_BITS64("a")}) AS bit) AS bigint) AS bitrev,
cast(cast(array_to_string(list_transform(range(8), lambda i: substr({_BITS64("a")}, cast(57 - 8 * i AS bigint), 8)), '') AS bit) AS bigint) AS bswap
FROM (SELECT k, a, b, CASE WHEN a < 0 THEN a::HUGEINT + {_U64} ELSE a::HUGEINT END::UHUGEINT AS ua, CASE WHEN b < 0 THEN b::HUGEINT + {_U64} ELSE b::HUGEINT END::UHUGEINT AS ub FROM (SELECT k, {_SIGNED("x")} AS a, {_SIGNED("y")} AS b
FROM (SELECT o_orderkey AS k, ((o_orderkey + 1)::HUGEINT * 11400714819323198485) % {_U64} AS x, ((o_custkey + 1)::HUGEINT * 13787848793156543929) % {_U64} AS y FROM orders)))""")
def scalar_ints_wide(spark, sf_dir):
    """The integer operators at 64 bits, over numbers spread over the whole range."""
    spread = lambda c, m: ints.wrap((F.col(c) + 1).cast(ints.DEC) * F.lit(m).cast(ints.DEC), 64)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), spread("o_orderkey", "11400714819323198485").alias("a"), spread("o_custkey", "13787848793156543929").alias("b"))
    a, b, w = F.col("a"), F.col("b"), 64
    two = [getattr(ints, n)(a, b, w).cast("bigint").alias(n) for n in ("iadd", "isub", "imul", "umulhi", "smulhi", "udiv", "urem", "umin", "uadd_sat")]
    return o.select("k", "a", "b", *two, *[getattr(ints, n)(a, w).cast("bigint").alias(n) for n in ("clz", "ctz", "popcnt", "bitrev", "bswap")])


@query("SELECT l_orderkey, l_linenumber, l_quantity * l_linenumber + round(l_extendedprice) AS fma FROM lineitem")
def scalar_fused(spark, sf_dir):
    """Fused multiply-add of numbers whose results are exact either way; tests have those that aren't."""
    x = floats.fma(F.col("l_quantity"), F.col("l_linenumber"), F.round("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", x.alias("fma"))


@query("SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '*', 'g') AS starred, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS raised FROM part")
def scalar_replaced(spark, sf_dir):
    """replaceAll by a pattern, and with a function of the match."""
    raised = codecs.replace_with(F.col("p_name"), "^.", _raise)
    return _part(spark, sf_dir).select("p_partkey", F.regexp_replace("p_name", "[aeiou]", "*").alias("starred"), raised.alias("raised"))


def _raise(m):
    return m.group().upper()


@query("""SELECT l_orderkey, l_linenumber, x + y AS fadd, x - y AS fsub, x * y AS fmul, CASE WHEN y = 0 AND x > 0 THEN 'Infinity'::double WHEN y = 0 AND x < 0 THEN '-Infinity'::double WHEN y = 0 THEN 'NaN'::double ELSE x / y END AS fdiv, -x AS fneg, abs(x) AS fabs, sqrt(abs(x)) AS root,
ceil(x) AS ceil, floor(x) AS floor, trunc(x) AS trunc, round_even(x, 0) AS nearest, least(x, y) AS fmin, greatest(x, y) AS fmax, x < y AS lt, cast(greatest(-128, least(127, trunc(x))) AS bigint) AS to_s8, cast(greatest(0, least(255, trunc(x))) AS bigint) AS to_u8,
cast(cast(x AS float) AS double) AS demoted FROM (SELECT l_orderkey, l_linenumber, l_quantity * 10.25 - 250.5 AS x, round(l_discount * 100) - 5 AS y FROM lineitem)""")
def scalar_floats(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 10.25 - 250.5).alias("x"), (F.round(F.col("l_discount") * 100) - 5).alias("y"))
    x, y = F.col("x"), F.col("y")
    # of a null the SQL has NaN over 0, and the upper bound, as least passes nulls over
    over, bounded = F.when(x.isNull() & (y == 0), 0.0).otherwise(x), F.coalesce(x, F.lit(floats.INF))
    return li.select(
        "l_orderkey", "l_linenumber", (x + y).alias("fadd"), (x - y).alias("fsub"), (x * y).alias("fmul"), floats.fdiv(over, y).alias("fdiv"), (-x).alias("fneg"), F.abs(x).alias("fabs"), F.sqrt(F.abs(x)).alias("root"), floats.ceil(x).alias("ceil"), floats.floor(x).alias("floor"),
        floats.trunc(x).alias("trunc"), floats.nearest(x).alias("nearest"), floats.fmin(x, y).alias("fmin"), floats.fmax(x, y).alias("fmax"), floats.fcmp("lt", x, y).alias("lt"), floats.to_sint_sat(bounded, 8).alias("to_s8"), floats.to_uint_sat(bounded, 8).cast("bigint").alias("to_u8"), floats.fpromote(floats.fdemote(x)).alias("demoted"),
    )


@query("""SELECT s_suppkey, [a + b, b + a, a + b, b + a] AS pairwise, [b, 0, a] AS swizzled, b AS lane, [a, 7, a, b] AS inserted, [a, a, a] AS splat, a <> 0 AND b <> 0 AS all_true, a <> 0 OR b <> 0 AS any_true,
CASE WHEN a < 0 THEN 5 ELSE 0 END + CASE WHEN b < 0 THEN 10 ELSE 0 END AS high, [least(127, greatest(-128, a * 100)), least(127, greatest(-128, b * 100))] AS narrow, [a, b] AS wide
FROM (SELECT s_suppkey, s_suppkey % 5 - 2 AS a, cast(s_nationkey % 3 - 1 AS bigint) AS b FROM supplier)""")
def scalar_lanes(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 5 - 2).alias("a"), (F.col("s_nationkey") % 3 - 1).cast("bigint").alias("b"))
    a, b = F.col("a"), F.col("b")
    v = F.array(a, b, a, b)
    return s.select(
        "s_suppkey", lanes.iadd_pairwise(v, F.array(a, b, b, a), 32).alias("pairwise"), lanes.swizzle(v, F.array(F.lit(1), F.lit(9), F.lit(2))).alias("swizzled"), lanes.extractlane(v, 1).alias("lane"), lanes.insertlane(v, 1, F.lit(7)).alias("inserted"), lanes.splat(a, 3).alias("splat"),
        lanes.vall_true(v).alias("all_true"), lanes.vany_true(v).alias("any_true"), lanes.vhigh_bits(v).alias("high"), lanes.snarrow(F.array(a * 100, b * 100), 8).alias("narrow"), lanes.swiden_low(v).alias("wide"),
    )


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN '{"t":"Unit","v":null}' WHEN 'F' THEN '{"t":"Newtype","v":' || o_custkey || '}' ELSE '{"t":"Tuple","v":[' || o_custkey || ',"' || o_orderpriority || '"]}' END AS json FROM orders""")
def enum_adjacent_json(spark, sf_dir):
    n, text = F.col("o_custkey").cast("string"), X.json_string(F.col("o_orderpriority"))
    unit, newtype, tup = X.tagged(F.lit("Unit")), X.tagged(F.lit("Newtype"), n), X.tagged(F.lit("Tuple"), X.json_of(n, text))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", unit).when(F.col("o_orderstatus") == "F", newtype).otherwise(tup).alias("json"))


@query("""SELECT p_partkey, CASE WHEN p_partkey = 999 THEN 'NotFound' WHEN p_partkey % 2 = 0 THEN 'InStock(50)' ELSE 'PreOrder' END AS stock, [p_partkey + 1, p_partkey + 2, p_partkey + 3] AS related FROM part""")
def page_product(spark, sf_dir):
    n = F.col("p_partkey")
    return _part(spark, sf_dir).select("p_partkey", F.when(n == 999, "NotFound").when(n % 2 == 0, "InStock(50)").otherwise("PreOrder").alias("stock"), F.array(n + 1, n + 2, n + 3).alias("related"))


@query("""SELECT user_id AS stream_id, string_agg(props, '' ORDER BY event_id) AS text FROM events GROUP BY 1""")
def stream_consumers_whole(spark, sf_dir):
    chunks = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), F.col("props").cast("binary").alias("chunk"))
    return blobs.consume(chunks).select("stream_id", "text")


@query("SELECT event_id, [props] AS data FROM events")
def server_sent_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", blobs.event_data(F.concat(F.lit(": hello\n\ndata: "), F.col("props"), F.lit("\n\n"))).alias("data"))


_S32 = "CASE WHEN {0} >= 2147483648 THEN {0} - 4294967296 ELSE {0} END"


@query(f"""SELECT o_orderkey, {_S32.format('r')} AS rotr, cast(floor(s / (1 << n)) AS bigint) AS sshr, CASE WHEN v = 0 THEN 31 ELSE 31 - length(ltrim(bin(v), '0')) END AS cls, cast(cast(cast(reverse(lpad(bin(x), 32, '0')) AS bit) AS integer) AS bigint) AS bitrev,
{_S32.format('w')} AS bswap, (a + 256) % 256 AS uextend, a AS sextend, {_s8('x')} AS ireduce
FROM (SELECT *, ((x >> n) | ((x << (32 - n)) & {_M})) & {_M} AS r, CASE WHEN s < 0 THEN -s - 1 ELSE s END AS v, ((x & 255) << 24) | (((x >> 8) & 255) << 16) | (((x >> 16) & 255) << 8) | (x >> 24) AS w
FROM (SELECT *, x - 1073741824 AS s, o_orderkey % 256 - 128 AS a, cast(o_orderkey % 31 AS integer) AS n FROM (SELECT o_orderkey, (o_custkey * 2654435 + o_orderkey) % 2147483648 AS x FROM orders)))""")
def scalar_bits_moved(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_custkey") * 2654435 + F.col("o_orderkey")) % 2147483648).alias("x"), (F.col("o_orderkey") % 256 - 128).alias("a"), (F.col("o_orderkey") % 31).cast("int").alias("n"))
    x, a, n, s = F.col("x"), F.col("a"), F.col("n"), F.col("x") - 1073741824
    return o.select(
        "o_orderkey", ints.rotr(x, n, 32).alias("rotr"), ints.sshr(s, n, 32).alias("sshr"), ints.cls(s, 32).cast("bigint").alias("cls"), ints.bitrev(x, 32).alias("bitrev"), ints.bswap(x, 32).alias("bswap"),
        ints.uextend(a, 8).alias("uextend"), ints.sextend(a, 8).alias("sextend"), ints.ireduce(x, 8).alias("ireduce"),
    )


@query("""SELECT o_orderkey, (e + 1023) * 4503599627370496 + (k - (1 << e)) * (1 << (52 - e)) AS bits, cast(k AS double) AS back, CASE WHEN k % 2 = 0 THEN -o_totalprice ELSE o_totalprice END AS copysign,
cast(CASE WHEN k % 2 = 0 THEN 4294967296 - k ELSE k END AS double) AS from_uint, CASE WHEN k % 3 = 0 THEN o_custkey ELSE k END AS chosen
FROM (SELECT *, length(bin(k)) - 1 AS e FROM (SELECT *, o_orderkey + 1 AS k FROM orders))""")
def scalar_conversions(spark, sf_dir):
    k = F.col("o_orderkey") + 1
    signed = F.when(k % 2 == 0, -k).otherwise(k)
    bits = floats.bitcast(k.cast("double"), "bigint")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", bits.alias("bits"), floats.bitcast(bits, "double").alias("back"), floats.fcopysign(F.col("o_totalprice"), signed.cast("double")).alias("copysign"), floats.from_uint(signed, 32).alias("from_uint"), F.when(k % 3 == 0, F.col("o_custkey")).otherwise(k).alias("chosen"),
    )


@query("SELECT s_suppkey, [least(255, greatest(0, a * 100)), least(255, greatest(0, b * 100))] AS unarrow, [(a + 256) % 256] AS uwiden FROM (SELECT s_suppkey, s_suppkey % 9 - 4 AS a, cast(s_nationkey % 3 - 1 AS bigint) AS b FROM supplier)")
def scalar_lanes_unsigned(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 9 - 4).alias("a"), (F.col("s_nationkey") % 3 - 1).cast("bigint").alias("b"))
    a, b = F.col("a"), F.col("b")
    return s.select("s_suppkey", lanes.unarrow(F.array(a * 100, b * 100), 8).alias("unarrow"), lanes.uwiden_low(F.array(a, b), 8).alias("uwiden"))


@query("""SELECT p_partkey, p_brand AS last_wins, [p_name, p_brand, p_type] AS flat, CASE WHEN p_size % 2 = 0 THEN '"Unit"' ELSE '{"Newtype":' || p_size || '}' END AS external, format('{:,.2f}', p_retailprice * 1000) AS localized,
-1 AS compared, true AS well_formed, 'a' || chr(65533) || 'b' AS repaired, p_brand AS entry FROM part""")
def scalar_structures(spark, sf_dir):
    entry = lambda k, v: F.struct(F.lit(k).alias("k"), F.col(v).alias("v"))
    m = X.from_entries(F.array(entry("x", "p_name"), entry("y", "p_type"), entry("x", "p_brand")))
    nested = F.array(F.array(F.array("p_name", "p_brand")), F.array(F.array("p_type")))
    external = F.when(F.col("p_size") % 2 == 0, X.external_tag(F.lit("Unit"))).otherwise(X.external_tag(F.lit("Newtype"), F.col("p_size").cast("string")))
    return _part(spark, sf_dir).select(
        "p_partkey", F.element_at(m, "x").alias("last_wins"), F.flatten(F.flatten(nested)).alias("flat"), external.alias("external"), F.format_number(F.col("p_retailprice") * 1000, 2).alias("localized"), X.locale_compare(F.lit("a"), F.lit("B")).alias("compared"),
        X.is_well_formed(F.col("p_name")).alias("well_formed"), X.to_well_formed(F.lit(bytearray(b"a\xffb")).cast("string")).alias("repaired"), F.get(F.filter(F.map_entries(m), lambda e: e["key"] == "x"), F.lit(0))["value"].alias("entry"),
    )
