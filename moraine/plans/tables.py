"""Document store, log, fleet, catalogues, key-value store, listings."""

from __future__ import annotations

import base64
import hashlib
import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import fleet, listing, log, store
from .registry import query, table


def docs(spark, sf_dir):
    """events as the document table: pk event_type, sk event_id, value props."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("pk"), F.col("event_id").alias("sk"), F.col("props").alias("value"))


def order_log(spark, sf_dir):
    """orders as a log with numbers from 1."""
    return table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("seq"), F.col("o_custkey").alias("value"))


def kv(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_name").alias("key"), F.col("c_custkey").alias("value"))


@query("SELECT event_id AS sk, props AS value FROM events WHERE event_type = 'click' ORDER BY sk")
def doc_prefix_scan(spark, sf_dir):
    return store.prefix_scan(docs(spark, sf_dir), "click").select("sk", "value")


@query("SELECT event_id AS sk, cast(json_extract_string(props, '$.k') AS bigint) AS k FROM events WHERE event_type = 'error' AND event_id > 100 ORDER BY sk")
def doc_keyset_after(spark, sf_dir):
    rows = store.keyset_after(docs(spark, sf_dir), "error", 100)
    return rows.select("sk", store.decode_json(F.col("value"), "k bigint")["k"].alias("k"))


@query("SELECT event_type AS pk, event_id AS sk, props AS value FROM events WHERE event_type = 'error' AND event_id = 0 LIMIT 1")
def doc_point_get(spark, sf_dir):
    return store.point_get(docs(spark, sf_dir), "error", 0)


@query("SELECT event_type AS pk, count(*) AS n, sum(cast(json_extract_string(props, '$.k') AS bigint)) AS sum_k FROM events GROUP BY 1")
def doc_json_decode(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("k", store.decode_json(F.col("value"), "k bigint")["k"])
    return d.groupBy("pk").agg(F.count(F.lit(1)).alias("n"), F.sum("k").cast("bigint").alias("sum_k"))


@query("SELECT event_type AS pk, event_id AS sk, CASE WHEN event_id % 2 = 0 THEN '{\"k\": -1}' ELSE props END AS value FROM events UNION ALL SELECT 'new', max(event_id) + 1, '{}' FROM events")
def doc_upsert_replace(spark, sf_dir):
    base = docs(spark, sf_dir)
    new = base.agg((F.max("sk") + 1).alias("sk")).select(F.lit("new").alias("pk"), "sk", F.lit("{}").alias("value"))
    delta = base.filter("sk % 2 = 0").withColumn("value", F.lit('{"k": -1}')).unionByName(new)
    return store.upsert(base, delta, ["pk", "sk"])


@query("SELECT event_id AS sk, cast(event_id AS decimal(20,0)) AS code_id, cast(user_id AS decimal(20,0)) AS code_version FROM events")
def doc_fixed_binary(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("sk"), store.encode_deployment(F.col("event_id"), F.col("user_id")).alias("value"))
    return e.select("sk", store.decode_deployment(F.col("value")).alias("d")).select("sk", "d.code_id", "d.code_version")


@query("SELECT c_custkey AS value FROM customer WHERE c_name = 'Customer#000000007'")
def doc_read_named(spark, sf_dir):
    return store.read_named(kv(spark, sf_dir), "Customer#000000007").select("value")


@query("""SELECT p_partkey, p_size > 0 AND p_size * 2 <= 100 AND p_size < p_size * 2 AND p_size <= p_partkey % 60 AND p_partkey % 60 > 0 AS valid FROM part""")
def config_constraints(spark, sf_dir):
    p, n = table(spark, sf_dir, "part"), F.col("p_size").cast("bigint")
    values = [n, n, n, n * 2, n, F.col("p_partkey") % 60, n, n, n]
    config = F.struct(*[v.alias(f.name) for v, f in zip(values, store.SCALE_CONFIG)])
    decoded = store.decode_json(F.to_json(config), store.SCALE_CONFIG)
    return p.select("p_partkey", decoded.alias("c")).select("p_partkey", store.valid_config(F.col("c")).alias("valid"))


@query("SELECT o_orderkey + 1 AS seq, o_custkey AS value FROM orders WHERE o_orderkey >= 1000 ORDER BY seq")
def log_slice_after(spark, sf_dir):
    return log.slice_after(order_log(spark, sf_dir), 1000)


@query("SELECT max(o_orderkey) + 1 AS last_seq, count(*) AS n_rows, max(o_orderkey) + 1 = count(*) AS is_dense FROM orders")
def log_max_seq(spark, sf_dir):
    return log.ends(order_log(spark, sf_dir))


@query("""WITH l AS (SELECT o_orderkey + 1 AS seq FROM orders WHERE o_custkey % 3 <> 0), n AS (SELECT seq, lead(seq) OVER (ORDER BY seq) AS nx FROM l)
SELECT seq AS after, nx - seq - 1 AS missing FROM n WHERE nx - seq > 1""")
def log_gap_check(spark, sf_dir):
    return log.gaps(order_log(spark, sf_dir).filter("value % 3 <> 0"))


@query("""SELECT n_nationkey AS host, list(o_custkey ORDER BY o_orderkey) FILTER (WHERE o_custkey IS NOT NULL) AS updates
FROM nation LEFT JOIN orders ON o_orderkey + 1 > (SELECT count(*) FROM orders) - n_nationkey - 1 GROUP BY 1""")
def host_delta_range_join(spark, sf_dir):
    log_rows = order_log(spark, sf_dir)
    n = log_rows.agg(F.count(F.lit(1)).alias("n"))
    hosts = table(spark, sf_dir, "nation").crossJoin(F.broadcast(n)).select(F.col("n_nationkey").alias("host"), (F.col("n") - F.col("n_nationkey") - 1).alias("deployment_id"))
    return log.deltas(hosts, log_rows)


@query("SELECT n_nationkey AS host, (SELECT max(o_orderkey) + 1 FROM orders) AS latest_id FROM nation")
def host_advertise(spark, sf_dir):
    return log.advertise(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("host")), order_log(spark, sf_dir))


def _beats(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("host"), F.col("ts").alias("received_at"))


def _now(spark, sf_dir):
    """The latest heartbeat as a one-row table."""
    return table(spark, sf_dir, "events").agg(F.max("ts").alias("now"))


_LAST = "WITH s AS (SELECT user_id AS host, max(ts) AS received_at FROM events GROUP BY 1), n AS (SELECT max(ts) AS now FROM events) "
HOURS6 = 6 * 3600


@query(_LAST + "SELECT host, received_at, epoch_us(now) - epoch_us(received_at) < 21600000000 AS alive FROM s, n")
def fleet_liveness_split(spark, sf_dir):
    s = fleet.latest(_beats(spark, sf_dir)).crossJoin(F.broadcast(_now(spark, sf_dir)))
    return s.select("host", "received_at", fleet.alive(F.col("now"), F.col("received_at"), HOURS6).alias("alive"))


@query(_LAST + "SELECT host, received_at, host < 100 AS closed FROM s, n WHERE epoch_us(now) - epoch_us(received_at) >= 21600000000")
def fleet_reap(spark, sf_dir):
    s = fleet.latest(_beats(spark, sf_dir)).crossJoin(F.broadcast(_now(spark, sf_dir)))
    connections = s.filter("host < 100").select("host")
    dead = fleet.reap(s, connections, F.col("now"), HOURS6)
    return dead


@query(_LAST + """SELECT host FROM s, n WHERE received_at + INTERVAL 15 SECOND < now AND received_at - INTERVAL 1 DAY + INTERVAL 60 SECOND < now AND host % 4 <> 0 AND host % 10 <> 3""")
def fleet_reap_candidates(spark, sf_dir):
    s = fleet.latest(_beats(spark, sf_dir)).crossJoin(F.broadcast(_now(spark, sf_dir)))
    checks = s.select("host", F.col("received_at").alias("last_check"), "now")
    info = s.select("host", (F.col("received_at") - F.expr("interval 1 day")).alias("created"), F.when(F.col("host") % 4 == 0, "Terminating").otherwise("Running").alias("state"))
    previous = s.filter("host % 10 = 3").select("host")
    return fleet.termination_candidates(checks, info, previous, F.col("now")).select("host")


@query(_LAST + "SELECT count(*) AS n_hosts, count(*) FILTER (WHERE epoch_us(now) - epoch_us(received_at) < 21600000000) AS n_alive, count(*) FILTER (WHERE epoch_us(now) - epoch_us(received_at) >= 21600000000) AS n_dead FROM s, n")
def fleet_counts(spark, sf_dir):
    s = fleet.latest(_beats(spark, sf_dir)).crossJoin(F.broadcast(_now(spark, sf_dir)))
    return fleet.counts(s, F.col("now"), HOURS6)


@query("SELECT ip, row_number() OVER (ORDER BY a, b) AS place FROM (SELECT DISTINCT '10.0.' || (s_suppkey % 7) || '.' || (s_nationkey * 3) AS ip, s_suppkey % 7 AS a, s_nationkey * 3 AS b FROM supplier)")
def fleet_distinct_set(spark, sf_dir):
    from pyspark.sql import Window

    ips = table(spark, sf_dir, "supplier").select(F.concat(F.lit("10.0."), (F.col("s_suppkey") % 7).cast("string"), F.lit("."), (F.col("s_nationkey") * 3).cast("string")).alias("ip"))
    return fleet.address_set(ips).select("ip", F.row_number().over(Window.orderBy(X.ip_key(F.col("ip")))).cast("bigint").alias("place"))


@query("SELECT s_suppkey AS ip FROM supplier WHERE s_nationkey % 3 = 0")
def fleet_role_filter(spark, sf_dir):
    role = F.when(F.col("s_nationkey") % 3 == 0, "worker").when(F.col("s_nationkey") % 3 == 1, "leader")
    return fleet.workers(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ip"), role.alias("role")))


@query("SELECT p_partkey, least(cast(p_size * 4 AS bigint), 2 * (p_partkey % 64)) AS capacity FROM part")
def capacity_least(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", fleet.capacity(F.col("p_size").cast("bigint"), F.lit(4), F.lit(2), F.col("p_partkey") % 64).cast("bigint").alias("capacity"))


@query("""WITH d AS (SELECT n_nationkey AS code_id, n_regionkey AS dep FROM nation WHERE n_nationkey % 5 <> 4)
SELECT s_suppkey, a, b, x.dep = y.dep AS same FROM (SELECT s_suppkey, s_nationkey AS a, cast((s_nationkey + 5) % 25 AS integer) AS b FROM supplier) p
LEFT JOIN d x ON a = x.code_id LEFT JOIN d y ON b = y.code_id""")
def catalog_same_deployment(spark, sf_dir):
    d = table(spark, sf_dir, "nation").filter("n_nationkey % 5 <> 4").select(F.col("n_nationkey").alias("code_id"), F.col("n_regionkey").alias("deployment_id"))
    pairs = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("a"), ((F.col("s_nationkey") + 5) % 25).cast("int").alias("b"))
    same = fleet.same_deployment(pairs.select("a", "b").distinct(), d)
    return pairs.join(same, ["a", "b"]).select("s_suppkey", "a", "b", "same")


@query("""SELECT n_nationkey AS code_id, CASE WHEN r_regionkey IS NULL THEN NULL WHEN r_regionkey % 2 = 0 THEN 'js' ELSE 'wasm' END AS kind,
CASE WHEN r_regionkey IS NULL THEN 'error' WHEN r_regionkey % 2 = 0 THEN 'script' ELSE 'component' END AS executor FROM nation LEFT JOIN region ON n_nationkey = r_regionkey""")
def catalog_kind_lookup(spark, sf_dir):
    manifests = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("code_id"), F.when(F.col("r_regionkey") % 2 == 0, "js").otherwise("wasm").alias("kind"))
    return fleet.kind_lookup(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("code_id")), manifests)


@query("SELECT n_nationkey AS code_id, CASE WHEN n_nationkey < 5 THEN 'default' ELSE 'd' || n_regionkey END AS deployment_id FROM nation")
def catalog_register(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "code_id")
    d = n.select("code_id", F.concat(F.lit("d"), F.col("n_regionkey").cast("string")).alias("deployment_id"))
    codes = n.filter("code_id < 5").select("code_id", F.lit("js").alias("kind"))
    return fleet.register_code(d, n.select("code_id", F.lit("wasm").alias("kind")), codes)[0]


@query("SELECT n_nationkey AS code_id, CASE WHEN n_nationkey < 5 THEN 'js' ELSE 'wasm' END AS kind FROM nation")
def catalog_register_kinds(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "code_id")
    d = n.select("code_id", F.concat(F.lit("d"), F.col("n_regionkey").cast("string")).alias("deployment_id"))
    return fleet.register_code(d, n.select("code_id", F.lit("wasm").alias("kind")), n.filter("code_id < 5").select("code_id", F.lit("js").alias("kind")))[1]


@query("SELECT event_type, CASE event_type WHEN 'view' THEN 'Good' WHEN 'signup' THEN 'GracefulShuttingDown' END AS status, count(*) AS n FROM events GROUP BY 1")
def probe_status_case(spark, sf_dir):
    body = F.when(F.col("event_type") == "view", "good").when(F.col("event_type") == "signup", "graceful_shutting_down").otherwise("?")
    return table(spark, sf_dir, "events").groupBy("event_type", X.health_status(body).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT page_id, CASE split_part(regexp_extract(url, '://[^/]+(/[^?#]*)', 1), '/', 2) WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' ELSE '404' END AS resource FROM pages""")
def request_routing(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", fleet.route(F.regexp_extract("url", "://[^/]+(/[^?#]*)", 1), {"en": "english", "de": "german"}).alias("resource"))


_WANT = "(SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS pos, 'Customer#' || lpad(cast(s_suppkey * 37 AS varchar), 9, '0') AS key FROM supplier)"


def _wanted(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("pos"), F.concat(F.lit("Customer#"), F.lpad((F.col("s_suppkey") * 37).cast("string"), 9, "0")).alias("key"))


@query(f"SELECT pos, key, c_custkey AS value, c_custkey IS NOT NULL AS found FROM {_WANT} LEFT JOIN customer ON c_name = key ORDER BY pos")
def kv_get_many_positional(spark, sf_dir):
    return store.get_many(kv(spark, sf_dir), _wanted(spark, sf_dir)).orderBy("pos")


@query(f"SELECT key, key IN (SELECT c_name FROM customer) AS found FROM {_WANT}")
def kv_exists(spark, sf_dir):
    return store.exists(kv(spark, sf_dir), _wanted(spark, sf_dir))


@query("SELECT c_name AS key FROM customer WHERE c_name > 'Customer#000000042' ORDER BY key LIMIT 20")
def kv_list_page(spark, sf_dir):
    return store.list_keys(kv(spark, sf_dir), "Customer#000000042", 20)


@query("SELECT c_name AS key, CASE WHEN c_custkey % 10 = 0 THEN -c_custkey ELSE c_custkey END AS value FROM customer")
def kv_set_many(spark, sf_dir):
    base = kv(spark, sf_dir)
    return store.upsert(base, base.filter("value % 10 = 0").withColumn("value", -F.col("value")), ["key"])


@query("SELECT c_name AS key, c_custkey AS value FROM customer WHERE c_custkey % 7 <> 0")
def kv_delete_many(spark, sf_dir):
    base = kv(spark, sf_dir)
    return store.delete_many(base, base.filter("value % 7 = 0").union(spark.createDataFrame([("absent", 0)], "key string, value bigint")), ["key"])


@query("""SELECT coalesce(c_name, key) AS key, coalesce(c_custkey, 0) + coalesce(d, 0) AS value FROM customer FULL JOIN
(SELECT 'Customer#' || lpad(cast(o_custkey * 2 AS varchar), 9, '0') AS key, count(*) AS d FROM orders GROUP BY 1) ON c_name = key""")
def kv_increment(spark, sf_dir):
    deltas = table(spark, sf_dir, "orders").select(F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") * 2).cast("string"), 9, "0")).alias("key"), F.lit(1).cast("bigint").alias("delta"))
    return store.increment(kv(spark, sf_dir), deltas)


@query("SELECT list_value(c_mktsegment, c_name) AS key, c_custkey AS value FROM customer WHERE c_mktsegment = 'MACHINERY' ORDER BY c_name")
def kv_prefix_list(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.array("c_mktsegment", "c_name").alias("key"), F.col("c_custkey").alias("value"))
    return store.prefix_list(c, ["MACHINERY"])


@query("SELECT c_name AS key FROM customer ORDER BY key LIMIT 1 OFFSET 17")
def web_storage_key(spark, sf_dir):
    return store.nth_key(kv(spark, sf_dir), 17)


@query("SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN length(html) END AS response FROM pages")
def cache_match(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    cache = p.filter("page_id % 3 = 0").groupBy("url", "page_id").agg(F.first(F.length("html").cast("bigint")).alias("value"))
    return store.cache_match(cache, p.select("page_id", "url"), ["page_id", "url"])


@query("SELECT c_name AS url, CASE WHEN c_custkey % 2 = 0 THEN -c_custkey ELSE c_custkey END AS value FROM customer WHERE c_custkey % 5 <> 0")
def cache_put_delete(spark, sf_dir):
    cache = kv(spark, sf_dir).withColumnRenamed("key", "url")
    put = store.cache_put(cache, cache.filter("value % 2 = 0").withColumn("value", -F.col("value")))
    return store.cache_after(put, cache.filter("value % 5 = 0").select("url"))


@query("SELECT c_name AS url, c_custkey % 5 <> 0 AS deleted FROM customer")
def cache_deleted(spark, sf_dir):
    cache = kv(spark, sf_dir).withColumnRenamed("key", "url")
    return store.cache_delete(cache.filter("value % 5 <> 0"), cache.select("url"))


@query("SELECT c_name AS key, CASE WHEN c_custkey % 2 = 0 THEN 7 ELSE c_custkey END AS value FROM customer")
def web_storage_set(spark, sf_dir):
    base = kv(spark, sf_dir)
    return store.set_items(base, base.filter("value % 2 = 0").withColumn("value", F.lit(7).cast("bigint")), 10**9)


@query("SELECT c_name AS key, c_custkey AS value FROM customer WHERE c_custkey % 4 <> 1")
def web_storage_remove(spark, sf_dir):
    base = kv(spark, sf_dir)
    return store.remove_items(base, base.filter("value % 4 = 1"))


@query("SELECT c_name AS key, c_custkey AS value FROM customer ORDER BY key")
def config_get_all(spark, sf_dir):
    return store.get_all(kv(spark, sf_dir))


@query("SELECT p_partkey, sha256('CREATE TABLE t' || p_partkey || ' (a INT)') AS id FROM part")
def table_ddl_id(spark, sf_dir):
    ddl = F.concat(F.lit("CREATE TABLE t"), F.col("p_partkey").cast("string"), F.lit(" (a INT)"))
    return table(spark, sf_dir, "part").select("p_partkey", store.ddl_id(ddl).alias("id"))


@query("SELECT p_partkey AS id, p_name AS displayName, p_size FROM part")
def fields_renamed(spark, sf_dir):
    from ..functions.codecs import fields

    return fields(table(spark, sf_dir, "part"), {"p_partkey": "id", "p_name": "displayName"}, ["p_brand", "p_type", "p_retailprice"])


@query("""SELECT n_nationkey AS host, o_orderkey + 1 AS seq, o_custkey AS value FROM nation JOIN orders ON o_orderkey + 1 > n_nationkey * (SELECT count(*) FROM orders) // 25""")
def host_delta_rows(spark, sf_dir):
    """Hosts from all along the log: what each lacks, as rows."""
    rows = order_log(spark, sf_dir)
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    hosts = table(spark, sf_dir, "nation").crossJoin(F.broadcast(n)).select(F.col("n_nationkey").alias("host"), F.expr("n_nationkey * n div 25").alias("deployment_id"))
    return log.delta_rows(hosts, rows, 400)


@query("""WITH l AS (SELECT o_orderkey // 3 AS seq, o_orderkey AS value FROM orders) SELECT seq, count(*) AS n FROM (SELECT seq FROM l ORDER BY seq OFFSET 301) GROUP BY 1""")
def log_slice_repeated(spark, sf_dir):
    """A log whose numbers repeat is sliced by its order."""
    rows = table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 3").alias("seq"), F.col("o_orderkey").alias("value"))
    return log.slice_after(rows, 301).groupBy("seq").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND (o_orderdate, o_orderkey) < (TIMESTAMP '1998-01-01', 500) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25")
def list_filter_sort_page(spark, sf_dir):
    import datetime

    found = listing.equal_filters(table(spark, sf_dir, "orders"), o_orderstatus="O", o_orderpriority=None)
    return listing.page(found, "o_orderkey", 25, (datetime.datetime(1998, 1, 1), 500), "o_orderdate", "DESC").select("o_orderkey", "o_orderdate", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderkey > 100 ORDER BY o_orderkey LIMIT 30")
def list_contract_page(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("route_type"), F.col("o_custkey").alias("drg_route_table_id"))
    return listing.list_request(rows, "list_drg_route_rules", "o_orderkey", 30, (100,), route_type="P").select("o_orderkey")


_RESOURCE = "SELECT p_partkey AS id, p_size % 3 AS filter1, p_brand AS filter2, p_retailprice AS time_created, p_name AS display_name, p_type AS module_name, p_brand AS name FROM part"
LISTED_PAGE = 9


def resources(spark, sf_dir):
    """part as listed resources: two fields that requests filter by, and what they sort by."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), (F.col("p_size") % 3).alias("filter1"), F.col("p_brand").alias("filter2"), F.col("p_retailprice").alias("time_created"), F.col("p_name").alias("display_name"), F.col("p_type").alias("module_name"), F.col("p_brand").alias("name")
    )


def _contract_sql() -> str:
    parts = []
    for request, (fields, pages) in sorted(listing.CONTRACTS.items()):
        where = " AND ".join(f"{c} = {v}" for c, v in zip(("filter1", "filter2"), ("1", "'Brand#12'")[: len(fields)])) or "true"
        rows = f"SELECT id, row_number() OVER (ORDER BY id) AS place, count(*) OVER () AS n FROM r WHERE {where}" + (" AND id > 20" if pages else "")
        token = f"""CASE WHEN n > {LISTED_PAGE} THEN to_base64(encode('{{"id":' || (SELECT id FROM ({rows}) WHERE place = {LISTED_PAGE}) || '}}')) END""" if pages else "NULL"
        parts.append(f"SELECT '{request}' AS request, id, place, {token} AS next_token FROM ({rows})" + (f" WHERE place <= {LISTED_PAGE}" if pages else ""))
    return f"WITH r AS ({_RESOURCE}) " + " UNION ALL ".join(parts)


@query(_contract_sql())
def list_contracts(spark, sf_dir):
    """Every list request, filtered by all its fields, a page beyond an opaque token, with the token of the next."""
    out, begin = None, base64.b64encode(b'{"id":20}').decode()
    for request, (fields, pages) in sorted(listing.CONTRACTS.items()):
        named = resources(spark, sf_dir).withColumnsRenamed(dict(zip(("filter1", "filter2"), fields)))
        got = listing.list_response(named, request, "id", LISTED_PAGE, begin if pages else None, **dict(zip(fields, (1, "Brand#12"))))
        got = got.select(F.lit(request).alias("request"), "id", F.col("place").cast("bigint").alias("place"), "next_token")
        out = got if out is None else out.union(got)
    return out


@query(f"WITH r AS ({_RESOURCE}) " + " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{by}' AS sort_by, '{order}' AS sort_order, id, row_number() OVER (ORDER BY {c} {order}, id {order}) AS place FROM r) WHERE place <= {LISTED_PAGE}" for by, c in listing.SORT_KEYS.items() for order in ("ASC", "DESC")
))
def list_sort_keys(spark, sf_dir):
    """Every sort key in either order."""
    out = None
    for by in listing.SORT_KEYS:
        for order in ("ASC", "DESC"):
            got = listing.list_response(resources(spark, sf_dir), "list_services", "id", LISTED_PAGE, None, by, order)
            got = got.select(F.lit(by).alias("sort_by"), F.lit(order).alias("sort_order"), "id", F.col("place").cast("bigint").alias("place"))
            out = got if out is None else out.union(got)
    return out


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey")
def list_all_pages(spark, sf_dir):
    """A listing followed page by page until there is no next token; pages are of a third of it, so three requests or four are made."""
    rows, token, out = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'"), None, None
    size = max(1, rows.count() // 3)
    while True:
        got = listing.with_tokens(rows, "o_orderkey", size, token)
        out = got.select("o_orderkey") if out is None else out.union(got.select("o_orderkey"))
        last = got.select("next_token").limit(1).first()
        token = last["next_token"] if last else None
        if token is None:
            return out


@query("SELECT 'ALL' AS f, count(*) AS n FROM orders UNION ALL SELECT 'F', count(*) FROM orders WHERE o_orderstatus = 'F'")
def list_enum_all(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    one = lambda v: o.filter(listing.enum_filter(F.col("o_orderstatus"), v)).agg(F.lit(v).alias("f"), F.count(F.lit(1)).alias("n"))
    return one("ALL").union(one("F"))


@query("SELECT CASE WHEN o_orderstatus IN ('O', 'F') THEN o_orderstatus ELSE 'UNKNOWN' END AS status, count(*) AS n FROM orders GROUP BY 1")
def list_open_enum(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(listing.open_enum(F.col("o_orderstatus"), ["O", "F"]).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, source FROM documents WHERE contains(lower(concat_ws(' ', text, lang, source)), 'license')")
def search_free_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.filter(X.free_text([F.col("text"), F.col("lang"), F.col("source")], "License")).select("doc_id", "source")


@query("SELECT p_partkey, len(regexp_extract_all(p_name, '(?i)ring')) AS in_name, len(regexp_extract_all(p_brand, '(?i)ring')) AS in_brand FROM part WHERE p_name ILIKE '%ring%' OR p_brand ILIKE '%ring%'")
def search_highlights(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("h", listing.highlights({"p_name": F.col("p_name"), "p_brand": F.col("p_brand")}, "Ring"))
    n = lambda c: F.coalesce(F.size(F.try_element_at("h", F.lit(c))), F.lit(0)).cast("bigint")
    return p.filter(F.size("h") > 0).select("p_partkey", F.greatest(n("p_name"), F.lit(0)).alias("in_name"), F.greatest(n("p_brand"), F.lit(0)).alias("in_brand"))


@query("SELECT DISTINCT p_name AS name, p_size AS version FROM part WHERE (p_name = 'small ring' OR regexp_full_match(p_name, 'blue .*')) AND NOT (p_name = 'blue bolt' AND p_size = 5) AND NOT regexp_full_match(p_name, '.*gear')")
def include_exclude_filter(spark, sf_dir):
    items = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_size").alias("version")).distinct()
    rows = [("INCLUDE", "small ring", None, None), ("INCLUDE", None, "blue .*", None), ("EXCLUDE", "blue bolt", None, 5), ("EXCLUDE", None, ".*gear", None)]
    return listing.include_exclude(items, spark.createDataFrame(rows, "kind string, name string, pattern string, version int"))


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20 OR p_size BETWEEN 7 AND 7")
def port_range_between(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.filter(listing.in_range(F.col("p_size"), 10, 20) | listing.in_range(F.col("p_size"), 7, 7)).select("p_partkey", "p_size")


@query("""SELECT name, event_type, count FROM (SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, count(*) FILTER (WHERE value <= 50) AS low, count(*) FILTER (WHERE user_id < 20) AS early FROM events GROUP BY 1)
UNPIVOT (count FOR name IN (high, low, early))""")
def metric_counts_by_dim(spark, sf_dir):
    return listing.metric_counts(table(spark, sf_dir, "events"), ["event_type"], {"high": F.col("value") > 50, "low": F.col("value") <= 50, "early": F.col("user_id") < 20})


@query("SELECT props, count(*) AS n, min(ts) AS first_seen FROM events GROUP BY 1")
def event_first_seen(spark, sf_dir):
    return listing.first_seen(table(spark, sf_dir, "events"), "props", "ts")


@query("SELECT event_type, list(event_id ORDER BY event_id) AS items FROM events GROUP BY 1")
def group_to_lists_whole(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("pos", F.col("event_id"))
    return listing.group_lists(e, "event_type", "pos", "event_id")


@query("""SELECT user_id AS batch, bool_and(event_type <> 'error') AS all_ok, arg_min(event_id, ts) AS race, arg_min(event_id, ts) FILTER (WHERE event_type <> 'error') AS any_ok,
list(CASE WHEN event_type <> 'error' THEN 'fulfilled' ELSE 'rejected' END ORDER BY ts) AS statuses FROM events GROUP BY 1""")
def promise_fan_in(spark, sf_dir):
    r = table(spark, sf_dir, "events").select(F.col("user_id").alias("batch"), F.col("ts").alias("finished_at"), (F.col("event_type") != "error").alias("ok"), F.col("event_id").alias("value"))
    return listing.settle(r)


@query("SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer WHERE c_custkey < 40")
def set_difference(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_nationkey").subtract(table(spark, sf_dir, "customer").filter("c_custkey < 40").select("c_nationkey"))


@query("SELECT key, count(*) AS n FROM (SELECT s_nationkey AS key FROM supplier UNION ALL SELECT c_nationkey FROM customer) GROUP BY 1")
def set_append(spark, sf_dir):
    both = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key")).unionAll(table(spark, sf_dir, "customer").select("c_nationkey"))
    return both.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 42")
def sql_get_bound(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return spark.sql("SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderkey = :id LIMIT 1", args={"id": 42}, orders=orders)


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def sql_attached(spark, sf_dir):
    """A table of the session's own with one of an attached schema, by its qualified name."""
    name = f"attached_{hashlib.md5(sf_dir.encode()).hexdigest()}"
    store.attach(spark, name, {"region": f"{sf_dir}/region.parquet"})
    return spark.sql(f"SELECT n_name, r_name FROM {{nation}} JOIN `{name}`.region ON n_regionkey = r_regionkey", nation=table(spark, sf_dir, "nation"))


@query("SELECT event_type AS pk, event_id AS sk, props AS value FROM events WHERE event_type = 'error'")
def doc_table_created(spark, sf_dir):
    """Rows put into a document table that is made for them, and read back from it."""
    from .streams import work_dir

    name = f"docs_{uuid.uuid4().hex}"
    store.create_table(spark, name, work_dir(spark, "docs"))
    rows = docs(spark, sf_dir).filter("pk = 'error'")
    rows.select(F.col("pk").cast("binary"), F.col("sk").cast("string").cast("binary"), F.col("value").cast("binary")).write.insertInto(name)
    back = spark.table(name).select(F.col("pk").cast("string"), F.col("sk").cast("string").cast("bigint"), F.col("value").cast("string"))
    return back


@query("SELECT 'region' AS name, '{ r_regionkey?: number; r_name?: string }' AS text, 0 AS required UNION ALL SELECT 'embeddings', '{ vec_id?: number; embedding?: number[]; label?: number }', 0")
def schema_typescript(spark, sf_dir):
    """Tables' schemas as TypeScript text, and how many of their fields are required."""
    from ..functions.codecs import split_required, typescript

    rows = [(t, typescript(s), len(split_required(s)[0])) for t in ("region", "embeddings") for s in [table(spark, sf_dir, t).schema]]
    return spark.createDataFrame(rows, "name string, text string, required int")


@query("SELECT count(*) AS hosts, max(event_id) AS last FROM events")
def gauge_report(spark, sf_dir):
    """Gauges of the rows that pass, reported beside what the rows are for."""
    from pyspark.sql import Observation

    from ..streaming import tails

    seen = Observation("events")
    tails.with_gauges(table(spark, sf_dir, "events"), seen, hosts=F.count(F.lit(1)), last=F.max("event_id")).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["hosts"], seen.get["last"])], "hosts bigint, last bigint")


@query("SELECT n_nationkey, n_name AS name FROM nation")
def sql_extension_function(spark, sf_dir):
    from ..functions.codecs import register_test_func

    register_test_func(spark)
    return table(spark, sf_dir, "nation").selectExpr("n_nationkey", "test_func(n_name) AS name")


@query("SELECT p_partkey FROM part WHERE p_size > 20 AND p_brand IN ('Brand#11', 'Brand#12') OR p_name = 'small ring'")
def search_structured(spark, sf_dir):
    return listing.structured(table(spark, sf_dir, "part"), "p_size > 20 AND p_brand IN ('Brand#11', 'Brand#12') OR p_name = 'small ring'").select("p_partkey")


@query("""SELECT c_name AS key, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_custkey END AS value, c_custkey AS old, CASE WHEN c_custkey % 4 = 0 THEN true WHEN c_custkey % 4 = 1 THEN false END AS swapped FROM customer
UNION ALL SELECT 'fresh', 7, NULL, true""")
def kv_compare_and_set(spark, sf_dir):
    base = kv(spark, sf_dir)
    asked = base.filter("value % 4 < 2").select("key", F.when(F.col("value") % 4 == 0, F.col("value")).otherwise(-1).alias("expected"), F.lit(0).cast("bigint").alias("value"))
    fresh = spark.createDataFrame([("fresh", None, 7), ("gone", 1, 8)], "key string, expected bigint, value bigint")
    return store.compare_and_set(base, asked.union(fresh))


@query("""SELECT c_name AS key, CASE WHEN k % 3 = 0 THEN -k WHEN k % 2 = 0 AND k % 10 <> 0 THEN k END AS value, k % 3 = 0 AS hit,
CASE WHEN k % 3 = 0 THEN NULL WHEN k % 2 = 1 THEN 'NotFound' WHEN k % 10 = 0 THEN 'Convert' END AS error FROM (SELECT c_name, c_custkey AS k FROM customer)""")
def kv_read_through(spark, sf_dir):
    base = kv(spark, sf_dir)
    cached = base.filter("value % 3 = 0").withColumn("value", -F.col("value"))
    storage = base.filter("value % 2 = 0").select("key", F.when(F.col("value") % 10 == 0, "x").otherwise(F.col("value").cast("string")).alias("raw"))
    return store.read_through(base.select("key"), cached, storage, lambda raw: raw.try_cast("bigint"))
