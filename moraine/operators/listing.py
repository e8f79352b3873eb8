"""Resource listings: filters by contract, sort keys, keyset pages, search, include and exclude filters, counts."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The list requests, the fields that they filter by, and whether they page.
CONTRACTS = {
    "list_allowed_peer_regions_for_remote_peering": ((), False),
    "list_app_catalog_listing_resource_versions": (("listing_id",), True),
    "list_byoip_allocated_ranges": (("byoip_range_id",), True),
    "list_compute_host_groups": (("compartment_id",), True),
    "list_cpe_device_shapes": ((), True),
    "list_cpes": (("compartment_id",), True),
    "list_cross_connect_locations": (("compartment_id",), True),
    "list_cross_connect_mappings": (("virtual_circuit_id",), False),
    "list_crossconnect_port_speed_shapes": (("compartment_id",), True),
    "list_drg_route_rules": (("drg_route_table_id", "route_type"), True),
    "list_drgs": (("compartment_id",), True),
    "list_fast_connect_provider_services": (("compartment_id",), True),
    "list_image_shape_compatibility_entries": (("image_id",), True),
    "list_instance_console_connections": (("compartment_id", "instance_id"), True),
    "list_ip_inventory": (("list_ip_inventory_details",), False),
    "list_ipsec_connection_tunnel_security_associations": (("ipsc_id", "tunnel_id"), True),
    "list_ipsec_connection_tunnels": (("ipsc_id",), True),
    "list_local_peering_gateways": (("compartment_id", "vcn_id"), True),
    "list_remote_peering_connections": (("compartment_id", "drg_id"), True),
    "list_services": ((), True),
    "list_virtual_circuit_associated_tunnels": (("virtual_circuit_id",), True),
    "list_virtual_circuit_bandwidth_shapes": (("compartment_id",), True),
    "list_virtual_circuit_public_prefixes": (("virtual_circuit_id", "verification_state"), False),
    "list_volume_backup_policies": (("compartment_id",), True),
}
SORT_KEYS = {"TIMECREATED": "time_created", "DISPLAYNAME": "display_name", "MODULENAME": "module_name", "NAME": "name"}


def equal_filters(df: DataFrame, **filters) -> DataFrame:
    """Equality on each field; None means no predicate."""
    for name, value in filters.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def enum_filter(c: Column, value: str) -> Column:
    """ALL turns the predicate off."""
    return F.lit(True) if value == "ALL" else c == value


def open_enum(c: Column, known: list[str]) -> Column:
    """Values that aren't known become UNKNOWN instead of failing; null stays."""
    return F.when(c.isNull() | c.isin(*known), c).otherwise("UNKNOWN")


def page(df: DataFrame, key: str, limit: int, token=None, sort_by: str | None = None, order: str = "ASC") -> DataFrame:
    """A page in the order of sort_by and then the unique key, beyond the token (sort value, key) or (key,).

    The cursor is a predicate on the sort columns, so no page costs more than
    another; the order and limit become one bounded top-n.
    """
    by = [sort_by, key] if sort_by else [key]
    if token is not None:
        token = read_token(token) if isinstance(token, str) else token if isinstance(token, (tuple, list)) else (token,)
        beyond = F.lit(False)
        same = F.lit(True)
        for c, v in zip(by, token):
            beyond = beyond | (same & ((F.col(c) > v) if order == "ASC" else (F.col(c) < v)))
            same = same & (F.col(c) == v)
        df = df.filter(beyond)
    return df.orderBy(*[F.asc(c) if order == "ASC" else F.desc(c) for c in by]).limit(limit)


def read_token(token: str) -> tuple:
    """The values in an opaque page token."""
    return tuple(json.loads(base64.b64decode(token)).values())


def with_tokens(df: DataFrame, key: str, limit: int, token=None, sort_by: str | None = None, order: str = "ASC") -> DataFrame:
    """A page with ``place`` (from 1), ``next_token`` (null on the last page) and ``previous_token`` (where this page began; null on the first).

    One row more than the page is looked at, so the window is over limit + 1 rows.
    """
    by = [sort_by, key] if sort_by else [key]
    some = page(df, key, limit + 1, token, sort_by, order)
    rank = Window.orderBy(*[F.asc(c) if order == "ASC" else F.desc(c) for c in by])
    whole = Window.partitionBy(F.lit(1))
    numbered = some.withColumn("place", F.row_number().over(rank))
    opaque = F.base64(F.to_json(F.struct(*by)).cast("binary"))
    last = F.max(F.when(F.col("place") == limit, opaque)).over(whole)
    more = F.max("place").over(whole) > limit
    return numbered.withColumn("next_token", F.when(more, last)).withColumn("previous_token", F.lit(token if isinstance(token, str) else None).cast("string")).filter(F.col("place") <= limit)


def list_request(df: DataFrame, request: str, key: str, limit: int = 100, token=None, sort_by=None, order="ASC", **filters) -> DataFrame:
    """A listing by contract: only the contract's fields may filter, and only paging ones page."""
    fields, pages = CONTRACTS[request]
    if extra := set(filters) - set(fields):
        raise ValueError(f"{request} doesn't filter by {sorted(extra)}")
    found = equal_filters(df, **filters)
    return page(found, key, limit, token, SORT_KEYS.get(sort_by, sort_by), order) if pages else found


def list_response(df: DataFrame, request: str, key: str, limit: int = 100, token: str | None = None, sort_by=None, order="ASC", **filters) -> DataFrame:
    """A listing by contract with the tokens of the pages beside it; requests that don't page give all rows and no token."""
    fields, pages = CONTRACTS[request]
    if not pages:
        none = F.lit(None).cast("string")
        return list_request(df, request, key, **filters).withColumns({"place": F.row_number().over(Window.orderBy(key)), "next_token": none, "previous_token": none})
    if extra := set(filters) - set(fields):
        raise ValueError(f"{request} doesn't filter by {sorted(extra)}")
    return with_tokens(equal_filters(df, **filters), key, limit, token, SORT_KEYS.get(sort_by, sort_by), order)


def structured(df: DataFrame, text: str) -> DataFrame:
    """Rows that a SQL predicate over the columns selects."""
    return df.filter(F.expr(text))


def highlights(cols: dict[str, Column], q: str) -> Column:
    """map field -> fragments that match q in any case, of fields that have some."""
    every = F.create_map(*[x for name, c in cols.items() for x in (F.lit(name), F.regexp_extract_all(c, F.lit(f"(?i){_quoted(q)}"), F.lit(0)))])
    return F.map_filter(every, lambda k, v: F.size(v) > 0)


def _quoted(q: str) -> str:
    return "".join(c if c.isalnum() or c == " " or ord(c) > 127 else "\\" + c for c in q)


#: Patterns up to which filters become one predicate.
MOST_PATTERNS = 1000


def include_exclude(items: DataFrame, filters: DataFrame) -> DataFrame:
    """items (name, version) by filters (kind INCLUDE or EXCLUDE; name, pattern or null, version or null).

    A row stays if some INCLUDE fits and no EXCLUDE does.  Filters by exact
    name are equal-key joins; those by pattern are few and become one predicate.
    """
    rows = [r.asDict() for r in filters.filter(F.col("pattern").isNotNull()).limit(MOST_PATTERNS + 1).collect()]
    if len(rows) > MOST_PATTERNS:
        return _by_pattern_rows(items, filters)
    exact = filters.filter(F.col("name").isNotNull()).select("kind", F.col("name").alias("fname"), F.col("version").alias("fversion"))

    def fits(kind: str) -> Column:
        out = F.lit(False)
        for r in rows:
            if r["kind"] == kind:
                out = out | (F.col("name").rlike(f"^(?:{r['pattern']})$") & (F.lit(True) if r["version"] is None else F.col("version") == r["version"]))
        return out

    def keyed(kind: str) -> DataFrame:
        e = exact.filter(F.col("kind") == kind)
        hit = items.join(e, (F.col("name") == F.col("fname")) & (F.col("fversion").isNull() | (F.col("version") == F.col("fversion"))), "left_semi")
        return hit.select("name", "version").union(items.filter(fits(kind)).select("name", "version")).distinct().toDF("kname", "kversion")

    same = F.col("name").eqNullSafe(F.col("kname")) & F.col("version").eqNullSafe(F.col("kversion"))  # a version may be null
    return items.join(keyed("INCLUDE"), same, "left_semi").join(keyed("EXCLUDE"), same, "left_anti")


def _by_pattern_rows(items: DataFrame, filters: DataFrame) -> DataFrame:
    """The same for any number of patterns: each distinct name meets the filters as rows, which are no longer one predicate."""
    names = items.select("name", "version").distinct()
    f = filters.select("kind", F.col("name").alias("fname"), "pattern", F.col("version").alias("fversion"))
    fits = F.coalesce(F.col("name") == F.col("fname"), F.lit(False)) | F.coalesce(F.expr("name rlike concat('^(?:', pattern, ')$')"), F.lit(False))
    hit = names.join(f, fits & (F.col("fversion").isNull() | (F.col("version") == F.col("fversion"))))
    judged = hit.groupBy("name", "version").agg(F.bool_or(F.col("kind") == "INCLUDE").alias("i"), F.bool_or(F.col("kind") == "EXCLUDE").alias("e"))
    kept = judged.filter("i and not e").select(F.col("name").alias("kname"), F.col("version").alias("kversion"))
    return items.join(kept, F.col("name").eqNullSafe(F.col("kname")) & F.col("version").eqNullSafe(F.col("kversion")), "left_semi")


def in_range(c: Column, low, high) -> Column:
    return c.between(low, high)


def metric_counts(df: DataFrame, dims: list[str], metrics: dict[str, Column]) -> DataFrame:
    """(name, dimensions, count) for each metric and combination of dimensions, from one aggregation."""
    wide = df.groupBy(*dims).agg(*[F.count_if(c).alias(n) for n, c in metrics.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("count")) for n in metrics])
    return wide.select(F.explode(pairs).alias("m"), *dims).select("m.name", *dims, "m.count")


def first_seen(df: DataFrame, fingerprint: str, at: str) -> DataFrame:
    return df.groupBy(fingerprint).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first_seen"))


def group_lists(df: DataFrame, key: str, pos: str, item: str) -> DataFrame:
    """(key, items): lists in order of position; a list is one value, so it is made by one task and has to fit into it."""
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, item))), lambda x: x[item]).alias("items"))


def settle(results: DataFrame) -> DataFrame:
    """Of (batch, finished_at, ok, value): all (null unless all are ok), race, any, and statuses in order."""
    ordered = F.array_sort(F.collect_list(F.struct("finished_at", F.when(F.col("ok"), "fulfilled").otherwise("rejected").alias("status"))))
    return results.groupBy("batch").agg(
        F.every("ok").alias("all_ok"), F.min_by("value", "finished_at").alias("race"), F.min_by(F.when(F.col("ok"), F.col("value")), F.when(F.col("ok"), F.col("finished_at"))).alias("any_ok"),
        F.transform(ordered, lambda x: x["status"]).alias("statuses"),
    )
