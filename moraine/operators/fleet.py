"""Hosts: liveness by heartbeat, reaping, address sets, capacity, routing and catalogue lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIMEOUT_S = 6


def alive(now: Column, received_at: Column, timeout_s: float = TIMEOUT_S) -> Column:
    """Silent for less than the timeout; at exactly the timeout a host is dead."""
    return F.timestamp_micros(F.unix_micros(now.cast("timestamp"))) < F.timestamp_micros(F.unix_micros(received_at.cast("timestamp")) + F.lit(int(timeout_s * 1_000_000)))


def latest(beats: DataFrame) -> DataFrame:
    """(host, received_at): the last heartbeat of each host."""
    return beats.groupBy("host").agg(F.max("received_at").alias("received_at"))


def counts(status: DataFrame, now: Column, timeout_s: float = TIMEOUT_S) -> DataFrame:
    is_alive = alive(now, F.col("received_at"), timeout_s)
    return status.agg(F.count(F.lit(1)).alias("n_hosts"), F.count_if(is_alive).alias("n_alive"), F.count_if(~is_alive).alias("n_dead"))


def reap(status: DataFrame, connections: DataFrame, now: Column, timeout_s: float = TIMEOUT_S) -> DataFrame:
    """Dead hosts, when they died, and whether a connection of theirs is closed."""
    dead = status.filter(~alive(now, F.col("received_at"), timeout_s))
    return dead.join(connections.select("host", F.lit(True).alias("c")), "host", "left").select("host", "received_at", F.coalesce("c", F.lit(False)).alias("closed"))


def termination_candidates(checks: DataFrame, info: DataFrame, previous: DataFrame, now: Column) -> DataFrame:
    """Silent for over 15 s, made over 60 s ago, not terminating, and not terminated on the tick before."""
    after = lambda c, s: (c.cast("timestamp") + F.expr(f"interval {s} seconds")) < now.cast("timestamp")
    j = checks.join(info, "host").filter(after(F.col("last_check"), 15) & after(F.col("created"), 60) & (F.col("state") != "Terminating"))
    return j.join(previous.select("host").distinct(), "host", "left_anti")


def address_set(hosts: DataFrame) -> DataFrame:
    """Distinct addresses by number, version 4 first."""
    from ..functions.text import ip_key

    return hosts.filter(F.col("ip").isNotNull()).select("ip").distinct().orderBy(ip_key(F.col("ip")))


def capacity(per_gb, memory, per_core, cores) -> Column:
    return F.least(per_gb * memory, per_core * cores)


def workers(hosts: DataFrame) -> DataFrame:
    """Addresses of hosts whose role answered "worker"; hosts without an answer drop out."""
    return hosts.filter(F.col("role").isNotNull() & (F.col("role") == "worker")).select("ip")


def route(path: Column, routes: dict[str, str], missing: str = "404") -> Column:
    """The resource of a path's first part, in the order of ``routes``."""
    part, out = F.get(F.split(path, "/"), F.lit(1)), None
    for name, resource in routes.items():
        out = F.when(part == name, resource) if out is None else out.when(part == name, resource)
    return F.coalesce(out.otherwise(missing), F.lit(missing))


def same_deployment(pairs: DataFrame, deployments: DataFrame) -> DataFrame:
    """pairs (a, b) with ``same``: null if either code is unknown."""
    d = lambda c: deployments.select(F.col("code_id").alias(c), F.col("deployment_id").alias(f"dep_{c}"))
    return pairs.join(d("a"), "a", "left").join(d("b"), "b", "left").select("a", "b", (F.col("dep_a") == F.col("dep_b")).alias("same"))


def kind_lookup(codes: DataFrame, manifests: DataFrame) -> DataFrame:
    """codes with ``kind`` (null if unknown) and the executor it goes to."""
    j = codes.join(manifests.select("code_id", "kind"), "code_id", "left")
    return j.withColumn("executor", F.when(F.col("kind") == "js", "script").when(F.col("kind") == "wasm", "component").otherwise("error"))


def register_code(deployments: DataFrame, manifests: DataFrame, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both maps after codes (code_id, kind) are registered; their deployment is always "default"."""
    from .store import upsert

    return upsert(deployments, codes.select("code_id", F.lit("default").alias("deployment_id")), ["code_id"]), upsert(manifests, codes.select("code_id", "kind"), ["code_id"])
