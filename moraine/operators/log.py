"""Append-only log (seq, value): slices, ends, gaps and delivery of what hosts lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Numbers that one task orders at most when looking for gaps.
GAP_SPAN = 1_000_000
#: Numbers of a span of the range join that finds what hosts lack.
DELTA_SPAN = 100_000


def slice_after(log: DataFrame, n: int) -> DataFrame:
    """Rows beyond the first n in order of seq; n over the count is an error.

    Row numbers come from seq if its values are distinct and dense; else, as
    where one is repeated, by an ordered offset.  The count is needed at once,
    for the error.
    """
    count, distinct, low, high = log.agg(F.count(F.lit(1)), F.count_distinct("seq"), F.min("seq"), F.max("seq")).first()
    if n > count:
        raise ValueError(f"the log has {count} rows, not {n}")
    if count and distinct == count and high - low + 1 == count:
        return log.filter(F.col("seq") >= low + n).orderBy("seq")
    return log.orderBy("seq").offset(n)


def ends(log: DataFrame) -> DataFrame:
    """last_seq (the cursor), n_rows, and whether the count would do as a cursor."""
    return log.agg(F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("n_rows")).withColumn("is_dense", F.coalesce(F.col("last_seq") == F.col("n_rows"), F.lit(True)))


def gaps(log: DataFrame, span: int = GAP_SPAN) -> DataFrame:
    """(after, missing): where seq jumps.

    Numbers are ordered within spans of ``span``, so no task orders the whole
    log; what follows a span's last number comes from a row for each span.
    """
    own = Window.partitionBy("part").orderBy("seq")
    parts = log.select("seq", F.floor(F.col("seq") / span).alias("part")).filter(F.col("seq").isNotNull())
    firsts = parts.groupBy("part").agg(F.min("seq").alias("first")).select("part", F.lead("first").over(Window.orderBy("part")).alias("later"))
    nexts = parts.withColumn("next", F.lead("seq").over(own)).filter(F.col("next").isNull() | (F.col("next") > F.col("seq") + 1))
    inside = nexts.filter(F.col("next").isNotNull()).select("seq", "next")
    between = nexts.filter(F.col("next").isNull()).join(firsts, "part").select("seq", F.col("later").alias("next")).filter(F.col("next") > F.col("seq") + 1)
    return inside.union(between).select(F.col("seq").alias("after"), (F.col("next") - F.col("seq") - 1).alias("missing"))


def delta_rows(hosts: DataFrame, log: DataFrame, span: int = DELTA_SPAN) -> DataFrame:
    """(host, seq, value): a row for each log entry after the host's deployment_id; no row is as long as what a host lacks.

    A range join by spans of the log: a host has a row for each span that it
    lacks some of, spans are equal keys, and within them seq is compared.
    """
    part = lambda c: F.floor(c / span)
    ends = log.agg(F.max("seq").alias("last_seq"), F.min("seq").alias("first_seq"))  # one row
    lacking = hosts.crossJoin(F.broadcast(ends)).filter(F.col("deployment_id") < F.col("last_seq"))
    begin = F.greatest(F.col("deployment_id") + 1, F.col("first_seq"))
    spans = lacking.select("host", "deployment_id", F.explode(F.sequence(part(begin), part(F.col("last_seq")))).alias("part"))
    return spans.join(log.select("seq", "value", part(F.col("seq")).alias("part")), "part").filter(F.col("seq") > F.col("deployment_id")).select("host", "seq", "value")


def deltas(hosts: DataFrame, log: DataFrame, span: int = DELTA_SPAN) -> DataFrame:
    """(host, updates): log values after the host's deployment_id, in order, as one message to each host; see ``delta_rows`` for long ones."""
    got = delta_rows(hosts, log, span).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("seq", "value"))).alias("u"))
    return hosts.select("host").join(got, "host", "left").select("host", F.coalesce(F.transform("u", lambda x: x["value"]), F.expr("cast(array() as array<bigint>)")).alias("updates"))


def advertise(hosts: DataFrame, log: DataFrame) -> DataFrame:
    """The last id for every host."""
    return hosts.select("host").crossJoin(F.broadcast(log.agg(F.max("seq").alias("latest_id"))))
