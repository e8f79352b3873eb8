"""Mixing sources to target weights by entropy balancing (DataFrame operations only).

Each document gets an expected number of copies r between 0 and 2, as near as
possible to 1 in relative entropy, such that each source's expected words equal
its target.  The dual of that convex problem separates by source; its solution
is an exponential tilt, r = min(2, exp(lambda * size / mean size)).  Newton's
method finds every source's lambda at once: an iteration is one aggregation
over the counts of (source, size).  Rates are then rounded into whole copies.

Defined results: a null text has size 0; a text of any length is one document,
which can't be parted, so a source's taken words may be off by half its largest
document; a null source is a source, and the last; documents of size 0 are kept
once and take no words; repeated rows, which share a key, get equal copies;
equal sizes go by key; reruns agree; an empty table gives an empty result;
further columns pass through ``mix`` and ``repeated`` and are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, is_small, join_small, materialize, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Documents of each source whose rounding takes up what the others' rounding leaves over.
BALANCERS = 64
ITERATIONS = 60
#: Of a source's target, and words, that its expected words may be off.
RELATIVE, ABSOLUTE = 1e-7, 1e-3


def running(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """``rows`` and, as a further column for each of ``sums``, its sum over the rows before in ``order`` (a total one).

    Rows are parted into ranges of the order; a range adds up its own rows, and
    starts from the sums of the ranges before, of which there is a row each.
    """
    ranged = checkpoint(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    by_range = ranged.groupBy("part").agg(*[F.sum(c).alias(f"{name}_in") for name, c in sums.items()])
    lower = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_range.select("part", *[F.coalesce(F.sum(f"{name}_in").over(lower), F.lit(0)).alias(f"{name}_at") for name in sums])
    before = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumns({name: F.coalesce(F.sum(c).over(before), F.lit(0)) for name, c in sums.items()})
    return within.join(F.broadcast(starts), "part").select(*rows.columns, *[(F.col(name) + F.col(f"{name}_at")).alias(name) for name in sums])


def targets(by_source: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, n, target.  by_source has source, source_size, n: one row per source.

    What sources can't take (above ``most`` times their size) is dealt to the
    others by weight again: water-filling, solved by sorting the sources by
    the level at which each is full.  Sums are of whole numbers, so their order
    doesn't matter.
    """
    by_name = F.col("source").asc_nulls_last()
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    w = running(by_source, [by_name], place=F.lit(1)).withColumn("weight", F.element_at(kinds, (F.col("place") % len(weights) + 1).cast("int")))
    w = w.withColumn("cap", most * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    w = running(w, [F.col("full_at").asc(), by_name], caps=F.col("cap"), weights=F.col("weight"))
    size, weight = w.agg(F.sum("source_size"), F.sum("weight")).first()
    # the level is that of the first source, by full_at, which it doesn't fill
    here = (share * F.lit(float(size or 0)) - F.col("caps")) / (F.lit(float(weight or 0)) - F.col("weights"))
    level = w.filter(here <= F.col("full_at")).agg(F.min(F.struct("full_at", here.alias("level")))).first()[0]
    target = F.least(F.col("cap"), F.col("weight") * F.lit(level["level"])) if level else F.col("cap")
    return w.select("source", "source_size", "n", target.alias("target"))


def tilt(lam: Column, size: Column, mean: Column, most: float = MOST) -> Column:
    """The expected copies of a document; the exponent is bounded so that exp() can't overflow."""
    return F.least(F.lit(most), F.exp(F.least(F.lit(50.0), F.greatest(F.lit(-700.0), lam * size / mean))))


def solve(counts: DataFrame, goals: DataFrame, most: float = MOST) -> DataFrame:
    """source, source_size, target, mean, lam.  counts: source, size, n (documents of that size); goals as of targets().

    Newton steps, each kept within a bracket that shrinks (else the bracket is
    halved).  The state has a row per source and is checkpointed in each round.
    """
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    state = goals.select(
        "source", "source_size", "target", F.greatest(F.lit(1e-9), F.col("source_size") / F.greatest(F.col("n"), F.lit(1))).alias("mean"),
        F.when(full, F.lit(1e4)).when(F.col("target") <= 0, F.lit(-1e4)).otherwise(F.lit(0.0)).alias("lam"), F.lit(-1e4).alias("lo"), F.lit(1e4).alias("hi"), (full | (F.col("target") <= 0)).alias("done"),
    )
    state = checkpoint(state)
    send = F.broadcast if is_small(state) else lambda df: df  # the state has the same sources in each round
    for _ in range(ITERATIONS):
        live = state.filter(~F.col("done"))
        h = counts.join(send(live.select(F.col("source").alias("s"), "lam", "mean")), F.col("source").eqNullSafe(F.col("s")))
        r = tilt(F.col("lam"), F.col("size"), F.col("mean"), most)
        words = F.col("n") * F.col("size") * r
        sums = h.groupBy("s").agg(F.sum(words).alias("got"), F.sum(F.when(r < most, words * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"))
        j = state.join(sums, state["source"].eqNullSafe(sums["s"]), "left")
        gap = F.coalesce(F.col("got"), F.col("target")) - F.col("target")
        near = F.abs(gap) <= RELATIVE * F.col("target") + ABSOLUTE
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        j = j.withColumn("lo2", lo).withColumn("hi2", hi).withColumn("newton", F.when(F.col("slope") > 0, F.col("lam") - gap / F.col("slope")))
        inside = (F.col("newton") > F.col("lo2")) & (F.col("newton") < F.col("hi2"))
        lam = F.when(F.col("done") | near, F.col("lam")).when(inside, F.col("newton")).otherwise((F.col("lo2") + F.col("hi2")) / 2)
        narrow = F.col("hi2") - F.col("lo2") < 1e-12
        state = checkpoint(j.select("source", "source_size", "target", "mean", lam.alias("lam"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), (F.col("done") | near | narrow).alias("done")))
        if state.filter(~F.col("done")).isEmpty():
            return state.drop("lo", "hi", "done")
    raise RuntimeError(f"mixing: not solved after {ITERATIONS} steps")


def copies_of(slim: DataFrame, most: float = MOST) -> tuple[DataFrame, DataFrame]:
    """Of (doc_id, source, size): the solved sources, and the balancing documents' copies by document key.

    All other documents round by their own hash.  A source's BALANCERS
    documents of smallest hash, in order of falling words, then diffuse the
    remaining error: each is rounded with what its predecessors left over.
    The ranking keeps BALANCERS rows a source in each map task before it
    shuffles, and the fold runs over as many.
    """
    counts = materialize(slim.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    by_source = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    state = solve(counts.filter("size > 0"), targets(by_source), most)
    keyed = with_key(slim)
    first = F.row_number().over(Window.partitionBy("source").orderBy("mix_key", "size"))
    chosen = materialize(keyed.filter("size > 0").withColumn("rank", first).filter(F.col("rank") <= BALANCERS).select("mix_key").distinct(), "mix-balancers")
    flagged = join_small(keyed, chosen.withColumn("balances", F.lit(True)), "mix_key")
    rated = with_rate(flagged, state, most)
    sums = rated.groupBy("source").agg(F.sum(F.when(F.col("balances").isNull(), own_copies() * F.col("size")).otherwise(0)).alias("bulk"))
    items = rated.filter("balances").groupBy("source", "mix_key").agg(F.sum("size").cast("double").alias("words"), F.first("rate").alias("rate"))
    lists = items.groupBy("source").agg(F.array_sort(F.collect_list(F.struct((-F.col("words")).alias("neg"), "mix_key", "words", "rate"))).alias("items"))
    wanted = lists.join(sums.withColumnRenamed("source", "s1"), F.col("source").eqNullSafe(F.col("s1"))).join(state.select(F.col("source").alias("s2"), "target"), F.col("source").eqNullSafe(F.col("s2")))
    left = F.col("target") - F.col("bulk") - F.aggregate("items", F.lit(0.0), lambda acc, x: acc + x["words"] * x["rate"])
    start = F.struct(left.cast("double").alias("left"), F.expr("cast(array() as array<int>)").alias("copies"))

    def step(s: Column, x: Column) -> Column:
        c = F.least(F.lit(most), F.greatest(F.lit(0.0), F.rint(x["rate"] + s["left"] / x["words"])))
        return F.struct((s["left"] + (x["rate"] - c) * x["words"]).cast("double").alias("left"), F.array_append(s["copies"], c.cast("int")).alias("copies"))

    fold = wanted.select("items", F.aggregate("items", start, step)["copies"].alias("copies")).select(F.explode(F.arrays_zip("items", "copies")).alias("z"))
    return state, materialize(fold.select(F.col("z.items.mix_key").alias("mix_key"), F.col("z.copies").alias("balanced")), "mix-copies")


def with_key(df: DataFrame) -> DataFrame:
    """A document's key; it also is the source of its random number, so reruns agree."""
    return df.withColumn("mix_key", F.xxhash64(F.lit("mix"), "source", "doc_id", "size"))


def own_copies() -> Column:
    """Rounds the rate up with a chance equal to its fraction, by the key's hash."""
    u = F.pmod(F.xxhash64(F.col("mix_key")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(F.col("rate") + u).cast("int")


def with_rate(keyed: DataFrame, state: DataFrame, most: float) -> DataFrame:
    s = state.select(F.col("source").alias("s0"), "source_size", "target", "lam", "mean")
    j = join_small(keyed, s, F.col("source").eqNullSafe(F.col("s0"))).drop("s0")
    return j.withColumn("rate", F.when(F.col("size") > 0, tilt(F.col("lam"), F.col("size"), F.col("mean"), most)).otherwise(1.0))


def mix(docs: DataFrame, most: float = MOST) -> DataFrame:
    """All columns of ``docs`` and, under names of their own, mix_size, mix_source_size, mix_target, mix_rate and mix_copies."""
    return _whole(docs, most).select("row.*", F.col("size").alias("mix_size"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("rate").alias("mix_rate"), F.col("copies").alias("mix_copies"))


def repeated(docs: DataFrame, most: float = MOST) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, in their own columns, whatever their names."""
    taken = _whole(docs, most).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def _whole(docs: DataFrame, most: float) -> DataFrame:
    """Rows as structs with what the mix says of them; the size is counted again, which costs less than a join by row."""
    slim = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-slim")
    state, balanced = copies_of(slim, most)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    return _copied(with_key(whole), state, balanced, most)


def _copied(keyed: DataFrame, state: DataFrame, balanced: DataFrame, most: float) -> DataFrame:
    rated = with_rate(join_small(keyed, balanced, "mix_key"), state, most)
    return rated.withColumn("copies", F.coalesce("balanced", own_copies()))


def mix_report(docs: DataFrame, most: float = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, copies, rate: without the texts, which are read once."""
    slim = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-slim")
    state, balanced = copies_of(slim, most)
    out = _copied(with_key(slim), state, balanced, most)
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "source", "copies", "rate")
