"""Mixing sources to target weights by hash thresholds, in DataFrame operations only.

Each source has a budget of words. A document's hash says where it stands in its source; the mix
takes every document ``floor(target / size)`` times, and once more the documents whose hash is below
the source's threshold. The threshold is found without sorting: words are added up per source and
hash bucket, the bucket in which the rest of the budget ends is found, and only that bucket is
divided further, ``BITS`` bits at a time, until the hash is used up.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; rows with
the same id (or a null id) stand together, taken or not; a source without words has target 0; an
empty table gives an empty result. A threshold group is taken when that brings the source nearer to
its target, so a source misses it by half of one document at most, as no document is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratingloom.llm.common import WORD, hash48, small, unused
from ratingloom.session import materialize

HASH_BITS = 48
#: Bits of the hash that one level of the search uses: 4,096 buckets, four levels.
BITS = 12
#: No source is taken more often than this.
MOST_COPIES = 3


def size_of(text: Column) -> Column:
    """Words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD + "+")), F.lit(0)).cast("bigint")


def weighted(sizes: DataFrame, cycle: int) -> DataFrame:
    """Add ``weight`` to ``(source, source_size)``: 1, 2, .. ``cycle``, repeating, by the order of names.

    Names are dealt to ranges; a name's number is its place in its range and the names of the ranges
    before it, of which there is one row per shuffle partition.
    """
    order = F.col("source").asc_nulls_last()
    ranged = (
        materialize(sizes, "mix-sizes").repartitionByRange(order)
        .withColumn("part", F.spark_partition_id()).sortWithinPartitions(order)
        .withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    ranged = materialize(ranged, "mix-names")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    number = F.col("first") + F.col("place")
    return ranged.join(F.broadcast(starts), "part").select(
        "source", "source_size", (number % cycle + 1).alias("weight")
    )


def targets(sizes: DataFrame, cycle: int = 3, most: int = MOST_COPIES) -> DataFrame:
    """Add ``target`` to ``(source, source_size)``: shares by weight, at most ``most`` times the size.

    Sources in code-point order, null last, weigh 1, 2, .. ``cycle``, repeating. What a source cannot
    take goes to the others by weight: the level is what the open sources share per unit of weight, and
    a source whose limit is not above its part of it stops there. Stopping raises the level, so passes
    of one aggregate each go on until no more source stops. A pass stops most of the open sources or
    raises the level by less than the pass before it, so there are few.
    """
    ranked = materialize(weighted(sizes, cycle), "mix-weights")
    whole = ranked.agg(
        F.sum("source_size").alias("size"), F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n")
    ).first()
    limit = most * F.col("source_size")
    still, level = whole.n, whole.size / whole.weight if whole.n else 0.0
    while still:
        is_open = limit > F.col("weight") * F.lit(level)
        now = ranked.agg(
            F.count(F.when(is_open, 1)).alias("n"), F.sum(F.when(is_open, F.col("weight"))).alias("weight"),
            F.coalesce(F.sum(F.when(~is_open, limit)), F.lit(0)).alias("stopped"),
        ).first()
        if now.n in (0, still):
            break
        still, level = now.n, (whole.size - now.stopped) / now.weight
    target = F.least(F.col("weight") * F.lit(level), limit.cast("double"))
    return ranked.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Add ``copies``, ``upto`` and ``last`` to the plan of ``(source, source_size, target)``.

    A document is taken once more if its hash is below ``upto``, or equal to it and ``last`` holds.
    """
    copies = F.coalesce(F.floor(F.try_divide("target", F.col("source_size"))), F.lit(0)).cast("bigint")
    state = plan.withColumn("copies", copies).withColumns({
        "rest": F.col("target") - F.col("copies") * F.col("source_size"),
        "prefix": F.lit(0).cast("bigint"), "done": F.lit(0).cast("bigint"),
    })
    for bits in range(BITS, HASH_BITS + 1, BITS):
        shift = HASH_BITS - bits
        inside = F.shiftright("h", shift + BITS) == F.col("prefix")
        at_level = rows.withColumnRenamed("source", "name").join(
            small(state).select("source", "prefix"), F.expr("name <=> source") & inside
        )
        sums = at_level.groupBy("name", F.shiftright("h", shift).alias("bucket")).agg(
            F.sum("size").alias("words")
        )
        upto = Window.partitionBy("name").orderBy("bucket").rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        sums = sums.withColumn("through", F.sum("words").over(upto))
        found = (
            sums.join(state.drop("words"), F.expr("name <=> source"))
            .where(F.col("done") + F.col("through") > F.col("rest"))
            .groupBy("name")
            .agg(F.min(F.struct("bucket", "through", "words")).alias("f"))
        )
        # Without a crossing the rest takes all that is left: the bucket after the last one.
        state = materialize(
            state.join(found, F.expr("name <=> source"), "left")
            .select(
                "source", "source_size", "target", "copies", "rest",
                F.coalesce("f.bucket", (F.col("prefix") + 1) * (1 << BITS)).alias("prefix"),
                (F.col("done") + F.coalesce(F.col("f.through") - F.col("f.words"), F.lit(0))).alias("done"),
                F.coalesce("f.words", F.lit(0)).alias("words"),
            ),
            "mix-level",
        )
    near = (F.col("rest") > F.col("done")) & (
        F.col("done") + F.col("words") - F.col("rest") < F.col("rest") - F.col("done")
    )
    return state.select(
        "source", "source_size", "target", "copies", near.alias("last"),
        F.when(F.col("rest") > 0, F.col("prefix")).otherwise(0).alias("upto"),
    )


def plan_mix(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The narrow table ``(doc_id, source, size, h)`` and the plan with one row per source."""
    rows = materialize(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
            size_of(F.col("text")).alias("size"), hash48(F.col("doc_id")).alias("h"),
        ),
        "mix-rows",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = materialize(targets(sizes), "mix-targets")
    return rows, small(thresholds(rows, plan))


def copies_of(h: Column) -> Column:
    """How often a document with hash ``h`` is taken, given its source's plan in the same row."""
    once = (h < F.col("upto")) | ((h == F.col("upto")) & F.col("last"))
    return F.col("copies") + once.cast("bigint")


def mix(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``, one row per input row."""
    rows, plan = plan_mix(docs)
    joined = rows.join(plan, rows["source"].eqNullSafe(plan["source"]))
    return joined.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies_of(F.col("h"))).alias("taken")
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns."""
    _, plan = plan_mix(docs)
    own = unused(docs, "mix")
    mine = docs.join(
        plan.select(F.struct(*plan.columns).alias(own)),
        docs["source"].cast("string").eqNullSafe(F.col(f"{own}.source")),
    )
    h = hash48(docs["doc_id"])
    once = (h < F.col(f"{own}.upto")) | ((h == F.col(f"{own}.upto")) & F.col(f"{own}.last"))
    times = (F.col(f"{own}.copies") + once.cast("bigint")).cast("int")
    return mine.withColumn(own, F.explode(F.array_repeat(F.lit(0), times))).drop(own)
