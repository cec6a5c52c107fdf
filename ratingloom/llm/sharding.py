"""Sharding by a hierarchical weighted hash tree: region, then rack, then shard.

At every level a document draws a number from its id and the child's name, ``-ln(u) / weight``, and
goes to the child with the smallest one. A child's draw depends on nothing but itself, so when a
weight changes, documents move only into or out of that child: movement stays inside the subtrees
whose weights change. A shard that joins as a region of its own takes documents only into itself.

The law kept is ``key``: the id and the tree decide; sizes and counts are equal in expectation only.

Defined cases: a null text has no bytes; null ids draw like the empty id and so share a shard;
repeated rows get one slot each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratingloom.llm.common import hash48, small
from ratingloom.session import materialize

#: Bytes that a row counts besides its text.
ROW_BYTES = 16
#: Rows of a shard that are numbered together, on average.
SLOT_ROWS = 50_000
SPACE = float(1 << 48)


@dataclass(frozen=True)
class Shard:
    number: int
    weight: float = 1.0


@dataclass(frozen=True)
class Node:
    """A rack (children are shards) or a region (children are racks)."""

    name: str
    children: tuple

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children)


def tree(shards: int = 40, per_rack: int = 5, racks: int = 4) -> tuple[Node, ...]:
    """Regions of ``racks`` racks of ``per_rack`` shards; the last of each may be smaller."""
    leaves = [Shard(i) for i in range(shards)]
    rows = [tuple(leaves[i : i + per_rack]) for i in range(0, shards, per_rack)]
    shelves = [Node(f"rack{i}", row) for i, row in enumerate(rows)]
    return tuple(
        Node(f"region{i}", tuple(shelves[i * racks : (i + 1) * racks]))
        for i in range(-(-len(shelves) // racks))
    )


def grow(regions: tuple[Node, ...], weight: float = 1.0) -> tuple[Node, ...]:
    """The tree with one more shard, alone in a rack of a new region."""
    number = 1 + max(s.number for g in regions for r in g.children for s in r.children)
    rack = Node(f"rack-of-{number}", (Shard(number, weight),))
    return (*regions, Node(f"region-of-{number}", (rack,)))


def _draw(key: Column, name: str, weight: float) -> Column:
    """The draw of a child: exponential with the weight as its rate."""
    u = (hash48(F.concat_ws("/", key, F.lit(name))) + 0.5) / SPACE
    return -F.ln(u) / F.lit(float(weight))


def _winner(key: Column, names: list[tuple[str, float, Column]]) -> Column:
    """The value of the child that draws least; ties go to the first."""
    if len(names) == 1:
        return names[0][2]
    draws = [
        F.struct(_draw(key, name, weight).alias("draw"), F.lit(i).alias("at"), value.alias("value"))
        for i, (name, weight, value) in enumerate(names)
    ]
    return F.least(*draws)["value"]


def descend(docs: DataFrame, regions: tuple[Node, ...], out: str, key: str = "doc_id") -> DataFrame:
    """Add the shard of each row: one draw per region, per rack of it, and per shard of that."""
    id_text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    region = _winner(id_text, [(g.name, g.weight, F.lit(i)) for i, g in enumerate(regions)])

    def choose(at: str, options: list[Column]) -> Column:
        chosen = options[-1]
        for i in range(len(options) - 2, -1, -1):
            chosen = F.when(F.col(at) == i, options[i]).otherwise(chosen)
        return chosen

    racks = [r for g in regions for r in g.children]
    number = {id(r): i for i, r in enumerate(racks)}
    rack = choose("_region", [
        _winner(id_text, [(r.name, r.weight, F.lit(number[id(r)])) for r in g.children]) for g in regions
    ])
    shard = choose("_rack", [
        _winner(id_text, [(f"shard{s.number}", s.weight, F.lit(s.number)) for s in r.children])
        for r in racks
    ])
    return (
        docs.withColumn("_region", region).withColumn("_rack", rack).withColumn(out, shard)
        .drop("_region", "_rack")
    )


def slots(rows: DataFrame, total: int, shards: int) -> DataFrame:
    """Add ``slot``, a gapless number from 0 inside each shard, in the order of the id's hash.

    Equal rows are counted as one, in pieces of ``SLOT_ROWS`` at most. Each shard is cut into ranges of
    the hash, and a range that holds more than its share, as one id may be very frequent, is dealt over
    several parts by the other values and the piece. Pieces are numbered inside their part, the counts
    of the parts before it (one small row each) are added, and pieces become rows again at the end: no
    task holds a shard, an id or a group of equal rows.
    """
    parts = max(1, total // (SLOT_ROWS * shards))
    pieces = (
        rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_all"))
        .withColumn("_piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("_all") - 1) / SLOT_ROWS))))
        .withColumn("_n", F.least(F.lit(SLOT_ROWS), F.col("_all") - F.col("_piece") * SLOT_ROWS))
        .withColumn("_range", F.floor(F.col("h") * F.lit(parts) / F.lit(SPACE)).cast("int"))
        .drop("_all")
    )
    pieces = materialize(pieces, "slot-pieces")
    ranges = pieces.groupBy("shard", "_range").agg(F.sum("_n").alias("n"))
    ranges = materialize(
        ranges.select("shard", "_range", F.ceil(F.col("n") / (4 * SLOT_ROWS)).alias("_parts")), "slot-ranges"
    )
    dealt = F.pmod(F.xxhash64("doc_id", "size", "text_crc32", "_piece"), "_parts")
    cut = pieces.join(small(ranges), ["shard", "_range"]).withColumn("_part", dealt).drop("_parts")
    part = ["shard", "_range", "_part"]
    counts = cut.groupBy(*part).agg(F.sum("_n").alias("n"))
    before = Window.partitionBy("shard").orderBy("_range", "_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = materialize(
        counts.select(*part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first")), "slot-starts"
    )
    inside = Window.partitionBy(*part).orderBy("h", "doc_id", "size", "text_crc32", "_piece").rowsBetween(
        Window.unboundedPreceding, -1
    )
    numbered = cut.withColumn("_at", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(small(starts), part)
    return numbered.withColumn("_row", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1))).select(
        *rows.columns, (F.col("_first") + F.col("_at") + F.col("_row")).cast("bigint").alias("slot")
    )


def place(docs: DataFrame, shards: int = 40) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``, one row per input row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"), hash48(F.col("doc_id")).alias("h"),
    )
    regions = tree(shards)
    placed = descend(descend(rows, regions, "shard"), grow(regions), "grown_shard")
    placed = materialize(placed, "placed")
    return slots(placed, placed.count(), shards).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
