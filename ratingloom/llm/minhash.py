"""Near-duplicates by MinHash with tensored banding, confirmed on the full shingle sets.

A document's set holds its distinct windows of five lower-cased words. Two small collections of
``GROUPS`` groups of ``ROWS`` minhashes are drawn, and the key of table ``(i, j)`` joins group ``i`` of
the first with group ``j`` of the second: ``GROUPS * GROUPS`` tables of ``2 * ROWS`` minhashes from
``2 * GROUPS * ROWS`` of them, where separate tables would take ``2 * GROUPS * GROUPS * ROWS``. A pair
of similarity J meets in no table with probability ``1 - (1 - (1 - J**ROWS)**GROUPS)**2``, which is
0.00025 at J = 0.85 and falls fast above. Thresholds under 0.85 take more groups, so that a pair at the
threshold is missed with probability ``MISSED`` at most: 10 at J = 0.8, where it is 0.00007.

Documents with equal sets are one class from the start. Classes that meet in a table are connected to
groups of candidates, which shared boilerplate can chain together. So candidates are thinned before
any text moves: ``CHECKS`` further minhashes of a byte each estimate the similarity of all pairs of a group,
in tiles of sketches, and only pairs that reach ``least_agreeing`` of them, and whose set sizes allow the
threshold, connect the groups that go on. A pair at the threshold fails this with probability
``MISSED_CHECK`` at most. Links are then confirmed on the full sets, word by word. First every class of a group
is compared with the group's hub, the class with the most estimated links, for which each text is sent
once. Classes that the hub does not link, the *rest*, are compared with all classes of the group in
tiles of bounded size; in a group of near copies there are few. No list of pairs ever leaves a task: a
tile returns one row per linked class at most. A text is sent ``1 + blocks`` times at most, with
one block for each ``BLOCK_DOCS`` classes (or ``BLOCK_BYTES``) of the rest, or of the group for classes of the rest.

Defined cases: a text that is null or has no words has an empty set and links with nothing; fewer than
five words form one shingle; in :func:`groups` rows without an id link with nothing and rows that repeat
an id are one document, while :func:`keep` judges every row by its text; an empty table gives an empty
result; other columns are ignored by :func:`groups` and kept by :func:`keep`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.llm.common import (
    components, map_texts, ship, small, small_batches, table_of, texts, unused,
)
from ratingloom.session import materialize

ship(__name__)

WIDTH = 5
PERCENT = 85
GROUPS, ROWS = 7, 2
HASHES = 2 * GROUPS * ROWS
#: Under ``PERCENT``, a pair at the threshold meets in no table with this probability at most.
MISSED = 0.0001
#: A tile compares two blocks of at most about this many documents and bytes of text.
BLOCK_DOCS, BLOCK_BYTES = 256, 4 << 20
#: Minhashes that estimate the similarity of candidates, and the classes in a block of such sketches.
CHECKS, BLOCK_CHECKS = 128, 1024
#: A pair at the threshold is dropped by its estimate with this probability at most.
MISSED_CHECK = 0.00001
#: Shingles that more documents than this share are counted by a matrix product.
LIGHT = 8

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def groups_for(percent: int) -> int:
    """Groups of a collection: ``GROUPS``, or more for thresholds under ``PERCENT``."""
    if percent >= PERCENT:
        return GROUPS
    apart = 1 - math.sqrt(1 - MISSED)  # no group of one collection agrees
    return max(GROUPS, math.ceil(math.log(apart) / math.log(1 - (percent / 100) ** ROWS)))


def parameters(hashes: int = HASHES) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of the minhashes."""
    numbers = mix(np.arange(1, 2 * hashes + 1, dtype=np.uint64) * _PRIME)
    return numbers[:hashes] | np.uint64(1), numbers[hashes:]


def shingle_hashes(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the windows of a text's words."""
    from xxhash import xxh3_64_intdigest

    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    width = min(width, n)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = mix(out * _PRIME + each[k : k + len(out)])
    return np.unique(out)


def minhashes(hashes: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """The minima of each hash function over a set, as 32-bit numbers."""
    least = np.full(len(a), 0xFFFFFFFF, np.uint64)
    for at in range(0, len(hashes), step):
        values = (hashes[None, at : at + step] * a[:, None] + b[:, None]) >> np.uint64(32)
        least = np.minimum(least, values.min(axis=1))
    return least.astype(np.uint32)


def least_agreeing(percent: int, checks: int = CHECKS) -> int:
    """How many of the check hashes two sets at the threshold share, but for ``MISSED_CHECK`` of them."""
    p, below = percent / 100, 0.0
    for n in range(checks + 1):
        below += math.comb(checks, n) * p**n * (1 - p) ** (checks - n)
        if below > MISSED_CHECK:
            return n
    return checks


SKETCH = "doc_id bigint, n_shingles bigint, print binary, sketch binary, checks binary"


def sketches(docs: DataFrame, width: int = GROUPS) -> DataFrame:
    """One row per document: set size, a 128-bit print of the set, its minhashes and check bytes.

    ``width`` is the number of groups in a collection.
    """
    from_docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string"))
    n = 2 * width * ROWS

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        from xxhash import xxh3_128_digest

        a, b = parameters(n + CHECKS)
        sizes, prints, found, checks = [], [], [], []
        for text in texts(part.column("text")):
            hashes = shingle_hashes(text.lower().split())
            some = len(hashes) > 0
            least = minhashes(hashes, a, b) if some else None
            sizes.append(len(hashes))
            prints.append(xxh3_128_digest(hashes.tobytes()) if some else None)
            found.append(least[:n].tobytes() if some else None)
            checks.append(mix(least[n:].astype(np.uint64) * _PRIME).astype(np.uint8).tobytes() if some else None)
        return table_of(
            SKETCH, doc_id=part.column("doc_id"), n_shingles=pa.array(sizes, pa.int64()),
            print=pa.array(prints, pa.binary()), sketch=pa.array(found, pa.binary()),
            checks=pa.array(checks, pa.binary()),
        )

    return map_texts(from_docs, work, SKETCH)


def table_keys(classes: DataFrame, width: int = GROUPS) -> DataFrame:
    """``(key, rep)``: the keys of all tables for each class."""
    schema = "key bigint, rep bigint"
    tables = width * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            joined = b"".join(batch.column("sketch").to_pylist())
            values = np.frombuffer(joined, np.uint32).reshape(n, 2, width, ROWS).astype(np.uint64)
            group = values[..., 0]
            for k in range(1, ROWS):
                group = mix(group * _PRIME + values[..., k])
            first, second = group[:, 0, :, None], group[:, 1, None, :]
            table = np.arange(tables, dtype=np.uint64).reshape(1, width, width)
            keys = mix(mix(first * _PRIME + table) * _PRIME + second).reshape(-1)
            rep = np.repeat(batch.column("rep").to_numpy(), tables)
            yield table_of(schema, key=keys.view(np.int64), rep=rep)

    return classes.select("sketch", "rep").mapInArrow(run, schema)


def candidates(classes: DataFrame, width: int = GROUPS) -> DataFrame:
    """``(node, component)``: groups of classes that meet in some table, directly or over others."""
    keys = table_keys(classes, width)
    buckets = keys.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("last"))
    buckets = materialize(buckets.where("leader < last").select("key", "leader"), "buckets")
    star = keys.join(small(buckets), "key").where("rep <> leader")
    return components(star.select(F.col("rep").alias("a"), F.col("leader").alias("b")), "candidates")


def in_tiles(members: DataFrame, block_rows: int, block_bytes: int | None = None) -> DataFrame:
    """Deal the rows of each component to blocks, and each row to the tiles of its block with every other.

    Adds ``block``, ``low`` and ``high``; ``members`` is a written table with ``node`` and ``component``.
    """
    sums = [F.count(F.lit(1)).alias("n"), *([F.sum("bytes").alias("bytes")] if block_bytes else [])]
    groups = members.groupBy("component").agg(*sums)
    size = f"ceil(n / {block_rows})" + (f", ceil(bytes / {block_bytes})" if block_bytes else "")
    blocks = groups.select("component", F.expr(f"cast(greatest({size}, 1) AS int)").alias("blocks"))
    blocks = materialize(blocks.where("blocks > 1"), "blocks")
    spread = members.join(small(blocks), "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    spread = spread.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    tiles = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return tiles.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other", "blocks")


def likely(ids: np.ndarray, block: np.ndarray, sizes: np.ndarray, checks: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of a tile the sketches leave over: a symmetric matrix."""
    n, least = len(ids), least_agreeing(percent)
    out = np.zeros((n, n), bool)
    step = max(1, (1 << 23) // (n * checks.shape[1]))
    for at in range(0, n, step):
        part = checks[at : at + step]
        agree = (part[:, None, :] == checks[None, :, :]).sum(axis=2) >= least
        small_size = np.minimum(sizes[at : at + step, None], sizes[None, :])
        agree &= 100 * small_size >= percent * np.maximum(sizes[at : at + step, None], sizes[None, :])
        out[at : at + step] = agree
    np.fill_diagonal(out, False)
    return out & (block[:, None] != block[None, :]) if block.min() != block.max() else out


def thin(classes: DataFrame, members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(node, component, hub)``: groups connected by pairs that the sketches find likely to be links.

    ``hub`` is the class of the group with the most likely links.
    """
    rows = members.join(
        classes.select(F.col("rep").alias("node"), "n_shingles", "checks"), "node"
    )
    tiles = in_tiles(materialize(rows, "members"), BLOCK_CHECKS)
    keys = ["component", "low", "high"]
    schema = "a bigint, b bigint, degree bigint"

    def run(batches):
        for group in runs(batches, keys):
            if group.num_rows == 1:
                continue
            ids, block, sizes = (group.column(c).to_numpy() for c in ("node", "block", "n_shingles"))
            order = np.argsort(ids)
            ids, block, sizes = ids[order], block[order], sizes[order]
            joined = b"".join(group.column("checks").to_pylist())
            checks = np.frombuffer(joined, np.uint8).reshape(len(ids), -1)[order]
            linked = likely(ids, block, sizes, checks, percent)
            degree = linked.sum(axis=1)
            kept = np.flatnonzero(degree)
            if len(kept):
                label = smallest_labels(linked)
                yield table_of(schema, a=ids[kept], b=ids[label[kept]], degree=degree[kept].astype(np.int64))

    dealt = tiles.select("node", "n_shingles", "checks", "block", *keys)
    found = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
    found = materialize(found, "likely")
    groups = materialize(components(found.select("a", "b"), "likely"), "groups")
    degrees = found.groupBy(F.col("a").alias("node")).agg(F.sum("degree").alias("degree"))
    best = groups.join(degrees, "node").groupBy("component").agg(
        F.max(F.struct("degree", (-F.col("node")).alias("node")))["node"].alias("hub")
    )
    best = materialize(best.select("component", (-F.col("hub")).alias("hub")), "hubs")
    return groups.join(small(best), "component")


def exact_shingles(words: list[list[bytes]], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """``(document, shingle)`` of all distinct shingles, numbered exactly, without hashes."""
    number: dict[bytes, int] = {}
    lengths = np.array([len(w) for w in words])
    ids = np.fromiter(
        (number.setdefault(w, len(number) + 1) for ws in words for w in ws), np.int64, lengths.sum()
    )
    doc = np.repeat(np.arange(len(words)), lengths)
    # Behind a text's last word stand zeros, so a short text is one window that ends in zeros.
    place = np.arange(len(ids)) + width * doc
    padded = np.zeros(len(ids) + width * len(words), np.int64)
    padded[place] = ids
    inside = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    begins = inside < np.repeat(np.maximum(lengths - width + 1, 1), lengths)
    windows = place[begins]
    rank = padded[windows]
    for k in range(1, width):
        rank = np.unique(rank * (len(number) + 1) + padded[windows + k], return_inverse=True)[1]
    most = int(rank.max(initial=0)) + 1
    pairs = np.unique(doc[begins] * most + rank)
    return pairs // most, pairs % most


def shared(doc: np.ndarray, shingle: np.ndarray, n: int) -> np.ndarray:
    """Intersection sizes of all pairs of ``n`` documents, as an ``n`` by ``n`` matrix."""
    order = np.lexsort((doc, shingle))
    doc, shingle = doc[order], shingle[order]
    _, at, count = np.unique(shingle, return_index=True, return_counts=True)
    light = np.zeros((n, n), np.float32)
    for k in range(2, LIGHT + 1):
        rows = doc[at[count == k][:, None] + np.arange(k)]
        for i in range(k):
            for j in range(i + 1, k):
                np.add.at(light, (rows[:, i], rows[:, j]), 1)
    both = light + light.T
    heavy = np.flatnonzero(count > LIGHT)
    step = 2048
    for i in range(0, len(heavy), step):
        chosen = heavy[i : i + step]
        members = np.concatenate([np.arange(at[c], at[c] + count[c]) for c in chosen])
        dense = np.zeros((n, len(chosen)), np.float32)
        dense[doc[members], np.repeat(np.arange(len(chosen)), count[chosen])] = 1
        both += dense @ dense.T
    return both


def smallest_labels(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix the smallest index of its component."""
    n = len(linked)
    linked = linked | np.eye(n, dtype=bool)
    label = np.arange(n)
    while True:
        least = np.where(linked, label[None, :], n).min(axis=1)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def link_tile(ids: np.ndarray, block: np.ndarray, documents: list[bytes], percent: int) -> np.ndarray:
    """Linked classes of a tile as rows ``(class, smaller class of its component)``.

    A tile of one block compares all its pairs; a tile of two compares those across the blocks.
    """
    order = np.argsort(ids, kind="stable")
    ids, block = ids[order], block[order]
    doc, shingle = exact_shingles([documents[i].lower().split() for i in order])
    n = len(ids)
    sizes = np.bincount(doc, minlength=n)
    both = shared(doc, shingle, n)
    union = sizes[:, None] + sizes[None, :] - both
    linked = (100 * both >= percent * union) & (union > 0)
    if block.min() != block.max():
        linked &= block[:, None] != block[None, :]
    label = smallest_labels(linked)
    moved = np.flatnonzero(label != np.arange(n))
    return np.stack([ids[moved], ids[label[moved]]], axis=1)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows with equal keys, from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        bounds = [0, *starts, batch.num_rows]
        for a, b in zip(bounds, bounds[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def link_hub(documents: list[bytes], hub: bytes, percent: int) -> np.ndarray:
    """Which of the documents are linked with the hub."""
    doc, shingle = exact_shingles([d.lower().split() for d in [hub, *documents]])
    mine = np.zeros(int(shingle.max(initial=-1)) + 1, bool)
    mine[shingle[doc == 0]] = True
    sizes = np.bincount(doc, minlength=len(documents) + 1)
    both = np.bincount(doc[mine[shingle]], minlength=len(documents) + 1)
    return (100 * both >= percent * (sizes + sizes[0] - both))[1:]


LINKS = "a bigint, b bigint"


def confirm(docs: DataFrame, members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(a, b)``: links that hold on the full sets, inside the groups of ``members``.

    The texts of the members are written once. Every class goes once to a part of its group, to
    which the hub's text is copied; classes of the rest go on to tiles with all others.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("node"), F.col("text").cast("string"))
    held = materialize(
        rows.join(small(members), "node").withColumn("bytes", F.octet_length("text").cast("bigint")),
        "members",
    )
    sums = held.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    parts = sums.select("component", F.expr(
        f"cast(greatest(ceil(n / {BLOCK_DOCS}), ceil(bytes / {BLOCK_BYTES}), 1) AS int)"
    ).alias("parts"))
    parts = small(materialize(parts.where("parts > 1"), "parts"))
    dealt = held.join(parts, "component", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    is_hub = F.col("node") == F.col("hub")
    own = F.array(F.pmod(F.xxhash64("node"), F.col("parts")))
    every = F.sequence(F.lit(0).cast("bigint"), (F.col("parts") - 1).cast("bigint"))
    dealt = dealt.withColumn("part", F.explode(F.when(is_hub, every).otherwise(own)))

    def to_hub(batches):
        for group in runs(batches, ["component", "part"]):
            if group.num_rows == 1:
                continue
            ids, hub = (group.column(c).to_numpy() for c in ("node", "hub"))
            all_texts = texts(group.column("text").combine_chunks())
            at = int(np.flatnonzero(ids == hub[0])[0])
            others = [k for k in range(len(ids)) if k != at]
            linked = link_hub([all_texts[k] for k in others], all_texts[at], percent)
            found = ids[others][linked]
            if len(found):
                yield table_of(LINKS, a=found, b=np.full(len(found), hub[0]))

    keys = ["component", "part"]
    stars = dealt.select("node", "text", "hub", *keys)
    stars = small_batches(stars).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(to_hub, LINKS)
    stars = materialize(stars, "hub-links")
    settled = stars.select(F.col("a").alias("node"), F.lit(True).alias("settled"))
    marked = held.join(small(settled), "node", "left").withColumn("rest", F.col("settled").isNull() & ~is_hub)
    rest = marked.where("rest").groupBy("component").agg(
        F.count(F.lit(1)).alias("n_rest"), F.sum("bytes").alias("rest_bytes")
    )
    rest = materialize(rest, "rest")
    return stars.unionByName(_tiles(marked.drop("settled"), sums, rest, percent))


def _tiles(marked: DataFrame, sums: DataFrame, rest: DataFrame, percent: int) -> DataFrame:
    """Links of the classes of the rest with all others of their group.

    Blocks hold either classes of the rest or others. A tile takes a block of the rest and any block, so the
    others travel once for each block of the rest, and not at all where there is none.
    """
    blocks = rest.join(sums, "component").select("component", *[
        F.expr(f"cast(greatest(ceil(({n}) / {BLOCK_DOCS}), ceil(({size}) / {BLOCK_BYTES})) AS int)").alias(name)
        for name, n, size in (
            ("of_rest", "n_rest", "rest_bytes"), ("of_others", "n - n_rest", "bytes - rest_bytes"),
        )
    ])
    blocks = small(materialize(blocks, "blocks"))
    spread = marked.join(blocks, "component").withColumn(
        "block", F.when(F.col("rest"), F.pmod(F.xxhash64("node"), F.col("of_rest")))
        .otherwise(F.col("of_rest") + F.pmod(F.xxhash64("node"), F.greatest("of_others", F.lit(1)))).cast("int"),
    )
    # A block of the rest meets every block, one of the others those of the rest.
    last = F.when(F.col("rest"), F.col("of_rest") + F.col("of_others")).otherwise(F.col("of_rest")) - 1
    tiles = spread.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    keys = ["component", "low", "high"]
    tiles = tiles.select(
        "node", "text", "block", "component", F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
    )

    def run(batches):
        for group in runs(batches, keys):
            if group.num_rows == 1:
                continue
            ids, block = (group.column(c).to_numpy() for c in ("node", "block"))
            found = link_tile(ids, block, texts(group.column("text").combine_chunks()), percent)
            if len(found):
                yield table_of(LINKS, a=found[:, 0], b=found[:, 1])

    return small_batches(tiles).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, LINKS)


def groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per input row."""
    width = groups_for(percent)
    found = materialize(sketches(docs, width), "sketches")
    classes = found.where("print IS NOT NULL AND doc_id IS NOT NULL").groupBy("print").agg(
        F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.first("n_shingles").alias("n_shingles"),
        F.first("sketch").alias("sketch"), F.first("checks").alias("checks"),
    )
    classes = materialize(classes, "classes")
    links = confirm(docs, thin(classes, candidates(classes, width), percent), percent)
    joined = components(links, "links").withColumnRenamed("node", "rep")
    merged = classes.join(joined, "rep", "left").where("component IS NOT NULL OR rep < last")
    merged = materialize(
        merged.select("print", F.coalesce("component", "rep").alias("component")), "merged"
    )
    return (
        found.join(small(merged), "print", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
        .select(
            "doc_id", "n_shingles", "component_id",
            F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        )
    )


def keep(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each group, with all its columns: the one with the smallest id.

    Rows are told apart by a number of their own, so rows that repeat an id, or have none, are judged by
    their texts: of equal rows one stays, and a text that is unlike all others stays whatever its id.
    Ties of the id are decided by a hash of the text; rows without an id come last.
    """
    row = unused(docs, "row")
    held = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = groups(held.select(F.col(row).alias("doc_id"), "text"), percent)
    found = materialize(found.select(F.col("doc_id").alias("row"), "component_id", "kept"), "found")
    several = materialize(found.where("NOT kept").select("component_id").distinct(), "several")
    members = found.join(small(several), "component_id").select("component_id", "row")
    names = held.select(
        F.col(row).alias("row"), F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("hash")
    )
    members = materialize(names.join(small(materialize(members, "members")), "row"), "ordered")
    first = members.groupBy("component_id").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash", "row"))["row"].alias("row")
    )
    gone = materialize(members.select("row").join(first, "row", "left_anti"), "gone")
    gone = small(gone.withColumnRenamed("row", row))
    return held.join(gone, row, "left_anti").drop(row)
