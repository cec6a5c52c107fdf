"""RM2 relevance model inside each cluster.

For a user u and a candidate item i of the same cluster:

    score(i, u) = product over j in I_u of  g(i, j),    g(i, j) = sum over users v of p(i|v) p(j|v)

``g`` depends on the cluster only, so it is computed once per cluster as a matrix product of the
flat table of p(i|u) with itself. A score is then a sum of logarithms over the user's items. Both
products are cut into chunks of bounded size: users of a cluster are hashed into *chunks* and
candidate items into *blocks*, so a cluster that holds most users is simply more chunks. Inside a
chunk numpy sums in place; item pairs of single users never become rows. Ratings are positive: the
logarithm of a sum that is not has no meaning.

How many chunks and blocks there are follows from the data: enough for the work, and of all such
pairs the one that copies the fewest bytes, as cells of g go to every chunk and lists of users to the
blocks. A list goes only where it can score: every candidate needs a cell with each of the user's items,
so also with the rarest, and only the blocks that hold a cell of that item get the list.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import nullcontext
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.functions import kernels
from ratingloom.operators import aggregates
from ratingloom.operators.matrix import DATABASE, MAX_BUCKETS, RatingMatrix
from ratingloom.operators.skew import MIN_ROWS, lookup_join
from ratingloom.session import discard, fits_broadcast, materialize, scratch_path, shuffle_partitions

#: Rows of p(i|u) in one chunk, at most.
CHUNK_MAX = 4_000_000

#: Cells of g that one task adds to scores, about.
TASK_WORK = 1_000_000_000

#: Bytes of a list entry and of a cell of g, as they are sent.
ENTRY_BYTES, CELL_BYTES = 4, 12

#: Cells of g in one block.
BLOCK_CELLS = 2_000_000

#: Cells of g that one task adds up, and item pairs of users that it expands for them.
TILE_CELLS = 4_000_000
TILE_PAIRS = 2_000_000_000

#: Items of one packed list of a user.
LIST_ITEMS = 4096


def ratings_by_cluster(
    ratings: DataFrame, clusters: DataFrame, heavy: DataFrame | None = None
) -> DataFrame:
    """Every rating with its user's cluster, as flat rows: ``(cluster, user, item, rating, seq)``."""
    joined = lookup_join(ratings, clusters, "user", F.col("seq"), heavy=heavy)
    return joined.select("cluster", "user", "item", "rating", "seq")


def totals_by_cluster(ratings: DataFrame, clusters: DataFrame) -> DataFrame:
    """Every user's rating sum with the user's cluster: ``(cluster, user, total)``."""
    totals = aggregates.user_totals(ratings)
    return totals.join(clusters, "user").select("cluster", "user", "total")


def user_item_prob(matrix: RatingMatrix, clusters: DataFrame, lam: float = 0.5) -> DataFrame:
    """Smoothed ``p(i|u) = (1 - lam) r / sum(r_u) + lam p(i|C)`` for rated items.

    Returns ``(cluster, user, item, p, first_seq)``. The matrix is read in place: user totals and
    clusters come to its buckets, the item probabilities are looked up.
    """
    users = matrix.user_totals().withColumnRenamed("total", "given").join(clusters, "user")
    rows = matrix.join_items(matrix.join_users(users), matrix.item_probs(), 32)
    own = F.col("rating") / F.col("given")
    return rows.select(
        "cluster", "user", "item",
        (F.lit(1.0 - lam) * own + F.lit(lam) * F.col("p_item")).alias("p"), "first_seq",
    )


def prepare_probs(
    ratings: DataFrame | RatingMatrix, clusters: DataFrame, lam: float = 0.5,
    min_heavy_rows: int = MIN_ROWS,
) -> DataFrame:
    """:func:`user_item_prob`, written once because scoring reads it several times."""
    shared = isinstance(ratings, RatingMatrix)
    with nullcontext(ratings) if shared else RatingMatrix(ratings, min_heavy_rows) as matrix:
        return materialize(user_item_prob(matrix, clusters, lam), "probs")


@dataclass
class Plan:
    """How finely to cut the work.

    ``table`` has one row per cluster, ``(cluster, n_chunks, n_blocks, n_lists, n_groups, n_parts)``,
    so its size is the width k of the factors: small enough to collect and to broadcast at any data
    size. ``cuts`` are its rows as a lookup for the tasks.

    Items are hashed into blocks and blocks into groups. A pair of groups is a tile of g, added up by
    ``n_parts`` tasks that share the users; cells of g are scored in blocks of columns.
    """

    table: DataFrame
    cuts: dict[int, tuple[int, ...]]

    def blocks(self, cluster: int) -> int:
        return self.cuts[cluster][1]

    def parts(self) -> int:
        return max([c[4] for c in self.cuts.values()], default=1)


def cheapest_cut(
    rows: float, cells: float, tasks: float, least_chunks: int, least_blocks: int, most_blocks: int
) -> tuple[int, int]:
    """Chunks and blocks that make ``tasks`` tasks and copy the fewest bytes.

    Every block may get all lists and every chunk gets all cells, so bytes are ``rows * blocks`` entries and
    ``cells * chunks`` cells. Among the powers of two, and the least, numbers of chunks are tried.
    """
    best = None
    for chunks in sorted({least_chunks, *(1 << n for n in range(41))}):
        if chunks < least_chunks:
            continue
        blocks = min(max(least_blocks, math.ceil(tasks / chunks)), max(least_blocks, most_blocks))
        cost = (rows * blocks * ENTRY_BYTES + cells * chunks * CELL_BYTES, chunks, blocks)
        best = cost if best is None else min(best, cost)
        if chunks * blocks > tasks and blocks == least_blocks:
            break
    return best[1], best[2]


def cluster_plan(
    probs: DataFrame, chunk_max: int = CHUNK_MAX, block_cells: int = BLOCK_CELLS,
    tile_cells: int = TILE_CELLS, tile_pairs: int = TILE_PAIRS, task_work: int = TASK_WORK,
) -> Plan:
    """Cut every cluster by counted rows, items and item pairs of users.

    g has at most as many cells as there are pairs of items, and as its users have pairs: a wide
    catalogue with short lists stays in few blocks. Nothing follows from the session's partitions.
    """
    spark = probs.sparkSession
    degrees = probs.groupBy("cluster", "user").agg(F.count(F.lit(1)).alias("n"))
    found = degrees.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.sum(F.col("n").cast("double") ** 2).alias("pairs")
    ).collect()
    items_of = dict(
        probs.groupBy("cluster").agg(F.approx_count_distinct("item").alias("n")).collect()
    )
    cuts = {}
    for r in found:
        n_items = items_of[r["cluster"]]
        cells = min(float(n_items) ** 2, r["pairs"])
        n_groups = min(n_items, math.ceil(math.sqrt(cells / tile_cells)))
        n_chunks, n_blocks = cheapest_cut(
            r["n"], cells, r["n"] * cells / n_items / task_work, math.ceil(r["n"] / chunk_max),
            max(n_groups, min(n_items, math.ceil(cells / block_cells))), n_items,
        )
        n_parts = max(r["pairs"] / n_groups**2 / tile_pairs, 2 * r["n"] / n_groups / chunk_max)
        cuts[r["cluster"]] = (
            n_chunks, n_blocks, math.ceil(n_items / LIST_ITEMS), n_groups, math.ceil(n_parts),
        )
    table = spark.createDataFrame(
        [(c, *v) for c, v in cuts.items()],
        "cluster int, n_chunks int, n_blocks int, n_lists int, n_groups int, n_parts int",
    )
    return Plan(table, cuts)


def _chunked(users: DataFrame, plan: Plan) -> DataFrame:
    return users.join(F.broadcast(plan.table), "cluster").withColumn(
        "chunk", F.pmod(F.xxhash64("user"), F.col("n_chunks")).cast("int")
    )


def tile_rows(probs: DataFrame, plan: Plan) -> DataFrame:
    """The rows of p(i|u) in every tile of g that they have a share in.

    A row of group a goes to the tiles ``(a, b)`` and ``(b, a)`` with the smaller number first: as many
    copies as there are groups. A user with very many items is cut by this in both directions.
    """
    # The same number as kernels.bucket gives.
    block = F.expr("pmod((cast(item AS bigint) * 2654435761) & 4294967295, n_blocks)")
    rows = probs.join(F.broadcast(plan.table), "cluster").withColumns({
        "own": F.pmod(block, F.col("n_groups")).cast("int"),
        "part": F.pmod(F.xxhash64("user"), F.col("n_parts")).cast("int"),
    })
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_groups") - 1)))
    return rows.select(
        "cluster", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        "part", "user", "item", "p", "own",
    )


def _cooccurrence_rows(probs: DataFrame, plan: Plan) -> DataFrame:
    """``g`` packed by row and block of columns: ``(cluster, block, i, j list, g list)``.

    A tile's rows meet in one task, which adds up its item pairs in place; g is symmetric, so a tile
    off the diagonal gives its mirror image too. Where several tasks share the users of a tile, their
    sums meet once more; the number of these tasks follows from the pairs and not from the cluster's
    size.
    """

    def packed(cluster: int, i, j, g, names: list[str]) -> pa.RecordBatch:
        block = kernels.bucket(j, plan_blocks[cluster]).astype(np.int32)
        order = np.lexsort((block, i))
        rows = kernels.as_rows(block[order], i[order], j[order], g[order])
        same = pa.array(np.full(len(rows[0]), cluster, dtype=np.int32))
        return pa.RecordBatch.from_arrays([same, *rows], names)

    plan_blocks = {cluster: plan.blocks(cluster) for cluster in plan.cuts}
    columns = ["cluster", "block", "i", "j", "g"]
    schema = "cluster int, block int, i int, j array<int>, g array<double>"

    def tile(
        key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        cluster, low, high = (k.as_py() for k in key[:3])
        rows = pa.Table.from_batches(batches)
        users, items, p, own = (
            rows.column(name).to_numpy(zero_copy_only=False) for name in ("user", "item", "p", "own")
        )
        found = kernels.add_up(kernels.pair_sums(users, items, p, own == low, own == high))
        for i, j, g in found:
            yield packed(cluster, i, j, g, columns)
            if low != high:
                yield packed(cluster, j, i, g, columns)

    def add_up(
        key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        pieces = (
            (*kernels.spread(b.column("i").to_numpy(), b.column("j")),
             b.column("g").flatten().to_numpy())
            for b in batches
        )
        for i, j, g in kernels.add_up(pieces):
            yield packed(key[0].as_py(), i, j, g, columns)

    cells = (
        tile_rows(probs, plan).groupBy("cluster", "low", "high", "part").applyInArrow(tile, schema)
    )
    if plan.parts() == 1:
        return cells
    # All parts of a cell are in one row of g and one block, and few rows of g share a hash.
    rows_of = F.pmod(F.xxhash64("i"), F.lit(1 << 10)).alias("rows")
    return cells.select("*", rows_of).groupBy("cluster", "block", "rows").applyInArrow(add_up, schema)


def cluster_cooccurrence(probs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """``g(i, j)`` of every cluster for ``i <= j``: ``(cluster, i, j, g)``, zero cells left out."""
    rows = _cooccurrence_rows(probs, cluster_plan(probs) if plan is None else plan)
    cells = rows.select("cluster", "i", F.explode(F.arrays_zip("j", "g")).alias("c"))
    return cells.select("cluster", "i", "c.j", "c.g").where("i <= j")


def directory(cells: DataFrame) -> DataFrame:
    """Where the rows of g are: ``(cluster, item, n, blocks)``, with the cells of an item in all blocks.

    ``cells`` are packed rows of g, each once. As many rows as there are items in clusters.
    """
    return cells.groupBy("cluster", F.col("i").alias("item")).agg(
        F.sum(F.size("j")).alias("n"), F.sort_array(F.collect_set("block")).alias("blocks")
    )


def routes(probs: DataFrame, where: DataFrame) -> DataFrame:
    """``(cluster, user, blocks)``: the blocks that hold a cell of the user's rarest item.

    ``where`` is a written :func:`directory`. A user none of whose items is in it has no row: there is
    nothing to score. Only pairs of numbers are combined before the shuffle by user.
    """
    rows = where.count()
    counts = where.select("cluster", "item", "n")
    counts = F.broadcast(counts) if fits_broadcast(rows, 48) else counts
    rare = probs.select("cluster", "user", "item").join(counts, ["cluster", "item"])
    rare = rare.groupBy("cluster", "user").agg(F.min(F.struct("n", "item")).alias("rare"))
    places = where.select("cluster", "item", "blocks")
    most = where.agg(F.max(F.size("blocks"))).first()[0] or 0
    places = F.broadcast(places) if fits_broadcast(rows, 48 + 8 * most) else places
    return rare.select("cluster", "user", F.col("rare.item").alias("item")).join(
        places, ["cluster", "item"]
    ).select("cluster", "user", "blocks")


def routed_lists(probs: DataFrame, plan: Plan, where: DataFrame | None) -> DataFrame:
    """``(cluster, chunk, block, id, items)``: users' lists in the blocks that may score them.

    A list is cut at about ``LIST_ITEMS`` items, so that no row grows with a user. Without ``where`` all lists
    go to block 0, which is right if there is no other.
    """
    lists = (
        _chunked(probs, plan)
        .groupBy("cluster", "chunk", F.col("user").alias("id"),
                 F.pmod(F.xxhash64("item"), F.col("n_lists")).alias("part"))
        .agg(F.collect_list("item").alias("items"))
    )
    if where is None:
        return lists.select("cluster", "chunk", F.lit(0).alias("block"), "id", "items")
    to = materialize(routes(probs, where), "routes").withColumnRenamed("user", "id")
    to = F.broadcast(to) if fits_broadcast(to.count(), 256) else to
    return lists.join(to, ["cluster", "id"]).select(
        "cluster", "chunk", F.explode("blocks").alias("block"), "id", "items"
    )


def _score(
    cluster: int, user: pa.Table, cell: pa.Table, top: int | None, digits: int | None, exclude_seen: bool
) -> Iterator[pa.RecordBatch]:
    """Scores of a chunk of users with a block of candidates."""
    if user.num_rows == 0 or cell.num_rows == 0:
        return
    user, cell = user.combine_chunks(), cell.combine_chunks()
    users, items = kernels.spread(user.column("id").to_numpy(), user.column("items").chunk(0))
    others, sizes = cell.column("id").to_numpy(), pc.list_value_length(cell.column("items"))
    cand = cell.column("items").chunk(0).flatten().to_numpy()
    g = cell.column("g").chunk(0).flatten().to_numpy()
    found = kernels.log_products(
        users, items, others, sizes.to_numpy(), cand, g, top=top, decimals=digits,
        exclude_seen=exclude_seen,
    )
    for who, item, value in found:
        same = np.full(len(who), cluster, dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(same), pa.array(who), pa.array(item), pa.array(value)],
            ["cluster", "user", "item", "log_score"],
        )


SCORES = "cluster int, user int, item int, log_score double"


def rm2_scores(
    probs: DataFrame,
    plan: Plan | None = None,
    top: int | None = None,
    digits: int | None = None,
    exclude_seen: bool = False,
) -> DataFrame:
    """Non-zero RM2 scores as logarithms: ``(cluster, user, item, log_score)``.

    A plain product would underflow for users with a few hundred items. With ``top``, each block
    returns only candidates among a user's best ``top`` there, which is enough to rank them later.
    ``exclude_seen`` leaves out the items that a user has rated, before that choice.

    Every (chunk of users, block of candidates) meets in one task. The rows sent there are packed: a list of
    items per user, routed by the rarest item, and a list of cells per item. g is written once, as
    both the routes and the scores read it, unless clusters have one block each and nothing is to be
    routed; :class:`CooccurrenceStore` keeps it for later scoring.
    """
    plan = cluster_plan(probs) if plan is None else plan
    g, where = _cooccurrence_rows(probs, plan), None
    if any(c[1] > 1 for c in plan.cuts.values()):
        g = materialize(g, "cooccurrence")
        where = materialize(directory(g), "directory")
    lists = routed_lists(probs, plan, where)
    wanted = lists.withColumn("g", F.lit(None).cast("array<double>"))

    def score(
        key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches)
        is_user = pc.is_null(group.column("g"))
        user, cell = group.filter(is_user), group.filter(pc.invert(is_user))
        yield from _score(key[0].as_py(), user, cell, top, digits, exclude_seen)

    return (
        wanted.unionByName(chunk_copies(g, plan))
        .groupBy("cluster", "chunk", "block")
        .applyInArrow(score, SCORES)
    )


def chunk_copies(g: DataFrame, plan: Plan) -> DataFrame:
    """The packed cells for every chunk: ``(cluster, chunk, block, id, items, g)``.

    g is symmetric: the columns of row i are the candidates of item i.
    """
    return g.join(F.broadcast(plan.table), "cluster").select(
        "cluster", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk"),
        "block", F.col("i").alias("id"), F.col("j").alias("items"), "g",
    )


class CooccurrenceStore:
    """g of all clusters, written once in the layout that scoring reads.

    The table is bucketed by (cluster, chunk, block), so scoring joins it in place: other users, other
    ``top``, or seen items left out need only the lists of the users to be sent. Use it as a context
    manager, which drops the table at the end: what is read from it has to be written before.
    """

    KEYS = ("cluster", "chunk", "block")

    def __init__(self, probs: DataFrame, plan: Plan | None = None):
        self.spark = spark = probs.sparkSession
        self.plan = cluster_plan(probs) if plan is None else plan
        g = materialize(_cooccurrence_rows(probs, self.plan), "cooccurrence")
        self.where = materialize(directory(g), "directory")
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {DATABASE}")
        self.name = f"{DATABASE}.cooccurrence_{uuid.uuid4().hex}"
        places = sum(c[0] * c[1] for c in self.plan.cuts.values())
        n = max(1, min(MAX_BUCKETS, places, 4 * shuffle_partitions(spark)))
        (
            chunk_copies(g, self.plan).repartition(n, *self.KEYS)
            .write.bucketBy(n, *self.KEYS)
            .option("path", scratch_path(spark, "cooccurrence-store"))
            .format("parquet")
            .saveAsTable(self.name)
        )
        discard(g)
        self.table = spark.table(self.name)

    def __enter__(self) -> CooccurrenceStore:
        return self

    def __exit__(self, *_) -> None:
        discard(self.table, self.where)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def scores(
        self, probs: DataFrame, top: int | None = None, digits: int | None = None, exclude_seen: bool = False,
        chunk_max: int = CHUNK_MAX,
    ) -> DataFrame:
        """:func:`rm2_scores` of the users in ``probs`` against the stored g.

        The users need not be those that g was added up from; an item that g does not know leaves a user
        without scores, as its sums are zero. More rows than the stored chunks may hold at once are
        scored in rounds of users, each of which reads g in place.
        """

        def score(key: tuple[pa.Scalar, ...], user: pa.Table, cell: pa.Table) -> pa.Table:
            found = list(_score(key[0].as_py(), user, cell, top, digits, exclude_seen))
            return pa.Table.from_batches(found) if found else empty

        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64())
        empty = pa.table({c.split()[0]: pa.array([], k) for c, k in zip(SCORES.split(", "), kinds)})
        most = probs.groupBy("cluster").count().join(F.broadcast(self.plan.table), "cluster").agg(
            F.max(F.col("count") / F.col("n_chunks"))
        ).first()[0]
        rounds = max(1, math.ceil((most or 0) / chunk_max))
        lists = routed_lists(probs, self.plan, self.where)
        # Chunks take the same hash modulo their number, so rounds take another one.
        turn = F.pmod(F.xxhash64("id", F.lit("round")), F.lit(rounds))
        out = None
        for r in range(rounds):
            mine = lists if rounds == 1 else lists.where(turn == r)
            part = mine.groupBy(*self.KEYS).cogroup(self.table.groupBy(*self.KEYS)).applyInArrow(score, SCORES)
            out = part if out is None else out.unionByName(part)
        return out


def rm2_last_item(probs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """The variant that multiplies only one factor: ``g(i, last item of u)``.

    The last item is the one that arrived last among the user's items, by first arrival.
    """
    plan = cluster_plan(probs) if plan is None else plan
    last = materialize(
        probs.groupBy("cluster", "user").agg(
            F.max_by("item", F.struct("first_seq", "item")).alias("last")
        ),
        "last-items",
    )
    # Only rows of g of some user's last item are asked for, each once per so many users.
    asked = materialize(
        last.groupBy("cluster", "last").agg(
            F.ceil(F.count(F.lit(1)) / MIN_ROWS).cast("int").alias("n_salts")
        ),
        "asked-items",
    )
    asked = F.broadcast(asked) if fits_broadcast(asked.count(), 64) else asked
    rows = _cooccurrence_rows(probs, plan).withColumnRenamed("i", "last")
    rows = rows.join(asked, ["cluster", "last"]).select(
        "cluster", "last", F.explode(F.sequence(F.lit(0), F.col("n_salts") - 1)).alias("salt"),
        F.arrays_zip("j", "g").alias("cells"),
    )
    users = last.join(asked, ["cluster", "last"]).withColumn(
        "salt", F.pmod(F.xxhash64("user"), F.col("n_salts")).cast("int")
    )
    found = users.join(rows, ["cluster", "last", "salt"]).select(
        "cluster", "user", F.explode("cells").alias("c")
    )
    return found.select(
        "cluster", "user", F.col("c.j").alias("item"), F.log("c.g").alias("log_score")
    )


def candidate_pairs(
    clusters: DataFrame, items: DataFrame, user_part: int = 4096, item_part: int = 4096
) -> DataFrame:
    """Every cluster user with every catalogue item: ``(cluster, user, item)``.

    Users and items are hashed into tiles and joined tile by tile: an equi-join on bounded keys
    that needs no broadcast side and spreads over users x items / tile size partitions.
    """
    n_users, n_items = clusters.count(), items.count()
    rows, cols = -(-n_users // user_part) or 1, -(-n_items // item_part) or 1
    left = clusters.select(
        "cluster", "user", F.pmod(F.xxhash64("user"), F.lit(rows)).cast("int").alias("tile_u"),
        F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("tile_i"),
    )
    right = items.select(
        "item", F.pmod(F.xxhash64("item"), F.lit(cols)).cast("int").alias("tile_i"),
        F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("tile_u"),
    )
    return left.join(right, ["tile_u", "tile_i"]).select("cluster", "user", "item")


def dense_scores(scores: DataFrame, clusters: DataFrame, items: DataFrame) -> DataFrame:
    """One row per candidate pair: ``(cluster, user, item, score, log_score)``.

    A pair without a score gets 0 and a null logarithm.
    """
    pairs = candidate_pairs(clusters, items)
    found = scores.select("user", "item", "log_score")
    return pairs.join(found, ["user", "item"], "left").select(
        "cluster", "user", "item",
        F.coalesce(F.exp("log_score"), F.lit(0.0)).alias("score"), "log_score",
    )


def score(
    ratings: DataFrame | RatingMatrix, clusters: DataFrame, lam: float = 0.5,
    top: int | None = None, digits: int | None = None, exclude_seen: bool = False,
) -> DataFrame:
    """End-to-end RM2 from ratings and clusters; see :func:`rm2_scores` for the result."""
    probs = prepare_probs(ratings, clusters, lam)
    return rm2_scores(probs, top=top, digits=digits, exclude_seen=exclude_seen)
