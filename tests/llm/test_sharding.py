import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from ratingloom.llm import sharding

from . import odd


def test_odd_rows(spark):
    docs = odd.documents(spark, [(100 + i, f"t{i}", "en", "a", 1, "", 0) for i in range(500)])
    rows = sharding.place(docs, shards=7).collect()
    assert len(rows) == 511
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 7) and 0 <= r.shard < 7 and r.law == "key"
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id])) for r in rows)
    assert sharding.place(odd.empty(spark)).count() == 0


def test_slots_across_ranges_of_the_hash(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 10)
    docs = odd.documents(spark, [(100 + i, "t", "en", "a", 1, "", 0) for i in range(1000)])
    slots = defaultdict(list)
    for r in sharding.place(docs, shards=4).collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_weights_set_the_shares_and_confine_the_moves(spark):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"))
    before = sharding.tree(8, per_rack=2, racks=2)
    rack = before[1].children[0]
    heavier = sharding.Node(rack.name, (rack.children[0], sharding.Shard(rack.children[1].number, 2.0)))
    after = (before[0], sharding.Node(before[1].name, (heavier, before[1].children[1])))
    both = sharding.descend(sharding.descend(ids, before, "old"), after, "new")
    moves = {(r.old, r.new): r["count"] for r in both.groupBy("old", "new").count().collect()}
    region = lambda s: s // 4
    assert all(region(new) == 1 for (old, new) in moves if old != new)
    count = defaultdict(int)
    for (old, new), n in moves.items():
        count[new] += n
    assert abs(count[5] / 20_000 - 2 / 9) < 0.02 and abs(count[0] / 20_000 - 1 / 9) < 0.02


def test_slots_of_a_frequent_id_and_of_equal_rows_lie_in_bounded_parts(spark, monkeypatch):
    """A third of all rows share an id, a third are equal: no window holds either, and no slot is lost."""
    monkeypatch.setattr(sharding, "SLOT_ROWS", 10)
    more = [(50, f"text {i}", "en", "a", 1, "", 0) for i in range(600)]
    more += [(None, "the same", "en", "a", 1, "", 0)] * 600
    docs = odd.documents(spark, more + [(100 + i, "t", "en", "a", 1, "", 0) for i in range(600)])
    tables = {}
    plain = sharding.materialize
    monkeypatch.setattr(sharding, "materialize", lambda df, label: tables.setdefault(label, plain(df, label)))
    rows, slots = sharding.place(docs, shards=4).collect(), defaultdict(list)
    assert len(rows) == 1811
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    texts = sorted(((r.doc_id or -1, zlib.crc32((r.text or "").encode())) for r in docs.collect()))
    assert sorted((r.doc_id or -1, r.text_crc32) for r in rows) == texts
    assert tables["slot-pieces"].agg(F.max("_n")).first()[0] == 10
    parts = tables["slot-starts"]
    assert parts.count() > 1811 / 80 and parts.groupBy("shard", "_range").count().agg(F.max("count")).first()[0] > 10
