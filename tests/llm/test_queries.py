"""The registered corpus queries on whole tables, against SQL or a plain version in Python."""

import base64
import hashlib
import math
import os
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from ratingloom.llm import bpe, hosts, mixing, oracles, queries, tokens, toxicity

from . import odd
from .test_hosts import plain as plain_signals
from .test_minhash import plain_groups
from .test_mixing import water_fill

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("documents", "embeddings", "pages", "labels")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def table(name):
    return duckdb.sql(f"SELECT * FROM '{SF_DIR}/{name}.parquet'").fetchdf().to_dict("records")


def key(row):
    return [(v is not None, v) for v in row]


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    result = duck.sql(oracles.ORACLES[name])
    assert columns == sorted(result.columns)
    want = result.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert got and sorted(got, key=key) == sorted(want, key=key)


def digests(model, text):
    ids = model.encode_ordinary(text or "")
    return (
        len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
        hashlib.sha256((text or "").encode()).hexdigest(),
    )


def test_op3(spark):
    model = bpe.encoder(bpe.vocabulary())
    got = {r.doc_id: tuple(r)[1:] for r in queries.op3_byte_bpe(spark, SF_DIR).collect()}
    assert got == {d["doc_id"]: digests(model, d["text"]) for d in table("documents")}


def test_op6(spark):
    pages = table("pages")
    largest = {}
    for p in pages:
        largest[p["html"]] = max(largest.get(p["html"], -1), p["page_id"])
    want = {}
    for p in pages:
        data, first = (p["html"] or "").encode(), largest[p["html"]]
        name = base64.b32encode(hashlib.sha1(data).digest()).decode()
        revisit = first != p["page_id"]
        want[p["page_id"]] = (len(data), name, "revisit" if revisit else "response", first if revisit else None)
    got = {r.page_id: tuple(r)[1:] for r in queries.op6_warc(spark, SF_DIR).collect()}
    assert got == want


def test_op9(spark):
    from .test_tokens import library

    start, want, model = 0, {}, library()
    for d in sorted(table("documents"), key=lambda d: d["doc_id"]):
        ids = model.encode(d["text"] or "", add_special_tokens=False).ids + [tokens.END_ID]
        want[d["doc_id"]] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r.doc_id: tuple(r)[1:] for r in queries.op9_token_orc(spark, SF_DIR).collect()}
    assert got == want


def test_op10(spark):
    documents = {d["doc_id"]: (d["text"] or "").encode() for d in table("documents")}
    rows, slots = queries.op10_shard_tree(spark, SF_DIR).collect(), defaultdict(list)
    assert len(rows) == len(documents)
    for r in rows:
        text = documents[r.doc_id]
        assert (r.size, r.text_crc32, r.law) == (len(text) + 16, zlib.crc32(text), "key")
        assert r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(40))


def plain_shard(doc_id, shards, grown=False):
    """Region, rack and shard by hand: 40 shards are two regions of four racks of five."""
    def least(children):
        def draw(child):
            name, weight = child[0], child[1]
            h = int(hashlib.md5(f"{doc_id}/{name}".encode()).hexdigest()[:12], 16)
            return -math.log((h + 0.5) / 2**48) / weight
        return min(children, key=draw)

    racks = [(f"rack{i}", 5.0, [(f"shard{s}", 1.0, s) for s in range(5 * i, 5 * i + 5)]) for i in range(shards // 5)]
    regions = [(f"region{i}", 20.0, racks[4 * i : 4 * i + 4]) for i in range(len(racks) // 4)]
    if grown:
        regions.append((f"region-of-{shards}", 1.0, [(f"rack-of-{shards}", 1.0, [(f"shard{shards}", 1.0, shards)])]))
    return least(least(least(regions)[2])[2])[2]


def test_op10_draws_are_those_of_a_plain_descent(spark):
    for r in queries.op10_shard_tree(spark, SF_DIR).collect():
        assert (r.shard, r.grown_shard) == (plain_shard(r.doc_id, 40), plain_shard(r.doc_id, 40, grown=True))


def test_op7_finds_held_out_toxic_documents(spark):
    """Labels that training never sees, in tables large enough to have some; few are toxic, so bounds are wide."""
    folder = os.path.join(os.path.dirname(SF_DIR), "sf0.1")
    labels = duckdb.sql(f"SELECT doc_id, toxic FROM '{folder}/labels.parquet'").fetchall()
    toxic = dict(labels)
    rows = [r for r in queries.op7_toxicity(spark, folder).collect() if r.held_out and r.doc_id in toxic]
    caught = [r.predicted for r in rows if toxic[r.doc_id] == 1]
    alarms = [r.predicted for r in rows if toxic[r.doc_id] == 0]
    assert len(caught) > 100 and np.mean(caught) >= 0.75 and np.mean(alarms) <= 0.02


def test_op2_and_op7_return_every_document(spark):
    ids = sorted(d["doc_id"] for d in table("documents"))
    for query, rest, parts in ((queries.op2_language, 0, 5), (queries.op7_toxicity, 1, 3)):
        rows = query(spark, SF_DIR).collect()
        assert sorted(r.doc_id for r in rows) == ids and all(0 <= r.score <= 1 for r in rows)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == rest) for r in rows)


def plain_mix(docs):
    """Copies of each document by a sorted walk through its source."""
    sources = defaultdict(list)
    for d in docs:
        h = int(hashlib.md5(str(d["doc_id"]).encode()).hexdigest()[:12], 16)
        sources[d["source"]].append((h, len((d["text"] or "").encode().split()), d["doc_id"]))
    order = sorted(sources, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(n for _, n, _ in rows) for s, rows in sources.items()}
    target = water_fill({s: (size[s], i % 3 + 1) for i, s in enumerate(order)})
    copies = {}
    for s, rows in sources.items():
        times = int(target[s] // size[s])
        rest, through = target[s] - times * size[s], 0
        for _, n, doc_id in sorted(rows):
            copies[doc_id] = times + (rest > 0 and (
                through + n <= rest or rest > through and through + n - rest < rest - through
            ))
            through += n
    return copies


def plain_hosts(documents):
    """Documents that pass the base rule and whose source is not rejected, by moments of a beta prior."""
    failed = {}
    for d in documents:
        words, _, _, _, repeated = plain_signals(d["text"])
        failed[id(d)] = words < 10 or 100 * repeated > 20 * words
    n, f = defaultdict(int), defaultdict(int)
    for d in documents:
        if d["source"] is not None:
            n[d["source"]] += 1
            f[d["source"]] += failed[id(d)]
    total, mean = sum(n.values()), sum(f.values()) / max(sum(n.values()), 1)
    spread = sum(n[h] * (f[h] / n[h] - mean) ** 2 for h in n)
    rest, over = len(n) - 1, total - sum(v * v for v in n.values()) / max(total, 1)
    variance = mean * (1 - mean)
    rho = (spread / variance - rest) / (over - rest) if variance and over != rest else None
    weight = min(max(1 / rho - 1, hosts.PRIOR_LEAST), hosts.PRIOR_MOST) if rho and rho > 0 else hosts.PRIOR_MOST
    bad = {h for h in n if (f[h] + weight * mean) / (n[h] + weight) > hosts.MAX_RATE}
    return [d for d in documents if not failed[id(d)] and d["source"] not in bad]


def test_quality_stage_rejects_hosts(spark):
    good = "every word of this sentence is different from all others here "
    rows = [(i, good + str(i), "en", f"s{i % 5}", 1) for i in range(100)]
    rows += [(1000 + i, "short", "en", "bad", 1) for i in range(60)] + [(2000, good, "en", "bad", 1), (2001, good, "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    want = {d["doc_id"] for d in plain_hosts([r.asDict() for r in docs.collect()])}
    assert {r.doc_id for r in corpus_pipeline.quality(spark, docs, "").collect()} == want == {*range(100), 2001}


def test_stages_take_odd_and_empty_documents(spark, tmp_path):
    labels = [(i, 1, int(i % 2)) for i in range(1, 10)]
    clean = [(20, " ".join(f"word{i}" for i in range(40)), None, None, None, None, None)]
    for name, docs in (("odd", odd.documents(spark, clean)), ("empty", odd.empty(spark))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        found = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert (found.count() == 0) == (name == "empty")


def test_pipeline_matches_a_plain_version(spark):
    """Every stage by hand; the network's scores are the operator's own, the decision is not."""
    found = corpus_pipeline.run(spark, SF_DIR).collect()
    documents = table("documents")
    kept = plain_hosts(documents)
    rows = spark.createDataFrame([(d["doc_id"], d["text"]) for d in kept], "doc_id bigint, text string")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    score = {r.doc_id: r.score for r in toxicity.score(rows, labels).collect()}
    kept = [d for d in kept if score[d["doc_id"]] < 0.7]
    groups = plain_groups([(d["doc_id"], d["text"]) for d in kept], corpus_pipeline.NEAR_PERCENT)
    kept = [d for d in kept if groups[d["doc_id"]][1] == d["doc_id"]]
    copies, model = plain_mix(kept), bpe.encoder(bpe.vocabulary())
    want = [(d["doc_id"], *digests(model, d["text"])) for d in kept for _ in range(copies[d["doc_id"]])]
    assert sorted(tuple(r) for r in found) == sorted(want) and len(want) > 50


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_DIR).columns == docs.columns


def test_mix_fixture_agrees_with_the_operator(spark):
    copies = plain_mix(table("documents"))
    got = {r.doc_id: r.taken // r["size"] for r in mixing.mix(spark.read.parquet(f"{SF_DIR}/documents.parquet")).collect() if r["size"]}
    assert all(copies[i] == n for i, n in got.items())
