import random
import re

import numpy as np
import pytest

import corpus_pipeline
from ratingloom.llm import minhash

from . import odd
from .test_common import brute


def plain_set(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def plain_groups(rows, percent=85):
    """``{doc_id: (size, component)}`` by comparing all pairs."""
    sets = {i: plain_set(t) for i, t in rows if i is not None}
    ids = sorted(i for i in sets if sets[i])
    links = []
    for at, a in enumerate(ids):
        for b in ids[at + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                links.append((a, b))
    root = brute(links)
    return {i: (len(s), root.get(i, i)) for i, s in sets.items()}


def family(rng, first, copies, words, changes):
    """A text and copies of it in which a few words are exchanged."""
    text = [f"w{rng.randrange(4000)}" for _ in range(words)]
    rows = [(first, " ".join(text))]
    for i in range(1, copies):
        own = list(text)
        for _ in range(rng.randrange(changes + 1)):
            own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        rows.append((first + i, " ".join(own)))
    return rows


def corpus():
    rng = random.Random(5)
    rows = family(rng, 0, 120, 150, 8) + family(rng, 1000, 40, 30, 2) + family(rng, 2000, 30, 400, 20)
    rows += [(3000 + i, " ".join(f"w{rng.randrange(4000)}" for _ in range(rng.randrange(1, 80)))) for i in range(150)]
    rows += [(4000 + i, "exactly the same few words here") for i in range(30)]
    rows += [(5000 + i, "three words only" if i % 2 else "THREE words Only") for i in range(6)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [512, 16])
def test_groups_match_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", block)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.groups(docs).collect()}
    assert got == plain_groups(rows)


def test_the_pipeline_keeps_one_of_each_group_at_four_fifths(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.distinct(spark, docs, "").collect())
    want = {p: sorted(i for i, (_, c) in plain_groups(rows, p).items() if c == i) for p in (80, 85)}
    assert got == want[80] and len(want[80]) < len(want[85])


def test_lower_thresholds_take_as_many_tables_as_they_need():
    def missed(percent, n):
        return 1 - (1 - (1 - (percent / 100) ** minhash.ROWS) ** n) ** 2

    assert [minhash.groups_for(p) for p in (100, 85, 80)] == [7, 7, 10]
    for p in (50, 70, 80):
        n = minhash.groups_for(p)
        assert missed(p, n) <= minhash.MISSED < missed(p, n - 1)


def test_odd_rows(spark):
    docs = odd.documents(spark)
    got = minhash.groups(docs).collect()
    assert len(got) == 11
    want = plain_groups([(r.doc_id, r.text) for r in docs.collect()])
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)
    assert {r.component_id for r in got if r.doc_id in (5, 6)} == {5}
    kept = minhash.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 7, 8, 9]
    assert minhash.groups(odd.empty(spark)).count() == minhash.keep(odd.empty(spark)).count() == 0


def test_keep_judges_rows_by_their_texts(spark):
    same, other, near = (
        "one and the same text of words " * 9, "quite another text with own words " * 9, "".join(f"n{i} " for i in range(100))
    )
    rows = [(1, same), (1, same), (1, same), (None, other), (None, other), (None, other), (2, near + "g"), (2, "x y z " * 30 + "w"),
            (3, near + "h"), (None, same), (None, near + "i"), (4, ""), (4, ""), (5, None), (5, None)]
    docs = spark.createDataFrame([(*r, i, "r") for i, r in enumerate(rows)], "doc_id bigint, text string, _gone int, row string")
    for parts in (1, 3):
        kept = minhash.keep(docs.repartition(parts))
        assert kept.columns == docs.columns
        got = sorted(((r.doc_id or 0), r.text or "") for r in kept.collect())
        want = [(0, other), (1, same), (2, "x y z " * 30 + "w"), (2, near + "g"), (4, ""), (4, ""), (5, ""), (5, "")]
        assert got == sorted(want)


def test_boilerplate_is_not_compared(spark, monkeypatch):
    """Texts that share half of their words are candidates of each other, and no text of them moves."""
    rng, rows = random.Random(9), []
    shared = [f"c{i}" for i in range(200)]
    for i in range(600):
        rows.append((i, " ".join(shared + [f"w{rng.randrange(10**9)}" for _ in range(200)])))
    rows += [(1000 + i, rows[i][1] + " and more") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    seen = []
    confirm = minhash.confirm
    monkeypatch.setattr(minhash, "confirm", lambda d, m, p: seen.append(m.count()) or confirm(d, m, p))
    got = {r.doc_id: r.component_id for r in minhash.groups(docs).collect()}
    assert got == {i: i - 1000 if i >= 1000 else i for i, _ in rows}
    classes = minhash.sketches(docs).withColumnsRenamed({"doc_id": "rep"})
    assert minhash.candidates(classes).count() > 300 and seen[0] <= 20


def test_the_estimate_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    for percent in (80, 85):
        least = minhash.least_agreeing(percent)
        agree = rng.binomial(minhash.CHECKS, percent / 100, 10**6)
        assert (agree < least).mean() <= 3 * minhash.MISSED_CHECK
        assert (rng.binomial(minhash.CHECKS, 0.5, 10**6) >= least).mean() < 0.002


def test_texts_are_sent_once_where_the_hub_links_all(spark, monkeypatch):
    """A hub and near copies: the tiles of the rest get nothing; a chain needs them."""
    base = [f"w{i}" for i in range(400)]
    star = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(300)]
    chain = [(1000 + i, " ".join(f"w{k}" for k in range(3 * i, 3 * i + 60))) for i in range(30)]
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 20)
    tiles, sent = minhash._tiles, []

    def counted(marked, sums, rest, percent):
        sent.append(rest.agg({"n_rest": "sum"}).first()[0] or 0)
        return tiles(marked, sums, rest, percent)

    monkeypatch.setattr(minhash, "_tiles", counted)
    for rows in (star, chain):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.groups(docs).collect()}
        assert got == plain_groups(rows)
    assert sent[0] == 0 and sent[1] > 10


def test_shared_counts_light_and_heavy_shingles():
    rng = np.random.default_rng(2)
    sets = [set(rng.integers(0, 60, 25).tolist()) | {1000 + i // 3} for i in range(30)]
    doc = np.concatenate([[i] * len(s) for i, s in enumerate(sets)])
    shingle = np.concatenate([sorted(s) for s in sets])
    got = minhash.shared(doc, shingle, len(sets))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert i == j or got[i, j] == len(a & b)


def test_exact_shingles_of_short_and_empty_texts():
    texts = [b"a b c d e f", b"", b"a b", b"b a", b"a b c d e", b"a b c d e a b c d e"]
    doc, shingle = minhash.exact_shingles([t.split() for t in texts])
    sets = [set(shingle[doc == i].tolist()) for i in range(len(texts))]
    assert [len(s) for s in sets] == [2, 0, 1, 1, 1, 5]
    assert sets[0] & sets[4] == sets[4] and not sets[2] & sets[3]


def test_tensored_keys_meet_as_often_as_they_should(spark):
    """Share of tables in which two sets of known similarity meet, over many pairs."""
    a, b = minhash.parameters()
    rng = np.random.default_rng(1)
    met = []
    for _ in range(200):
        both = rng.integers(0, 2**63, 85, dtype=np.uint64)
        own = rng.integers(0, 2**63, 15, dtype=np.uint64)
        x, y = (minhash.minhashes(np.concatenate(s), a, b) for s in ((both, own[:8]), (both, own[8:])))
        met.append((x == y).mean())
    assert abs(np.mean(met) - 0.85) < 0.02
