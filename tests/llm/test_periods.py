"""Runs of words against a search of all periods, and the grammar against plain comparison."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest

from ratingloom.llm import periods, queries

from . import odd

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain_runs(words):
    """All runs by comparing the text with itself, shifted by every period."""
    number = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    n, found = len(ids), {}
    for p in range(1, n // 2 + 1):
        equal = np.concatenate([[0], ids[p:] == ids[:-p], [0]]).astype(int)
        edge = np.diff(equal)
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            if b - a + p >= max(12, 2 * p):
                found.setdefault((int(a), int(b + p)), p)
    return sorted((a, b - a, p) for (a, b), p in found.items())


def plain_runs_in_order(words):
    return sorted(plain_runs(words), key=lambda r: (r[0], r[2]))


def plain_tail(doc_id, words):
    h, n, out = zlib.crc32(str(doc_id).encode()), len(words), list(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        for i in range(a, n):
            out[i] = words[a + (i - a) % p]
    return out


def plain_row(words):
    runs = plain_runs_in_order(words)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (
        len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
    )


def strings(rng):
    yield np.zeros(500, int)
    yield np.arange(60)
    a, b = np.array([0]), np.array([0, 1])
    while len(b) < 900:
        a, b = b, np.concatenate([b, a])
    yield b
    for size, letters in ((300, 1), (300, 2), (500, 3), (800, 8), (13, 2), (12, 1), (11, 1), (1, 1)):
        yield rng.integers(0, letters, size)
    for _ in range(40):
        word = rng.integers(0, rng.integers(2, 30), rng.integers(1, 90))
        text = np.concatenate([rng.integers(0, 30, rng.integers(0, 30)), np.tile(word, rng.integers(2, 9)),
                               word[: rng.integers(0, len(word) + 1)], rng.integers(0, 4, rng.integers(0, 60))])
        yield text


def test_runs_are_all_runs():
    documents = [np.asarray(s, np.int32) for s in strings(np.random.default_rng(7))]
    doc, start, length, period = periods.find_runs(documents, periods.Grids())
    got = [[] for _ in documents]
    for d, s, n, p in zip(doc, start, length, period):
        got[d].append((s, n, p))
    want = [plain_runs_in_order(list(s)) for s in documents]
    assert got == want and sum(map(len, want)) > 200


def test_long_texts_go_through_blocks_of_the_grid(monkeypatch):
    monkeypatch.setattr(periods, "GRID", 64)
    monkeypatch.setattr(periods, "POINTS", 50)
    documents = [np.asarray(s, np.int32) for s in strings(np.random.default_rng(8))]
    doc, start, length, period = periods.find_runs(documents, periods.Grids())
    got = sorted(zip(doc, start, length, period))
    want = [(d, *r) for d, s in enumerate(documents) for r in plain_runs(list(s))]
    assert got == sorted(want)


@pytest.mark.parametrize("letters", [1, 2, 5, 40])
def test_grammar_extends_exactly(letters):
    rng = np.random.default_rng(letters)
    body = rng.integers(0, letters, 400)
    body = np.concatenate([body, body[50:250], body[:100]])
    text = np.concatenate([[letters], body, [letters + 1]])
    grammar = periods.Grammar(text)
    i = rng.integers(1, len(text) - 1, 3000)
    j = rng.integers(1, len(text) - 1, 3000)
    i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
    right, left = grammar.extend(i, j, 1), grammar.extend(i, j, -1)
    for a, b, r, f in zip(i, j, right, left):
        n = next(k for k in range(len(text)) if text[a + k] != text[b + k])
        m = next(k for k in range(len(text)) if text[a - k] != text[b - k])
        assert (r, f) == (n, m)
    assert len(grammar.levels[-1]) < len(text) // 4


def test_op11_matches_a_plain_search(spark):
    rows = queries.op11_periodic_runs(spark, SF_DIR).collect()
    got = {r.doc_id: tuple(r)[1:] for r in rows}
    documents = duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall()
    want = {i: plain_row(plain_tail(i, (t or "").encode().split())) for i, t in documents}
    assert got == want and len(rows) == len(documents)
    assert rows[0].__fields__ == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_odd_rows(spark):
    docs = odd.documents(spark, [(11, "a b c " * 4 + "a", "en", "a", 1, "", 1), (12, " x  " * 12, "en", "a", 1, "", 1)])
    got = sorted((r.doc_id or -1, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periods.runs(docs).collect())
    want = []
    for r in docs.collect():
        words = (r.text or "").encode().split()
        runs = plain_runs_in_order(words)
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
        want.append((r.doc_id or -1, len(words), runs, kept))
    assert got == sorted(want)
    assert periods.digests(periods.runs(odd.empty(spark), periods.repeat_tail)).count() == 0
    assert periods.digests(periods.runs(docs, periods.repeat_tail)).count() == docs.count()
