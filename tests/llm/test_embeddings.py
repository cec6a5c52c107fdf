import numpy as np
import pytest

from ratingloom.llm import embeddings

from .test_common import brute

SCHEMA = "vec_id bigint, embedding array<float>, label int, kept string"


def plain(rows):
    """``{vec_id: (links, component)}`` of rows with distinct ids, by comparing all pairs."""
    good = [
        (i, np.array(v, float), l) for i, v, l, _ in rows
        if i is not None and l is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)
    ]
    links, n = [], dict.fromkeys([r[0] for r in rows], 0)
    for at, (i, v, l) in enumerate(good):
        for j, w, m in good[at + 1 :]:
            if l == m and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.98:
                links.append((i, j))
                n[i] += 1
                n[j] += 1
    root = brute(links)
    return {i: (n[i], root.get(i, i)) for i in n}


def cloud(rng, n, dim, labels):
    rows = []
    for i in range(n):
        if i % 3 or not rows:
            v = rng.normal(size=dim)
        else:
            base = np.array(rows[rng.integers(len(rows))][1])
            v = base + rng.normal(size=dim) * np.linalg.norm(base) / np.sqrt(dim) * rng.uniform(0, 0.35)
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(labels)) if i % 3 else (rows[-1][2] if rows else 0), None))
    return rows


@pytest.mark.parametrize("dim, block", [(16, 1024), (64, 40), (200, 1024)])
def test_links_match_all_pairs(spark, monkeypatch, dim, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "BUCKET", 32)
    rng = np.random.default_rng(dim)
    rows = cloud(rng, 500, dim, 2)
    centre = rng.normal(size=dim)
    for i in range(150):  # a large group of near copies
        rows.append((1000 + i, [float(np.float32(x)) for x in centre + 0.09 * rng.normal(size=dim)], 1, None))
    rows += [(2000 + i, rows[5][1], rows[5][2], None) for i in range(40)]
    rng.shuffle(rows)
    rows = [(int(i), v, int(l), k) for i, v, l, k in rows]
    got = {
        r.vec_id: (r.n_links, r.component_id)
        for r in embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    }
    want = plain(rows)
    assert sum(n for n, _ in want.values()) > 1000
    assert got == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0, "x"), (2, [2.0, 0.0], 0, None), (3, [1.0, 0.0], 1, None), (4, [1.0, 0.0], None, None),
        (5, None, 0, None), (6, [], 0, None), (7, [0.0, 0.0], 0, None), (8, [nan, 1.0], 0, None),
        (9, [inf, 0.0], 0, None), (10, [None, 1.0], 0, None), (11, [1.0, 0.0, 0.0], 0, None),
        (12, [3e38, 0.0], 0, None), (13, [1e-30, 0.0], 0, None), (14, [-0.0, -1.0], 0, None), (15, [0.0, -1.0], 0, None),
    ]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == plain(rows)
    assert got[1] == (3, 1) and got[13] == (3, 1) and got[15] == (1, 14)
    repeated = spark.createDataFrame([(1, [1.0, 2.0], 0, "")] * 3 + [(None, [1.0, 2.0], 0, "")], SCHEMA)
    found = embeddings.near_duplicates(repeated).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in found) == [(0, 0, 0, True)] + [(1, 2, 1, True)] * 3
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_estimates_are_unbiased_and_as_sharp_as_the_bound_says():
    rng, dim, wanted = np.random.default_rng(0), 64, 0.9
    off = []
    for number in range(300):
        spin = embeddings.rotation(dim, number)
        x = rng.normal(size=dim)
        x /= np.linalg.norm(x)
        other = rng.normal(size=dim)
        other -= other @ x * x
        y = wanted * x + np.sqrt(1 - wanted**2) * other / np.linalg.norm(other)
        turned = spin @ x
        factor = np.abs(turned).sum() / np.sqrt(dim)
        estimate = np.sign(turned) @ (spin @ y) / np.sqrt(dim) / factor
        stray = np.sqrt(1 - wanted**2) * np.sqrt(1 - factor**2) / (factor * np.sqrt(dim - 1))
        off.append((estimate - wanted) / stray)
    assert abs(np.mean(off)) < 0.2 and 0.8 < np.std(off) < 1.2 and np.abs(off).max() < embeddings.SPREAD


@pytest.mark.parametrize("dim", [16, 64, 256])
def test_codes_rarely_rule_out_a_pair_at_the_threshold(dim):
    """Differing signs of pairs at the threshold are spread no wider than the binomial bound has it."""
    rng, differing = np.random.default_rng(1), []
    for number in range(200):
        spin = embeddings.rotation(dim, number)
        x = rng.normal(size=(100, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        other = rng.normal(size=(100, dim))
        other -= (other * x).sum(axis=1, keepdims=True) * x
        other /= np.linalg.norm(other, axis=1, keepdims=True)
        y = 0.98 * x + np.sqrt(1 - 0.98**2) * other
        differing.append(((x @ spin.T > 0) != (y @ spin.T > 0)).sum(axis=1))
    found, p = np.concatenate(differing), np.arccos(0.98) / np.pi
    assert abs(found.mean() - dim * p) < 0.1 * dim * p and found.var() < 1.05 * dim * p * (1 - p)
    assert found.max() <= embeddings.most_unlike(dim, 0.98) < dim


def test_clashing_buckets_are_taken_apart():
    """Rows of other lengths and other tables in one bucket are compared among their kind only."""
    rng = np.random.default_rng(2)
    signs = {8: rng.integers(0, 256, 1, np.uint8).tobytes(), 2: b"\x01\x02"}
    kinds = [(8, 0), (8, 0), (8, 1), (8, 1), (2, 0), (2, 0), (2, 2)]
    code = [signs[d] * (d if d == 8 else 1) for d, _ in kinds]
    keys = [b"\0\0\0\0", b"\1\0\0\0"]
    tile = embeddings.pa.table({
        "code": code, "at": embeddings.pa.array([t for _, t in kinds], embeddings.pa.int32()),
        "block": [0] * 7, "keys": [b"", b"", *keys, b"", b"", b"\0" * 8],
    })
    i, j = embeddings.alike(tile, 0.98)
    assert {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())} == {(0, 1), (2, 3), (4, 5)}


def test_tables_grow_slowly_with_the_labels():
    sizes = [embeddings.tables_for(n) for n in (1, 1000, 10**6, 10**9)]
    assert [b for b, _ in sizes] == sorted(b for b, _ in sizes) and sizes[-1][1] < 60
