"""The numpy helpers against plain loops, with tiny working sets to force many batches."""

from collections import defaultdict

import numpy as np
import pytest

from ratingloom.functions import kernels as K


def chunk(seed, n_users=13, n_items=17, share=0.4):
    rng = np.random.default_rng(seed)
    cells = [(u, i * 3, rng.random() + 0.01) for u in range(n_users) for i in range(n_items)
             if rng.random() < share]
    rng.shuffle(cells)
    users, items, probs = zip(*cells)
    return (np.array(users, dtype=np.int32), np.array(items, dtype=np.int32), np.array(probs))


def brute_pairs(users, items, probs):
    rows = defaultdict(dict)
    for u, i, p in zip(users, items, probs):
        rows[u][i] = p
    g = defaultdict(float)
    for row in rows.values():
        for i, p in row.items():
            for j, q in row.items():
                g[i, j] += p * q
    return rows, g


def added(batches):
    got = defaultdict(float)
    for i, j, g in batches:
        assert (np.diff(i) >= 0).all()
        for x, y, v in zip(i, j, g):
            got[x, y] += v
    return got


def assert_same(got, want):
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


@pytest.mark.parametrize("cells", [1, 7, 50, 1 << 20])
@pytest.mark.parametrize("gain", [0, 1e9])
@pytest.mark.parametrize("share", [0.05, 0.6])
def test_pair_sums(cells, gain, share):
    data = chunk(3, share=share)
    _, want = brute_pairs(*data)
    assert_same(added(K.pair_sums(*data, cells=cells, dense_gain=gain)), want)


@pytest.mark.parametrize("gain", [0, 1e9])
def test_pair_sums_in_parts(gain):
    """Rows split over two calls by which may lead a pair: together they give every pair once."""
    users, items, probs = chunk(4)
    _, want = brute_pairs(users, items, probs)
    got = {}
    for part in (0, 1):
        found = added(K.pair_sums(users, items, probs, items % 2 == part, dense_gain=gain))
        assert not set(found) & set(got)
        got.update(found)
    assert_same(got, want)


@pytest.mark.parametrize("limit", [1, 30, 10**6])
def test_add_up(limit):
    rng = np.random.default_rng(1)
    batches, want = [], defaultdict(float)
    for _ in range(9):
        i, j = (rng.integers(-3, 5, 20).astype(np.int32) for _ in range(2))
        g = rng.random(20)
        batches.append((i, j, g))
        for x, y, v in zip(i, j, g):
            want[x, y] += v
    found = list(K.add_up(iter(batches), limit))
    assert len(found) == 1 and len(found[0][0]) == len(want)
    assert_same(added(found), want)
    assert list(K.add_up(iter([]))) == []


def test_as_rows_and_spread():
    group, ids = np.array([0, 0, 0, 1]), np.array([4, 4, 6, 6], dtype=np.int32)
    values = np.array([1.0, 2.0, 3.0, 4.0])
    g, i, lists = K.as_rows(group, ids, values)
    assert g.to_pylist() == [0, 0, 1] and i.to_pylist() == [4, 6, 6]
    assert lists.to_pylist() == [[1.0, 2.0], [3.0], [4.0]]
    back, flat = K.spread(i.to_numpy(), lists)
    assert (back == ids).all() and (flat == values).all()
    assert all(len(x) == 0 for x in K.as_rows(group[:0], ids[:0], values[:0]))


def test_bucket_is_stable_and_even():
    ids = np.arange(-500, 9500, 10, dtype=np.int32)
    found = K.bucket(ids, 7)
    assert (found == K.bucket(ids, 7)).all()
    assert np.bincount(found.astype(int), minlength=7).min() > len(ids) / 14


@pytest.mark.parametrize("cells", [1, 40, 1 << 20])
@pytest.mark.parametrize("dense_share", [0.0, 2.0])
@pytest.mark.parametrize("top", [None, 3])
def test_log_products(cells, dense_share, top):
    users, items, probs = chunk(5, share=0.2)
    rows, g = brute_pairs(users, items, probs)
    table = defaultdict(dict)
    for (i, j), v in g.items():
        table[j][i] = v
    others = np.array(sorted(table, reverse=True), dtype=np.int32)
    sizes = np.array([len(table[j]) for j in others])
    cand = np.array([i for j in others for i in table[j]], dtype=np.int32)
    cells_g = np.array([v for j in others for v in table[j].values()])
    want = {}
    for u, row in rows.items():
        for i in set(items):
            if all(i in table[j] for j in row):
                want[u, i] = sum(np.log(table[j][i]) for j in row)
    got = {}
    for u, i, v in K.log_products(users, items, others, sizes, cand, cells_g, top=top, cells=cells,
                                  dense_share=dense_share):
        got.update({(a, b): c for a, b, c in zip(u, i, v)})
    if top is None:
        assert set(got) == set(want)
    else:
        for u in rows:
            best = sorted((v for (a, _), v in want.items() if a == u), reverse=True)[:top]
            mine = sorted((v for (a, _), v in got.items() if a == u), reverse=True)
            assert np.allclose(mine[: len(best)], best)
            assert len(mine) >= len(best)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_ties_at_the_cut_are_kept():
    one = np.ones(1, dtype=np.int32)
    found = list(K.log_products(one, one, one, np.array([3]), np.array([1, 2, 3], dtype=np.int32),
                                np.array([0.5, 0.5, 0.1]), top=1))
    assert sorted(found[0][1]) == [1, 2]
