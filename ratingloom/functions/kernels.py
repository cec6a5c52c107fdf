"""Small numpy helpers that run inside a task, on one bounded chunk that Spark has shuffled there.

Each helper takes the columns of its chunk and yields arrays for output batches, so the working
set stays near ``CELLS`` numbers whatever the chunk produces in total.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

#: Entries of the largest temporary array.
CELLS = 1 << 22

#: A dense product beats pair expansion when it does fewer than this many times the work.
DENSE_GAIN = 24

# Ship these helpers with the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def segments(sorted_keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal keys, plus the end of the last run."""
    change = np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1
    return np.concatenate(([0], change, [len(sorted_keys)]))


def ragged(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expand runs: (which run, absolute position) for every position of every run."""
    which = np.repeat(np.arange(len(counts)), counts)
    before = np.cumsum(counts) - counts
    return which, np.arange(len(which)) - before[which] + starts[which]


def cuts(weights: np.ndarray, limit: float) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose weights sum to about ``limit`` (one row at least)."""
    edge = np.concatenate(([0], np.cumsum(weights)))
    low, n = 0, len(weights)
    while low < n:
        high = int(np.searchsorted(edge, edge[low] + limit, side="right")) - 1
        high = min(max(high, low + 1), n)
        yield low, high
        low = high


def bucket(ids: np.ndarray, n: int) -> np.ndarray:
    """Spread ids evenly over n numbers."""
    return ((ids.astype(np.uint64) * np.uint64(2654435761)) & np.uint64(0xFFFFFFFF)) % np.uint64(n)


def pair_sums(users, items, probs, leads=None, follows=None, cells=CELLS, dense_gain=DENSE_GAIN):
    """Sums of ``p_i * p_j`` over the users of a chunk, for ordered item pairs of a user.

    ``leads`` marks the rows that may stand first in a pair and ``follows`` those that may stand
    second; all of them by default. Yields ``(i, j, sum)`` in order of i. The sparse branch may yield
    a pair again, with partial sums.
    """
    order = np.argsort(users, kind="stable")
    users, items, probs = users[order], items[order], probs[order]
    bounds = segments(users)
    sizes = np.diff(bounds)
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    lead, follow = (
        np.arange(len(users)) if mask is None else np.flatnonzero(mask[order])
        for mask in (leads, follows)
    )
    rows, row = np.unique(items[lead], return_inverse=True)
    cols, col = np.unique(items[follow], return_inverse=True)
    begins = np.searchsorted(owner[follow], np.arange(n + 1))
    partners = np.diff(begins)[owner[lead]]
    height, width = len(rows), len(cols)
    work = float(partners.sum())
    if work == 0:
        return
    if n * (height + width) <= 4 * cells and n * height * width <= dense_gain * work:
        first, second = np.zeros((n, height)), np.zeros((n, width))
        first[owner[lead], row] = probs[lead]
        second[owner[follow], col] = probs[follow]
        step = max(1, cells // max(width, 1))
        for low in range(0, height, step):
            block = first[:, low : low + step].T @ second
            a, b = np.nonzero(block)
            yield rows[low + a], cols[b], block[a, b]
        return
    for low, high in cuts(partners, cells):
        left = lead[low:high]
        which, right = ragged(begins[owner[left]], partners[low:high])
        key, slot = np.unique(row[low:high][which] * width + col[right], return_inverse=True)
        sums = np.bincount(slot, weights=probs[left[which]] * probs[follow[right]])
        yield rows[key // width], cols[key % width], sums


def add_up(batches, limit=CELLS):
    """Add partial cells ``(i, j, sum)`` that arrive in batches; yields them once, in order of i.

    Equal cells are merged whenever more than ``limit`` new ones have piled up, so the memory in use
    follows the number of different cells and not the number of batches.
    """
    keys, sums, fresh = [], [], 0

    def merge():
        key, slot = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(slot, weights=np.concatenate(sums))

    for i, j, g in batches:
        keys.append((i.astype(np.int64) << 32) | (j.astype(np.int64) & 0xFFFFFFFF))
        sums.append(g)
        fresh += len(g)
        if fresh > limit and len(keys) > 1:
            key, total = merge()
            keys, sums, fresh = [key], [total], 0
    if keys:
        key, total = merge()
        keep = total != 0
        key, total = key[keep], total[keep]
        if len(key) == 0:
            return
        yield (key >> 32).astype(np.int32), key.astype(np.uint32).view(np.int32), total


def as_rows(group, ids, *columns):
    """Pack cells that are sorted by ``(group, id)`` into rows with lists, as Arrow arrays."""
    if len(ids) == 0:
        return [pa.array(x) for x in (group, ids)] + [
            pa.ListArray.from_arrays(pa.array([0], pa.int32()), pa.array(c)) for c in columns
        ]
    change = (ids[1:] != ids[:-1]) | (group[1:] != group[:-1])
    starts = np.concatenate(([0], np.flatnonzero(change) + 1))
    offsets = pa.array(np.append(starts, len(ids)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in columns]
    return [pa.array(group[starts]), pa.array(ids[starts]), *lists]


def spread(ids: np.ndarray, lists) -> tuple[np.ndarray, np.ndarray]:
    """Flatten a list column: the row's id beside every list entry."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(ids, lengths), lists.flatten().to_numpy(zero_copy_only=False)


def log_products(users, items, others, sizes, cand, g, top=None, decimals=None, cells=CELLS,
                 dense_share=0.2, exclude_seen=False):
    """For each user and candidate: the sum of ``log g(candidate, j)`` over the user's items j.

    ``users, items`` are the chunk's (user, j) rows. The known cells of g come row by row:
    ``others`` are the distinct j, ``sizes`` the number of cells of each, ``cand`` and ``g`` the
    cells themselves. A candidate that lacks a cell for one of the user's items has product 0 and
    is left out, and with ``exclude_seen`` so are the user's own items. Yields ``(user, candidate,
    log product)``; with ``top``, only candidates that reach the user's ``top``-th best value here.
    """
    if len(users) == 0 or len(cand) == 0:
        return
    order = np.argsort(users, kind="stable")
    users, items = users[order], items[order]
    bounds = segments(users)
    names, degree = users[bounds[:-1]], np.diff(bounds)
    cols, col = np.unique(cand, return_inverse=True)
    width, depth, logs = len(cols), len(others), np.log(g)
    order = np.argsort(others)
    rows = others[order]
    at = np.minimum(np.searchsorted(rows, items), depth - 1)
    at = np.where(rows[at] == items, order[at], depth)  # depth: no cell at all for this item
    dense = len(logs) >= dense_share * width * depth
    if dense:
        table = np.full((depth + 1, width), -np.inf)
        table[np.repeat(np.arange(depth), sizes), col] = logs
        weight = degree * width
    else:
        length = np.append(sizes, 0)
        start = np.cumsum(length) - length
        weight = np.maximum(np.add.reduceat(length[at], bounds[:-1]), width)
    for low, high in cuts(weight, cells):
        first, last = bounds[low], bounds[high]
        if dense:
            score = np.add.reduceat(table[at[first:last]], bounds[low:high] - first, axis=0)
        else:
            which, cell = ragged(start[at[first:last]], length[at[first:last]])
            owner = np.repeat(np.arange(high - low), degree[low:high])[which]
            slot = owner * width + col[cell]
            space = (high - low) * width
            score = np.bincount(slot, weights=logs[cell], minlength=space).reshape(-1, width)
            hits = np.bincount(slot, minlength=space).reshape(-1, width)
            score[hits != degree[low:high, None]] = -np.inf
        if exclude_seen:
            own = np.minimum(np.searchsorted(cols, items[first:last]), width - 1)
            there = cols[own] == items[first:last]
            rated = np.repeat(np.arange(high - low), degree[low:high])
            score[rated[there], own[there]] = -np.inf
        if decimals is not None:
            score = np.round(score, decimals)
        keep = np.isfinite(score)
        if top is not None and top < width:
            keep &= score >= -np.partition(-score, top - 1, axis=1)[:, top - 1 : top]
        a, b = np.nonzero(keep)
        yield names[low + a], cols[b], score[a, b]


def rows_of(lists, k: int) -> np.ndarray:
    """A list column of k-vectors as a matrix."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def vectors_of(matrix: np.ndarray):
    """A matrix as a list column of its rows."""
    n, k = matrix.shape
    offsets = pa.array(np.arange(0, n * k + 1, k, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel()))


def new_h(h, x, b, scalar: bool, renormalize: bool) -> np.ndarray:
    """The multiplicative H update for a batch of user rows."""
    y = h @ b
    d, e = h * y, h * x
    if scalar:
        d, e = d.sum(1, keepdims=True), e.sum(1, keepdims=True)
    low = y + e
    out = h * np.divide(x + d, low, out=np.zeros_like(h), where=low != 0)
    if renormalize:
        s = out.sum(1, keepdims=True)
        out = np.divide(out, s, out=np.zeros_like(out), where=s != 0)
    return out


def gram_sum(batches: Iterator[np.ndarray], k: int) -> np.ndarray:
    """Sum of the outer products of all rows of a partition."""
    out = np.zeros((k, k))
    for block in batches:
        out += block.T @ block
    return out
