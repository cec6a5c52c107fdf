"""Periodic runs of words: a run-length grammar by recompression answers exact extensions.

A *run* is a stretch of words with smallest period q, at least ``max(MIN_LENGTH, 2 q)`` words long, that no
neighbouring word extends keeping period q.

Candidates lie on a harmonic grid: two words that are p places apart and equal, both at multiples of p. A
run of period p covers two neighbouring multiples, so for every p the grid has it; all grids of a text of
n words together have about n ln n points. A point whose words are not among six equal ones in a row
begins no run and is dropped; the others ask how far the text agrees with itself to the right and to
the left. The answers come from a grammar that recompression builds: levels alternate between replacing
maximal blocks of one symbol, and pairs of neighbours from two halves of the alphabet, by new symbols.
Equal stretches are parsed alike but for their edges, so a query climbs while both sides are at an edge
of a symbol, takes one step (a symbol, or a block's rest) where they are not, stops at the first
difference and descends with one step a level at most. Levels are built while queries need them.

The texts of a slice share one grammar, each behind a symbol of its own that nothing equals, so no
extension leaves its text. A text is never split between tasks: memory is about 100 bytes a word of the
longest one. Work on a text of n words is n log n for the grammar and n log n grid points.

Defined cases: a null text and a text without words have no runs; rows with equal ids are rows of their
own; a null id is kept; of runs that are the same stretch only the smallest period is named; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.llm.common import map_texts, ship, texts

ship(__name__)

#: A run has this many words at least.
MIN_LENGTH = 12
#: Equal words in a row that any run has p places apart: ``max(12 - p, p)`` is 6 at least.
MIN_EQUAL = 6
#: Places of a text whose grid is made at once, and grid points that are extended at once.
GRID, POINTS = 1 << 15, 1 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15


class Grammar:
    """A recompressed string of integers from 0 on; its first and its last symbol occur only once.

    ``levels[t]`` are the symbols of level t, level 0 the string itself. ``steps[t]`` leads from level t to
    the next: ``(up, first, blocks)`` with the symbol above each symbol, the first symbol below each (and
    one more entry for the end), and whether blocks or pairs were replaced.
    """

    def __init__(self, symbols: np.ndarray):
        self.levels = [symbols.astype(np.int64)]
        self.steps: list[tuple[np.ndarray, np.ndarray, bool]] = []
        self.names = int(symbols.max(initial=-1)) + 1
        self.draws = 0

    def step(self, t: int) -> tuple[np.ndarray, np.ndarray, bool]:
        """The step from level t to the next, built when it is first asked for."""
        if t == len(self.steps):
            symbols = self.levels[t]
            equal = symbols[1:] == symbols[:-1]
            if equal.any():
                self._replace(symbols, np.flatnonzero(np.concatenate([[True], ~equal])), True)
            else:
                second = 1 + self._pairs(symbols)
                head = np.ones(len(symbols), bool)
                head[second] = False
                self._replace(symbols, np.flatnonzero(head), False)
        return self.steps[t]

    def _pairs(self, symbols: np.ndarray) -> np.ndarray:
        """Where pairs begin: of some random halves of the alphabet the two with most pairs."""
        best = np.zeros(0, np.int64)
        while len(best) == 0:
            for _ in range(3):
                self.draws += 1
                odd = np.uint64((_MULTIPLIER * (2 * self.draws + 1)) % (1 << 64))
                half = (symbols.astype(np.uint64) * odd) >> np.uint64(63)
                for left in (0, 1):
                    found = np.flatnonzero((half[:-1] == left) & (half[1:] != left))
                    best = found if len(found) > len(best) else best
        return best

    def _replace(self, symbols: np.ndarray, first: np.ndarray, blocks: bool) -> None:
        """Add a level whose symbols begin at ``first``; equal contents get equal names."""
        size = np.diff(first, append=len(symbols))
        above = symbols[first]
        new = np.flatnonzero(size > 1)
        second = size[new] if blocks else symbols[first[new] + 1]
        _, name = np.unique((above[new] << 32) | second, return_inverse=True)
        above[new] = self.names + name
        self.names += int(name.max(initial=-1)) + 1
        up = np.repeat(np.arange(len(first)), size)
        self.levels.append(above)
        self.steps.append((up, np.append(first, len(symbols)), blocks))

    def extend(self, i: np.ndarray, j: np.ndarray, way: int) -> np.ndarray:
        """How many symbols from ``i`` and ``j`` on are equal, to the right (1) or to the left (-1)."""
        which, a, b = np.arange(len(i)), i, j
        stopped: list[list[tuple[np.ndarray, ...]]] = []
        while len(which):
            t = len(stopped)
            symbols = self.levels[t]
            same = symbols[a] == symbols[b]
            stopped.append([(which[~same], a[~same], b[~same])])
            which, a, b = which[same], a[same], b[same]
            if not len(which):
                break
            up, first, blocks = self.step(t)
            above_a, above_b = up[a], up[b]
            if way > 0:
                inside = (a != first[above_a]) | (b != first[above_b])
                rest_a, rest_b = first[above_a + 1] - a, first[above_b + 1] - b
            else:
                inside = (a != first[above_a + 1] - 1) | (b != first[above_b + 1] - 1)
                rest_a, rest_b = a - first[above_a] + 1, b - first[above_b] + 1
            shift = np.where(inside, np.minimum(rest_a, rest_b) if blocks else 1, 0) * way
            a, b = a + shift, b + shift
            if blocks:  # the shorter rest ends at another symbol, the longer one goes on
                uneven = inside & (rest_a != rest_b)
                stopped[t].append((which[uneven], a[uneven], b[uneven]))
                which, a, b = which[~uneven], a[~uneven], b[~uneven]
            a, b = up[a], up[b]
        length = np.zeros(len(i), np.int64)
        which = a = b = np.zeros(0, np.int64)
        for t in range(len(stopped) - 1, -1, -1):
            which, a, b = (np.concatenate(x) for x in zip((which, a, b), *stopped[t]))
            if t == 0:
                break
            symbols, (_, first, blocks) = self.levels[t - 1], self.steps[t - 1]
            size = np.minimum(first[a + 1] - first[a], first[b + 1] - first[b]) if blocks else 1
            a, b = (first[a], first[b]) if way > 0 else (first[a + 1] - 1, first[b + 1] - 1)
            shift = np.where(symbols[a] == symbols[b], size, 0) * way
            a, b = a + shift, b + shift
        length[which] = (a - i[which]) * way
        return length


def grid(low: int, high: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(e, p)`` in which ``p <= longest`` divides ``e``, for ``low <= e < high``, ``low >= 1``."""
    root = math.isqrt(high)
    ends, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p in range(1, min(root, longest) + 1):
        ends.append(np.arange(-(-low // p) * p, high, p))
        periods.append(np.full(len(ends[-1]), p))
    for times in range(1, high // (root + 1) + 1):
        p = np.arange(max(root + 1, -(-low // times)), min(longest, (high - 1) // times) + 1)
        ends.append(p * times)
        periods.append(p)
    return np.concatenate(ends), np.concatenate(periods)


class Grids:
    """The grid of places under ``GRID``, in ascending order: a text's grid is its beginning."""

    def __init__(self):
        end, period = grid(1, GRID, GRID)
        order = np.argsort(end, kind="stable")
        self.end, self.period = end[order].astype(np.int32), period[order].astype(np.int32)
        self.before = np.searchsorted(self.end, np.arange(GRID + 1))

    def of(self, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of the grid of a text of n words."""
        last = self.before[min(n, GRID)]
        yield self.end[:last], self.period[:last]
        for low in range(GRID, n, GRID):
            yield grid(low, min(n, low + GRID), n // 2)


def in_a_row(ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether equal words at x and y are among ``MIN_EQUAL`` pairs of equal ones in a row."""
    found = np.ones(len(x), np.int64)
    for way in (1, -1):
        more = np.ones(len(x), bool)
        for k in range(1, MIN_EQUAL):
            a, b = x + way * k, y + way * k
            more &= (a >= 0) & (b < len(ids))  # behind either end of the text nothing is equal
            more &= ids.take(a, mode="clip") == ids.take(b, mode="clip")
            found += more
    return found >= MIN_EQUAL


def find_runs(documents: list[np.ndarray], grids: Grids) -> tuple[np.ndarray, ...]:
    """``(document, start, length, period)`` of all runs, ordered by document, start and period.

    ``documents`` are the words of each text as numbers from 0 on.
    """
    asked, points = [], []
    for d, ids in enumerate(documents):
        n = len(ids)
        if n < MIN_LENGTH:
            continue
        mine = []
        for end, period in grids.of(n):
            hit = np.flatnonzero(ids[end] == ids[end - period])
            end, period = end[hit].astype(np.int64), period[hit].astype(np.int64)
            hit = np.flatnonzero(in_a_row(ids, end - period, end) & (2 * period <= n))
            if len(hit):
                mine.append((end[hit], period[hit]))
        if mine:
            asked.append(d)
            points.append(mine)
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if not asked:
        return none
    most = 1 + max(int(documents[d].max()) for d in asked)
    parts, bases, at = [np.array([most])], [], 1
    for k, d in enumerate(asked):
        parts += [documents[d], np.array([most + 1 + k])]  # each text ends in a symbol of its own
        bases.append(at)
        at += len(documents[d]) + 1
    grammar = Grammar(np.concatenate(parts))
    found = []
    for d, base, mine in zip(asked, bases, points):
        for end, period in mine:
            found.append((np.full(len(end), d), np.full(len(end), base), end, period))
    doc, base, end, period = (np.concatenate(x) for x in zip(*found))
    kept = []
    for low in range(0, len(doc), POINTS):
        part = slice(low, low + POINTS)
        p, y = period[part], base[part] + end[part]
        right = grammar.extend(y - p, y, 1)
        left = grammar.extend(y - p - 1, y - 1, -1)
        length = left + right + p
        good = length >= np.maximum(2 * p, MIN_LENGTH)
        start = end[part] - p - left
        rows = np.stack([doc[part][good], start[good], length[good], p[good]], axis=1)
        kept.append(np.unique(rows, axis=0) if len(rows) else rows)
    rows = np.unique(np.concatenate(kept), axis=0)
    if not len(rows):
        return none
    # Of one stretch only the smallest period: the others are its multiples.
    rows = rows[np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])]
    return tuple(rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))].T)


RUNS = (
    "doc_id bigint, n_words bigint,"
    " runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
)


def runs(
    docs: DataFrame, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None
) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` for each row.

    ``runs`` are in order of start and period. ``collapsed`` has the words that no run holds behind its
    first period, joined by one space. ``change`` may replace a text's words before they are searched.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string"))
    held: list[Grids] = []

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(Grids())
        words = [t.split() for t in texts(part.column("text"))]
        if change is not None:
            words = [change(i, w) for i, w in zip(part.column("doc_id").to_pylist(), words)]
        number: dict[bytes, int] = {}
        documents = [
            np.fromiter((number.setdefault(w, len(number)) for w in ws), np.int32, len(ws)) for ws in words
        ]
        doc, start, length, period = find_runs(documents, held[0])
        offsets = np.searchsorted(doc, np.arange(len(words) + 1)).astype(np.int32)
        collapsed = []
        for ws, a, b in zip(words, offsets, offsets[1:]):
            if a < b:
                change_at = np.zeros(len(ws) + 1, np.int64)
                np.add.at(change_at, start[a:b] + period[a:b], 1)
                np.add.at(change_at, start[a:b] + length[a:b], -1)
                ws = [ws[i] for i in np.flatnonzero(np.cumsum(change_at[:-1]) == 0)]
            collapsed.append(b" ".join(ws))
        items = pa.StructArray.from_arrays(
            [pa.array(x.astype(np.int64)) for x in (start, length, period)], ["start", "length", "period"]
        )
        return pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"), pa.array([len(w) for w in words], pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), items),
                pa.array(collapsed, pa.binary()).cast(pa.string()),
            ],
            ["doc_id", "n_words", "runs", "collapsed"],
        )

    return map_texts(rows, work, RUNS)


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Make the end of every tenth text (by a hash of the id) periodic; rows without an id stay."""
    h, n = (1, 0) if doc_id is None else (zlib.crc32(str(doc_id).encode()), len(words))
    if h % 10 or n == 0:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def digests(found: DataFrame) -> DataFrame:
    """Of the result of :func:`runs`: the number of runs, the longest one, and digests."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")
    )))
    lines = F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")
    ))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("best.length * 1000 div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
