"""Toxicity by a bidirectional gated recurrent network with attention pooling, over all windows.

A word enters the network as the embedding of its identity (for words of the training vocabulary)
joined with the average embedding of its hashed character trigrams (for any word). A text is cut into
overlapping windows of ``WINDOW`` words, ``STRIDE`` apart, so that every run of ``WINDOW - STRIDE`` words
lies whole in some window; the network reads each window in both directions, attention pools the
states, and the text's score is the calibrated score of its worst window.

The network is trained on the driver in numpy, from a sample of about ``TRAIN_ROWS`` labelled texts,
half of them toxic where there are so many. Labels are of texts, not windows: each round trains on
the worst window of every toxic text, on windows of clean texts and on the worst of these, as the
network of the round before sees them; the first round ranks windows by the log odds of their words. A
fifth of the sample is not trained on; on it the scores are calibrated by a logistic curve.

Defined cases: a text that is null or has no word scores 0; without labelled rows every text scores
0, and with labels of one kind every text with words scores their share; repeated rows and texts get
the same score; an empty table gives an empty result; other columns are ignored by :func:`score` and
kept by :func:`keep`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.llm.common import filter_rows, hash48, ship, slices, small_batches, table_of, texts
from ratingloom.llm.langid import is_held_out, sample

ship(__name__)

WINDOW, STRIDE = 32, 24
TRAIN_ROWS = 3_000
ROUNDS, EPOCHS, BATCH, RATE = 3, 3, 64, 0.05
WORD_DIM, CHAR_DIM, HIDDEN = 8, 8, 12
CHAR_BUCKETS = 1 << 13
#: Words of the training vocabulary: seen in this many texts at least, the most frequent ones first.
LEAST_TEXTS, VOCABULARY = 3, 20_000
#: Words whose inputs a task remembers before it starts anew.
MEMORY = 50_000
#: Windows that run through the network together.
TOGETHER = 1024
THRESHOLD = 0.7
#: Share of toxic texts that the scores are calibrated for; the sample holds more of them.
SHARE = 0.1


def byte_classes() -> bytes:
    """ASCII letters lowered, digits and other bytes kept, other ASCII turned into spaces."""
    table = bytearray(range(256))
    for i in range(128):
        c = chr(i)
        table[i] = ord(c.lower()) if c.isalnum() else 32
    return bytes(table)


CLASSES = byte_classes()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(CLASSES).split()


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of all words in a row (with boundaries), and where each begins."""
    data = np.frombuffer(b"".join(b" " + w + b" " for w in words), np.uint8).astype(np.uint32)
    lengths = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(lengths)
    value = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    inside = np.ones(len(data), bool)
    inside[ends - 1] = inside[ends - 2] = False
    hashed = (value * np.uint32(2654435769)) >> np.uint32(32 - 13)
    return hashed[inside[: len(value)]].astype(np.int64), np.cumsum(lengths - 2) - (lengths - 2)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def tanh(x: np.ndarray) -> np.ndarray:
    return 2 * sigmoid(2 * x) - 1


@dataclass
class Network:
    """Parameters: embeddings, two recurrent directions, attention and output."""

    vocabulary: dict[bytes, int]  # from 1; 0 is any other word
    p: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = field(default=None)

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Input vectors of words, and what they were made of."""
        ids = np.array([self.vocabulary.get(w, 0) for w in words], np.int64)
        buckets, starts = trigrams(words)
        counts = np.diff(np.append(starts, len(buckets)))
        chars = np.add.reduceat(self.p["chars"][buckets], starts, axis=0) / counts[:, None]
        return np.concatenate([self.p["words"][ids], chars], axis=1), ids, buckets, counts

    def run(self, ready: list[np.ndarray], windows: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """``ready`` holds the input part of all gates, per word and direction."""
        n, t = windows.shape
        h = HIDDEN
        there = windows >= 0
        states = np.empty((t, n, 2 * h), np.float32)
        for d in (0, 1):
            state = np.zeros((n, h), np.float32)
            weight, inner = self.p[f"u{d}"], []
            for step in range(t) if d == 0 else range(t - 1, -1, -1):
                x = ready[d][windows[:, step]]
                u = state @ weight
                gates = sigmoid(x[:, : 2 * h] + u[:, : 2 * h])
                z, r = gates[:, :h], gates[:, h:]
                new = tanh(x[:, 2 * h :] + r * u[:, 2 * h :])
                after = np.where(there[:, step, None], new + z * (state - new), state)
                if keep is not None:
                    inner.append((step, state, z, r, new, u[:, 2 * h :]))
                state = after
                states[step, :, d * h : (d + 1) * h] = state
            if keep is not None:
                keep[d] = inner
        attention = (states @ self.p["attend"]).T
        attention = np.where(there, attention, -1e9)
        attention = np.exp(attention - attention.max(axis=1, keepdims=True))
        attention /= attention.sum(axis=1, keepdims=True)
        pooled = np.einsum("nt,tnk->nk", attention, states)
        if keep is not None:
            keep.update(states=states, attention=attention, pooled=pooled, there=there)
        return pooled @ self.p["out"] + self.p["bias"][0]

    def gradients(self, words: list[bytes], windows: np.ndarray, target: np.ndarray) -> dict:
        """Gradients of the mean log loss of a batch, by back-propagation through time."""
        x, ids, buckets, counts = self.inputs(words)
        ready = [x @ self.p[f"in{d}"] + self.p[f"b{d}"] for d in (0, 1)]
        keep: dict = {}
        error = (sigmoid(self.run(ready, windows, keep)) - target) / len(target)
        n, t = windows.shape
        h = HIDDEN
        states, attention, there = keep["states"], keep["attention"], keep["there"]
        g = {"out": keep["pooled"].T @ error, "bias": np.array([error.sum()])}
        d_pooled = error[:, None] * self.p["out"]
        d_weight = np.einsum("nk,tnk->nt", d_pooled, states)
        d_score = attention * (d_weight - (attention * d_weight).sum(axis=1, keepdims=True))
        g["attend"] = np.einsum("nt,tnk->k", d_score, states)
        d_states = attention.T[:, :, None] * d_pooled + d_score.T[:, :, None] * self.p["attend"]
        d_x = np.zeros_like(x)
        for d in (0, 1):
            d_ready = np.zeros_like(ready[d])
            d_u = np.zeros_like(self.p[f"u{d}"])
            flow = np.zeros((n, h), np.float32)
            for step, state, z, r, new, inner in reversed(keep[d]):
                live = there[:, step, None]
                total = flow + d_states[step, :, d * h : (d + 1) * h]
                own = total * live
                d_new = own * (1 - z) * (1 - new**2)
                d_z = own * (state - new) * z * (1 - z)
                d_r = d_new * inner * r * (1 - r)
                d_gates = np.concatenate([d_z, d_r, d_new * r], axis=1)
                d_u += state.T @ d_gates
                flow = np.where(live, own * z, total) + d_gates @ self.p[f"u{d}"].T
                np.add.at(
                    d_ready, windows[:, step] * live[:, 0], np.concatenate([d_z, d_r, d_new], axis=1)
                )
            g[f"u{d}"], g[f"b{d}"], g[f"in{d}"] = d_u, d_ready.sum(axis=0), x.T @ d_ready
            d_x += d_ready @ self.p[f"in{d}"].T
        g["words"] = (ids, d_x[:, :WORD_DIM])
        g["chars"] = (buckets, np.repeat(d_x[:, WORD_DIM:] / counts[:, None], counts, axis=0))
        return g


def start(vocabulary: dict[bytes, int], odds: np.ndarray, seed: int) -> Network:
    """Random parameters; the first word dimension starts at the log odds of the word."""
    rng = np.random.default_rng(seed)
    def small(*shape):
        return rng.normal(0, 0.1, shape).astype(np.float32)
    p = {"words": small(len(vocabulary) + 1, WORD_DIM), "chars": small(CHAR_BUCKETS, CHAR_DIM)}
    p["words"][1:, 0] += odds
    for d in (0, 1):
        p[f"in{d}"] = 3 * small(WORD_DIM + CHAR_DIM, 3 * HIDDEN)
        p[f"u{d}"], p[f"b{d}"] = 2 * small(HIDDEN, 3 * HIDDEN), np.zeros(3 * HIDDEN, np.float32)
    p |= {"attend": 3 * small(2 * HIDDEN), "out": 3 * small(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
    return Network(vocabulary, p)


def windows_of(n: int) -> np.ndarray:
    """Word numbers of all overlapping windows of a text of ``n`` words, -1 behind its end."""
    starts = np.arange(0, max(n - (WINDOW - STRIDE), 1), STRIDE)
    at = starts[:, None] + np.arange(WINDOW)
    return np.where(at < n, at, -1)


class Scorer:
    """Scores texts in batches and remembers the inputs of words between them.

    It computes what ``Network.run`` does, laid out for speed: each gate has arrays of its own, a
    sigmoid is half a hyperbolic tangent, and of each state only its attention and its share of the
    output are kept. Gates: 0 update, 1 reset, 2 new state.
    """

    def __init__(self, network: Network):
        self.network = network
        p, h = network.p, HIDDEN
        half = (0.5, 0.5, 1.0)
        self.recurrent = [
            [np.ascontiguousarray(f * p[f"u{d}"][:, g * h : (g + 1) * h]) for g, f in enumerate(half)]
            for d in (0, 1)
        ]
        self.read = [
            np.stack([p[k][d * h : (d + 1) * h] for k in ("attend", "out")], axis=1) for d in (0, 1)
        ]
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ready = [[np.zeros((0, HIDDEN), np.float32)] * 3 for _ in (0, 1)]

    def logits(self, windows: np.ndarray) -> np.ndarray:
        """Scores of windows: rows of word numbers, -1 behind the last word."""
        columns = np.ascontiguousarray(windows.T)
        t, n = columns.shape
        there = columns >= 0
        whole = there.all(axis=1)
        seen = np.zeros((t, n, 2), np.float32)
        for d in (0, 1):
            uz, ur, un = self.recurrent[d]
            xz, xr, xn = self.ready[d]
            state = np.zeros((n, HIDDEN), np.float32)
            for step in range(t) if d == 0 else range(t - 1, -1, -1):
                at = columns[step]
                z = state @ uz
                z += np.take(xz, at, axis=0)
                np.tanh(z, out=z)
                r = state @ ur
                r += np.take(xr, at, axis=0)
                np.tanh(r, out=r)
                r += 1
                new = state @ un
                new *= r
                new *= 0.5
                new += np.take(xn, at, axis=0)
                np.tanh(new, out=new)
                z += 1
                z *= 0.5
                after = state - new
                after *= z
                after += new
                state = after if whole[step] else np.where(there[step][:, None], after, state)
                seen[step] += state @ self.read[d]
        attention = np.where(there, seen[..., 0], np.float32(-1e9))
        attention = np.exp(attention - attention.max(axis=0))
        return (attention * seen[..., 1]).sum(axis=0) / attention.sum(axis=0) + self.network.p["bias"][0]

    def numbered(self, documents: list[list[bytes]]) -> list[np.ndarray]:
        if len(self.number) > MEMORY:
            self.forget()
        number, known, rows = self.number, len(self.number), []
        for words in documents:
            rows.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
        fresh = list(number)[known:] if len(number) > known else []
        if fresh:
            x = self.network.inputs(fresh)[0]
            h = HIDDEN
            for d in (0, 1):
                more = (x @ self.network.p[f"in{d}"] + self.network.p[f"b{d}"]).astype(np.float32)
                more[:, : 2 * h] *= 0.5
                self.ready[d] = [
                    np.concatenate([self.ready[d][g], more[:, g * h : (g + 1) * h]]) for g in range(3)
                ]
        return rows

    def windows(self, documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logit of every window of every text with words, its text, and its number in the text."""
        rows = self.numbered(documents)
        tables, of, place = [], [], []
        for i, row in enumerate(rows):
            if len(row):
                at = windows_of(len(row))
                tables.append(np.where(at >= 0, row[at], -1))
                of.append(np.full(len(at), i))
                place.append(np.arange(len(at)))
        if not tables:
            return np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        table = np.concatenate(tables)
        logits = np.empty(len(table))
        short = table[:, -1] < 0
        for rows in (np.flatnonzero(~short), np.flatnonzero(short)):
            for k in range(0, len(rows), TOGETHER):
                logits[rows[k : k + TOGETHER]] = self.logits(table[rows[k : k + TOGETHER]])
        return logits, np.concatenate(of), np.concatenate(place)

    def worst(self, documents: list[list[bytes]]) -> np.ndarray:
        """The highest logit of each text; minus infinity without words."""
        logits, of, _ = self.windows(documents)
        found = np.full(len(documents), -np.inf)
        np.maximum.at(found, of, logits)
        return found

    def scores(self, documents: list[list[bytes]]) -> np.ndarray:
        network = self.network
        if network.constant is not None:
            return np.array([network.constant if d else 0.0 for d in documents])
        worst = self.worst(documents)
        return np.where(np.isfinite(worst), sigmoid(network.slope * np.maximum(worst, -1e6) + network.shift), 0.0)


def _log_odds(documents: list[list[bytes]], toxic: np.ndarray) -> tuple[dict[bytes, int], np.ndarray]:
    """The vocabulary and, per word, the log odds of texts with it being toxic, 0 where unsure."""
    seen = [Counter(), Counter()]
    for words, y in zip(documents, toxic):
        seen[int(y)].update(set(words))
    total = seen[0] + seen[1]
    chosen = sorted((w for w in total if total[w] >= LEAST_TEXTS), key=lambda w: (-total[w], w))[:VOCABULARY]
    a = np.array([seen[1][w] for w in chosen], float) / max(toxic.sum(), 1)
    b = np.array([seen[0][w] for w in chosen], float) / max((1 - toxic).sum(), 1)
    floor = 10 / len(documents)
    odds = np.log((a + floor) / (b + floor))
    return {w: i + 1 for i, w in enumerate(chosen)}, np.where(np.abs(odds) > 1, odds, 0).astype(np.float32)


def _window_words(words: list[bytes], place: int) -> list[bytes]:
    return words[place * STRIDE : place * STRIDE + WINDOW]


def _step(network: Network, squares: dict, batch: list[list[bytes]], target: np.ndarray) -> None:
    """One step of stochastic gradient descent with rates scaled by past gradients (Adagrad)."""
    number: dict[bytes, int] = {}
    table = np.full((len(batch), WINDOW), -1)
    for i, words in enumerate(batch):
        table[i, : len(words)] = [number.setdefault(w, len(number)) for w in words]
    for name, g in network.gradients(list(number), table, target).items():
        if isinstance(g, tuple):
            rows, where = np.unique(g[0], return_inverse=True)
            total = np.zeros((len(rows), g[1].shape[1]))
            np.add.at(total, where, g[1])
            squares[name][rows] += total**2
            network.p[name][rows] -= (RATE * total / np.sqrt(squares[name][rows] + 1e-8)).astype(np.float32)
        else:
            squares[name] += g**2
            network.p[name] -= (RATE * g / np.sqrt(squares[name] + 1e-8)).astype(np.float32)


def fit(documents: list[list[bytes]], toxic: np.ndarray, kept_out: np.ndarray, seed: int = 5) -> Network:
    """Train the network on texts that are not kept out, and calibrate it on those that are."""
    full = np.array([bool(d) for d in documents], bool)
    learn, check = np.flatnonzero(full & ~kept_out), np.flatnonzero(full & kept_out)
    some = toxic[full]
    if len(np.unique(toxic[learn])) < 2:
        network = start({}, np.zeros(0, np.float32), seed)
        network.constant = float(some.mean()) if len(some) else 0.0
        return network
    rng = np.random.default_rng(seed)
    mine = [documents[i] for i in learn]
    y = toxic[learn]
    vocabulary, odds = _log_odds(mine, y)
    network = start(vocabulary, odds, seed)
    squares = {k: np.zeros_like(v, dtype=np.float64) for k, v in network.p.items()}
    weight = np.append(0, np.maximum(odds, 0))
    for turn in range(ROUNDS):
        if turn == 0:
            of = np.concatenate([np.full(len(windows_of(len(d))), i) for i, d in enumerate(mine)])
            place = np.concatenate([np.arange(len(windows_of(len(d)))) for d in mine])
            value = np.array([
                sum(weight[vocabulary.get(w, 0)] for w in set(_window_words(mine[i], k)))
                for i, k in zip(of, place)
            ])
        else:
            value, of, place = Scorer(network).windows(mine)
        order = np.lexsort((-value, of))
        first = order[np.flatnonzero(np.diff(of[order], prepend=-1))]
        worst = [(_window_words(mine[of[k]], place[k]), y[of[k]]) for k in first]
        clean = np.flatnonzero(y[of] == 0)
        plain = [(_window_words(mine[of[k]], place[k]), 0.0)
                 for k in rng.choice(clean, min(len(clean), 2 * len(first)), replace=False)]
        examples = worst + plain
        for _ in range(EPOCHS):
            order = rng.permutation(len(examples))
            for k in range(0, len(order), BATCH):
                batch = [examples[i] for i in order[k : k + BATCH]]
                _step(network, squares, [b[0] for b in batch], np.array([b[1] for b in batch], np.float32))
    check = check if len(np.unique(toxic[check])) == 2 else learn
    worst = np.concatenate([
        Scorer(network).worst([documents[i] for i in check[k : k + 200]]) for k in range(0, len(check), 200)
    ])
    network.slope, network.shift = logistic(worst, toxic[check])
    return network


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.2) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton's method, as if one text in ``1 / SHARE`` were toxic."""
    centre, scale = x.mean(), x.std() + 1e-6
    z = np.stack([(x - centre) / scale, np.ones_like(x)], axis=1)
    weight = np.where(y == 1, SHARE / max(y.sum(), 1), (1 - SHARE) / max((1 - y).sum(), 1)) * len(y)
    w = np.zeros(2)
    for _ in range(50):
        p = sigmoid(z @ w)
        g = z.T @ (weight * (p - y)) + penalty * w * [1, 0]
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([penalty, 1e-6])
        step = np.linalg.solve(hessian, g)
        w -= np.clip(step, -2, 2)
    return float(w[0] / scale), float(w[1] - w[0] * centre / scale)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Network:
    """Fit on a sample of the labelled documents, the same number of each label where possible."""
    toxic = F.when(F.col("toxic").isin(0, 1), F.col("toxic")).cast("int")
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), toxic.alias("toxic"))
    marks = sample(marks.where("toxic IS NOT NULL"), "toxic", rows)
    texts_of = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string"))
    found = (
        texts_of.join(F.broadcast(marks), "doc_id")  # at most the sample
        .groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
        .select("doc_id", "text", "toxic", hash48(F.col("doc_id")).alias("place")).toArrow()
    )
    found = found.take(pa.array(np.lexsort((found.column("doc_id").to_numpy(), found.column("place").to_numpy()))))
    documents = [words_of(t) for t in texts(found.column("text").combine_chunks())]
    return fit(
        documents, found.column("toxic").to_numpy().astype(np.float64),
        found.column("place").to_numpy() % 5 == 0,
    )


def predict(docs: DataFrame, network: Network) -> DataFrame:
    """``(doc_id, score)`` of each whole text."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string"))
    schema = "doc_id bigint, score double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(network)
        for part in slices(batches, limit=1 << 20):
            found = scorer.scores([words_of(t) for t in texts(part.column("text"))])
            yield table_of(schema, doc_id=part.column("doc_id"), score=pa.array(found))

    return small_batches(rows).mapInArrow(work, schema)


def score(docs: DataFrame, labels: DataFrame, parts: int = 3, rest: int = 1) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``: learn from rows not held out, score all rows."""
    held_out = is_held_out(F.col("doc_id"), parts, rest)
    network = train(docs.where(~held_out), labels.where(~held_out))
    return predict(docs, network).select(
        "doc_id", held_out.alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep(docs: DataFrame, labels: DataFrame, parts: int = 3, rest: int = 1) -> DataFrame:
    """The documents that are not toxic, with all their columns."""
    held_out = is_held_out(F.col("doc_id"), parts, rest)
    network = train(docs.where(~held_out), labels.where(~held_out))
    held: list[Scorer] = []

    def clean(part: pa.RecordBatch) -> np.ndarray:
        if not held:
            held.append(Scorer(network))
        return held[0].scores([words_of(t) for t in texts(part.column("text"))]) < THRESHOLD

    return filter_rows(docs, clean, limit=1 << 20)
