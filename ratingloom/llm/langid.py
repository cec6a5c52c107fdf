"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are its runs of two to four bytes without white space inside, with the word
boundary as a space; letters of ASCII are lowered and its other characters count as boundaries. Each
run is hashed to a row of an embedding table, the rows are averaged over the whole text, and a linear
softmax names the language. Table and softmax are trained together by stochastic gradient descent.

The model is fitted on the driver from a sample of labelled rows: about ``TRAIN_ROWS`` documents in
all, the same number for each language as far as there are so many, and a few short excerpts of each,
so that short texts are known too. A fifth of the sample is kept out of the descent; on it the
probabilities are calibrated by a temperature, and the rejection threshold is the lowest one at which
the accepted texts are right with ``PRECISION``.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is everything if
there is no labelled row; with one language all texts with letters are of it; ties go to the first
language in code-point order; repeated rows get the same answer; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratingloom.llm.common import hash48, ship, slices, small, small_batches, table_of, texts
from ratingloom.session import materialize

ship(__name__)

UNKNOWN = "und"
#: Labelled documents in the sample, about; the model sees no more, however large the corpus.
TRAIN_ROWS = 2_400
#: Words of the excerpts that are taken from each training text.
EXCERPTS = (2, 8, 30)
BUCKETS, DIM = 1 << 16, 12
EPOCHS, RATE = 4, 0.6
PRECISION = 0.99
SIZES = (2, 3, 4)
#: Bytes of text that are worked on at once.
PIECE = 1 << 20


def byte_classes() -> bytes:
    """ASCII letters lowered, other ASCII turned into spaces, other bytes kept."""
    table = bytearray(range(256))
    for i in range(128):
        c = chr(i)
        table[i] = ord(c.lower()) if c.isalpha() else 32
    return bytes(table)


def subwords(documents: list[bytes], table: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size of run: the bucket of every run, and the document each belongs to."""
    joined = b"".join(b" " + d.translate(table) + b" " for d in documents)
    data = np.frombuffer(joined, np.uint8).astype(np.uint32)
    lengths = np.array([len(d) + 2 for d in documents])
    ends = np.cumsum(lengths)
    space = data == 32
    value = data
    for size in range(2, max(SIZES) + 1):
        value = (value[:-1] << np.uint32(8)) | data[size - 1 :]
        if size not in SIZES:
            continue
        n = len(value)
        good = ~space[1 : 1 + n] if size > 2 else ~(space[:n] & space[1:])
        for k in range(2, size - 1):
            good &= ~space[k : k + n]
        at = np.flatnonzero(good)
        hashed = (value[at] + np.uint32(size)) * np.uint32(2654435769)
        hashed ^= hashed >> np.uint32(15)
        hashed *= np.uint32(2246822519)
        yield (hashed >> np.uint32(16)).astype(np.int64) % BUCKETS, np.searchsorted(ends, at, "right")


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # of a subword's contribution to each language's logit
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        scaled = logits / self.temperature
        scaled = np.exp(scaled - scaled.max(axis=1, keepdims=True))
        return scaled / scaled.sum(axis=1, keepdims=True)

    def logits(self, documents: list[bytes], classes: bytes) -> np.ndarray:
        """Average contribution of all subwords of each document, plus the bias."""
        n = len(documents)
        sums, counts = np.zeros((n, len(self.languages))), np.zeros(n)
        for bucket, of in subwords(documents, classes):
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            if len(starts):
                sums[of[starts]] += np.add.reduceat(self.table[bucket], starts, axis=0)
                counts += np.bincount(of, minlength=n)
        return sums / np.maximum(counts, 1)[:, None] + self.bias


def is_held_out(doc_id: Column, parts: int, rest: int) -> Column:
    """Whether the CRC-32 of an id's text leaves ``rest``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == rest


def excerpts(text: bytes) -> list[bytes]:
    """The text, and runs of a few words of it at places that follow from its length."""
    words = text.split()
    found = [text]
    for size in EXCERPTS:
        if len(words) > size:
            at = (len(words) * 2654435769 + size * 40503) % (len(words) - size)
            found.append(b" ".join(words[at : at + size]))
    return found


def sample(docs: DataFrame, label: str, rows: int) -> DataFrame:
    """About ``rows`` rows with a label, the same number of each label where there are enough.

    An id is in the sample if its hash is small enough, so reruns agree. Of rows that repeat an id the
    smallest is taken, and rows without an id are not, so one id cannot fill the sample.
    """
    known = docs.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    counts = known.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    shares = counts.select(
        F.col(label).alias("_label"),
        (F.lit(float(rows)) / F.count(F.lit(1)).over(Window.partitionBy()) / F.col("n")).alias("_share"),
    )
    shares = small(materialize(shares, "shares"))  # a row per label: the texts stay where they are
    place = hash48(F.concat_ws("/", F.lit("sample"), F.col("doc_id").cast("string"))) / F.lit(float(1 << 48))
    chosen = known.join(shares, F.col(label) == F.col("_label")).where(place < F.col("_share"))
    others = [c for c in docs.columns if c != "doc_id"]
    least = chosen.groupBy("doc_id").agg(F.min(F.struct(*others)).alias("_row"))
    return least.select("doc_id", *[F.col(f"_row.{c}") for c in others])


def train(docs: DataFrame, rows: int = TRAIN_ROWS, seed: int = 11) -> Model | None:
    """Fit the model on a sample of ``docs(doc_id, text, lang)``; None without labelled rows.

    The executors turn the sampled texts into counts per bucket; the driver gets these only.
    """
    schema = "place bigint, lang string, bucket array<int>, weight array<float>"
    classes = byte_classes()

    def work(batches):
        for part in slices(batches, limit=PIECE):
            places, langs, buckets, weights = [], [], [], []
            columns = (part.column("place").to_pylist(), part.column("lang").to_pylist())
            for place, lang, text in zip(*columns, texts(part.column("text"))):
                for piece in excerpts(text):
                    found = np.concatenate([b for b, _ in subwords([piece], classes)])
                    if len(found):
                        bucket, count = np.unique(found, return_counts=True)
                        places.append(place)
                        langs.append(lang)
                        buckets.append(bucket.astype(np.int32))
                        weights.append((count / len(found)).astype(np.float32))
            yield table_of(
                schema, place=pa.array(places, pa.int64()), lang=pa.array(langs, pa.string()),
                bucket=pa.array(buckets, pa.list_(pa.int32())),
                weight=pa.array(weights, pa.list_(pa.float32())),
            )

    chosen = sample(docs.select("doc_id", "text", "lang"), "lang", rows)
    chosen = chosen.select(hash48(F.col("doc_id")).alias("place"), "lang", F.col("text").cast("string"))
    found = small_batches(chosen).mapInArrow(work, schema).toArrow()
    if found.num_rows == 0:
        return None
    order = np.argsort(found.column("place").to_numpy(), kind="stable")
    found = found.take(pa.array(order))
    languages = sorted(set(found.column("lang").to_pylist()), key=lambda x: x.encode())
    target = np.array([languages.index(x) for x in found.column("lang").to_pylist()])
    buckets = [np.asarray(b) for b in found.column("bucket").to_numpy()]
    weights = [np.asarray(w) for w in found.column("weight").to_numpy()]
    kept_out = found.column("place").to_numpy() % 5 == 0
    rng = np.random.default_rng(seed)
    embedding = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    linear, bias = np.zeros((len(languages), DIM), np.float32), np.zeros(len(languages), np.float32)
    learn = np.flatnonzero(~kept_out)
    steps, done = EPOCHS * max(len(learn), 1), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(learn):
            rate = RATE * (1 - done / steps)
            mean = weights[i] @ embedding[buckets[i]]
            logits = linear @ mean + bias
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[target[i]] -= 1
            back = error @ linear
            linear -= rate * np.outer(error, mean)
            bias -= 0.1 * rate * error
            # An average over many runs has a small gradient for each: scale it to the run's share.
            embedding[buckets[i]] -= (rate * len(buckets[i]) ** 0.5) * np.outer(weights[i], back)
            done += 1
    model = Model(languages, (embedding @ linear.T).astype(np.float32), bias.astype(np.float64), 1.0, 0.0)
    check = np.flatnonzero(kept_out)
    if len(check):
        logits = np.stack([weights[i] @ model.table[buckets[i]] for i in check]) + model.bias
        calibrate(model, logits, target[check])
    return model


def calibrate(model: Model, logits: np.ndarray, target: np.ndarray) -> None:
    """Set the temperature of least log loss, and the lowest threshold of the wanted precision."""
    def loss(t):
        model.temperature = t
        return -np.log(np.maximum(model.probabilities(logits)[np.arange(len(target)), target], 1e-12)).mean()

    model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
    p = model.probabilities(logits)
    best, right = p.max(axis=1), p.argmax(axis=1) == target
    order = np.argsort(-best, kind="stable")
    precision = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    fine = np.flatnonzero(precision >= PRECISION)
    model.threshold = float(best[order[fine[-1]]]) if len(fine) else 1.0


PREDICTED = "doc_id bigint, lang_pred string, score double, rejected boolean"


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, lang_pred, score, rejected)`` of each whole text.

    ``score`` is the calibrated probability of the language; ``rejected`` says that it is below the
    threshold, so that a caller who needs certainty may read the language as unknown.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string"))

    def work(batches):
        import regex

        letter, classes = regex.compile(r"\p{L}"), byte_classes()
        for part in slices(batches, limit=PIECE):
            n = part.num_rows
            readable = np.array([bool(t and letter.search(t)) for t in part.column("text").to_pylist()])
            name, score = np.full(n, UNKNOWN, object), np.zeros(n)
            rejected = np.ones(n, bool)
            if model is not None:
                p = model.probabilities(model.logits(texts(part.column("text")), classes))
                best = p.argmax(axis=1)
                score = np.where(readable, p.max(axis=1), 0.0)
                name = np.where(readable, np.array(model.languages, object)[best], UNKNOWN)
                rejected = score < model.threshold
            yield table_of(
                PREDICTED, doc_id=part.column("doc_id"), lang_pred=pa.array(name.tolist(), pa.string()),
                score=pa.array(np.clip(score, 0, 1)), rejected=pa.array(rejected | ~readable),
            )

    return small_batches(rows).mapInArrow(work, PREDICTED)


def identify(docs: DataFrame, parts: int = 5, rest: int = 0) -> DataFrame:
    """Learn from the rows that are not held out, predict all rows."""
    held_out = is_held_out(F.col("doc_id"), parts, rest)
    model = train(docs.where(~held_out))
    return predict(docs, model).select(
        "doc_id", is_held_out(F.col("doc_id"), parts, rest).alias("held_out"), "lang_pred", "score", "rejected"
    )
