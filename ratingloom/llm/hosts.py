"""Host-level quality rules: rule failures per host, shrunk by an empirical beta prior, joined back.

Every document is measured by simple rules. Failures are added up per host; a beta prior is fitted
to the hosts' failure rates by the method of moments, and each host's rate is pulled towards the
mean, the more the fewer documents it has. A host whose shrunk rate is above ``max_rate`` is
rejected with all its documents.

Defined cases: a null or empty text has no words and fails; a null host gets no verdict, its
documents stand on their own; repeated rows count each time; an empty table gives an empty result;
other columns of the input are ignored by :func:`judge` and kept unchanged by :func:`keep`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingloom.llm.common import filter_rows, map_texts, ship, small, table_of, texts
from ratingloom.session import materialize

ship(__name__)

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A host is rejected when its shrunk failure rate is above this.
MAX_RATE = 0.75
#: Bounds of the prior's weight, in documents; the upper one stands for hosts that do not differ.
PRIOR_LEAST, PRIOR_MOST = 1.0, 10_000.0

SIGNALS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def window_hashes(ids: np.ndarray, n: int, width: int) -> np.ndarray:
    """A 64-bit hash of each of the first ``n`` windows of a list of numbers."""
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    key = np.zeros(n, np.uint64)
    for k in range(width):
        key = key * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + n]
        key ^= key >> np.uint64(31)
    return key


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Number of words that lie in a window of ``width`` words found at least twice."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, len(words))
    key = window_hashes(ids, n, width)
    ordered = np.sort(key)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    a, b = order[1:][same], order[:-1][same]
    if not all((ids[a + k] == ids[b + k]).all() for k in range(width)):  # two windows, one hash
        rank = ids.astype(np.int64)
        for k in range(1, width):
            rank = rank[: len(ids) - k] * (len(numbers) + 1) + ids[k:].astype(np.int64)
            rank = np.unique(rank, return_inverse=True)[1]
        repeated = np.bincount(rank)[rank] > 1
    else:
        repeated = np.zeros(n, bool)
        repeated[a] = repeated[b] = True
    change = np.zeros(n + width, np.int64)
    change[:n] += repeated
    change[width:] -= repeated
    return int((np.cumsum(change) > 0).sum())


def measure(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    joined = b"".join(words)
    word_chars = len(joined.decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words), word_chars, symbols, len(lines) - len(set(lines)), repeated_words(words)
    )


def _measured(part: pa.RecordBatch) -> np.ndarray:
    found = [measure(t) for t in texts(part.column("text"))]
    return np.array(found, np.int64).reshape(-1, 5)


def _failed(found: np.ndarray) -> np.ndarray:
    return (found[:, 0] < MIN_WORDS) | (100 * found[:, 4] > MAX_REPEAT_PERCENT * found[:, 0])


def signals(docs: DataFrame, host: Column | str = "source") -> DataFrame:
    """``(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)``."""
    host = F.col(host) if isinstance(host, str) else host
    rows = docs.select("doc_id", host.cast("string").alias("host"), F.col("text").cast("string"))
    schema = f"doc_id bigint, host string, {SIGNALS}, base_failed boolean"

    def work(part):
        found = _measured(part)
        names = [s.split()[0] for s in SIGNALS.split(", ")]
        return table_of(
            schema, doc_id=part.column("doc_id"), host=part.column("host"),
            base_failed=_failed(found), **{n: found[:, i] for i, n in enumerate(names)},
        )

    return map_texts(rows.withColumn("doc_id", F.col("doc_id").cast("bigint")), work, schema)


def verdicts(measured: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """One row per host: ``(host, n_docs, n_failed, rate, rejected)`` with the shrunk rate.

    The counts of the hosts are written when this is called, and the beta prior is read from them:
    with ``m`` the pooled failure rate and ``rho`` the moment estimate of the correlation inside hosts,
    it weighs ``1/rho - 1`` documents.
    """
    hosts = measured.where("host IS NOT NULL").groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed")
    )
    hosts = materialize(hosts, "hosts")
    n, f = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    prior = hosts.agg(
        F.count(F.lit(1)).cast("double").alias("k"), F.sum(n).alias("n"), F.sum(f).alias("f"),
        F.sum(f * f / n).alias("ff"), F.sum(n * n).alias("nn"),
    )
    prior = prior.selectExpr(
        "f / n AS mean",
        "try_divide(try_divide(ff - f * f / n, f / n * (1 - f / n)) - (k - 1),"
        " n - nn / n - (k - 1)) AS rho",
    ).selectExpr(
        "mean",
        f"CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, {PRIOR_LEAST}D), {PRIOR_MOST}D)"
        f" ELSE {PRIOR_MOST}D END AS weight",
    )
    mean, weight = (F.lit(x).cast("double") for x in prior.first())  # two numbers
    rate = (F.col("n_failed") + weight * mean) / (F.col("n_docs") + weight)
    return hosts.withColumn("rate", rate).select(
        "host", "n_docs", "n_failed", "rate", (F.col("rate") > max_rate).alias("rejected")
    )


def judge(docs: DataFrame, host: Column | str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """The signals of each document with ``host_failed`` and ``kept``; one row per input row.

    The texts are read once; the narrow signals are written and read for the hosts and the join.
    """
    measured = materialize(signals(docs, host), "signals")
    rejected = materialize(
        verdicts(measured, max_rate).where("rejected").select("host"), "rejected-hosts"
    )
    bad = rejected.select("host", F.lit(True).alias("host_failed"))
    return (
        measured.join(small(bad), "host", "left")
        .withColumn("host_failed", F.coalesce("host_failed", F.lit(False)))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
    )


def keep(docs: DataFrame, host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """The documents that pass, with all their columns: texts are read twice and never shuffled
    unless there are more rejected hosts than a broadcast may hold."""
    rejected = materialize(
        verdicts(signals(docs, host), max_rate).where("rejected").select("host"), "rejected-hosts"
    )
    mine = docs.join(small(rejected), docs[host].cast("string") == rejected["host"], "left_anti")
    return filter_rows(mine, lambda part: ~_failed(_measured(part)))
