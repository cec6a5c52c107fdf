"""Byte-level BPE with a public rank file: overlapping chunks, stitched where pre-tokens meet again.

A pre-tokeniser's next boundary depends only on the text from the last boundary on. So a long text is
cut into chunks that overlap, each chunk is pre-tokenised on its own, in parallel, and two
neighbours are stitched at the first boundary that both have inside their overlap: from there on the
right chunk is in step with the whole text. The runs between stitches are then encoded in parallel.
A boundary counts only behind a character that is not white space, since the pattern looks ahead of
white space. Where two chunks do not meet, nothing is known of the chunks behind them, so the rest of
the text becomes one run: exact, but no longer parallel. Decoding concatenates the raw bytes of the ids.

Every text goes this way. Chunks of ``PIECE`` characters are stitched and encoded in the task that has
the text, so no run is long and none waits for a whole text; a text over ``CHUNK`` characters is first dealt to
tasks in chunks of that size, by the same rule. A text of one piece has nothing to stitch.

Defined cases: a null text is empty and has no ids; rows with equal ids stay apart, each is a row of
its own; an empty table gives an empty result; other columns are ignored, or kept if asked for.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratingloom.llm.common import ship, slices, small_batches, table_of

ship(__name__)

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters of a chunk that is dealt to a task of its own, and of the overlap with the next one.
CHUNK, OVERLAP = 65_536, 1_024
#: Characters of a chunk inside a task, and of its overlap.
PIECE, PIECE_OVERLAP = 2_048, 192
#: White space by Unicode's property, which is what the rank files' pattern means.
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def vocabulary(name: str = RANKS) -> str:
    """The place of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str):
    """The byte-pair encoder for a rank file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def pre_tokeniser():
    """The pattern with its white space spelt out, for the ``regex`` module."""
    import public_tokenizers
    import regex

    pattern = public_tokenizers.PATTERN
    pattern = pattern.replace(r"[^\s", f"[^{BLANK}").replace(r"\s", f"[{BLANK}]")
    return regex.compile(pattern.replace(r"\S", f"[^{BLANK}]"))


def boundaries(text: str, finder, blank) -> np.ndarray:
    """Offsets in ``text`` at which a pre-token ends behind a character that is not white space."""
    ends = [m.end() for m in finder.finditer(text)]
    return np.array([e for e in ends if not blank.match(text[e - 1])], np.int64)


def stitched(text: str, finder, blank, chunk: int = PIECE, overlap: int = PIECE_OVERLAP) -> list[str]:
    """The runs of a text: chunks are pre-tokenised apart and cut where neighbours first agree."""
    cuts, tail = [0], set()
    for start in range(0, len(text), chunk) if len(text) > chunk else ():
        part = text[start : start + chunk + overlap]
        ends = [m.end() for m in finder.finditer(part)]
        # What ends with the part may go on behind it.
        sure = lambda low, high: [e for e in ends if low <= e <= high and e < len(part) and not blank.match(part[e - 1])]
        if start:
            met = [e for e in sure(0, overlap) if e in tail]
            if not met:
                break
            cuts.append(start + met[0])
        tail = {e - chunk for e in sure(chunk, len(part))}
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


def packed(ids: list[int]) -> bytes:
    return np.asarray(ids, np.uint32).astype("<u4").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4")


class Pieces:
    """Encodes texts run by run."""

    def __init__(self, path: str):
        import regex

        self.model, self.finder, self.blank = encoder(path), pre_tokeniser(), regex.compile(f"[{BLANK}]")

    def encode(self, text: str) -> bytes:
        runs = stitched(text, self.finder, self.blank)
        return b"".join([packed(self.model.encode_ordinary(run)) for run in runs])


def encode(
    docs: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP,
    finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None,
    schema: str = "doc_id bigint, ids binary",
) -> DataFrame:
    """``(doc_id, ids)``: the ids of each text, packed as little-endian 32-bit integers.

    ``finish`` may turn each batch of that result into something narrower in the same Python task,
    with ``schema`` as its columns.
    """
    path = path or vocabulary()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string"))
    long = F.coalesce(F.char_length("text"), F.lit(0)) > chunk
    finish = finish or (lambda batch: batch)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for part in slices(batches):
            ids = pa.array([pieces.encode(t or "") for t in part.column("text").to_pylist()], pa.binary())
            yield finish(pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"]))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array([b"".join(runs) for runs in batch.column("runs").to_pylist()], pa.binary())
            yield finish(pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"]))

    short = small_batches(rows.where(~long)).mapInArrow(whole, schema)
    runs = _encode_runs(_stitch(_chunks(rows.where(long), chunk, overlap), overlap), path)
    whole_again = runs.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.transform(F.array_sort(F.collect_list(F.struct("run", "ids"))), lambda r: r["ids"]).alias("runs"),
    )
    return short.unionByName(whole_again.select("doc_id", "runs").mapInArrow(joined, schema))


def _chunks(rows: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Chunks of long texts: ``(row, doc_id, at, head, text)``; ``head`` are the characters before
    the next chunk begins, ``text`` has the overlap too."""
    schema = "row string, doc_id bigint, at int, head int, text string"

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        count = 0
        for part in slices(batches):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                count += 1
                row = f"{task.partitionId()}-{count}"
                starts = list(range(0, len(text), chunk))
                yield table_of(
                    schema, row=pa.array([row] * len(starts), pa.string()),
                    doc_id=pa.array([doc_id] * len(starts), pa.int64()),
                    at=pa.array(range(len(starts)), pa.int32()),
                    head=pa.array([min(chunk, len(text) - s) for s in starts], pa.int32()),
                    text=pa.array([text[s : s + chunk + overlap] for s in starts], pa.string()),
                )

    return rows.mapInArrow(run, schema)


def _stitch(chunks: DataFrame, overlap: int) -> DataFrame:
    """Add ``run`` (of chunks that belong together) and ``skip``, where the run begins in its chunk.

    ``left`` are the boundaries in a chunk's tail and ``right`` those in the next one's head, both
    counted from where the next chunk begins. The last characters of a chunk cannot be trusted,
    because a pre-token may go on behind them, so the boundary at the very end does not count.
    """
    schema = (
        "row string, doc_id bigint, at int, head int, text string,"
        " first array<int>, tail array<int>"
    )

    def run(batches):
        import regex

        finder, blank = pre_tokeniser(), regex.compile(f"[{BLANK}]")
        for part in slices(batches):
            first, tail = [], []
            for text, head in zip(part.column("text").to_pylist(), part.column("head").to_pylist()):
                ends = boundaries(text, finder, blank)
                ends = ends[ends < len(text)]
                first.append(ends[ends <= overlap].astype(np.int32))
                tail.append((ends[ends >= head] - head).astype(np.int32))
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (first, tail)]
            yield pa.RecordBatch.from_arrays([*part.columns, *lists], schema_names(schema))

    spread = chunks.repartition("row", "at")
    order = Window.partitionBy("row").orderBy("at")
    cut = spread.mapInArrow(run, schema)
    met = F.array_min(F.array_intersect(F.lag("tail").over(order), "first"))
    cut = cut.withColumn("skip", F.when(F.col("at") == 0, F.lit(0)).otherwise(met)).drop("first", "tail")
    apart = F.count(F.when(F.col("skip").isNull(), 1)).over(order)
    cut = cut.withColumn("skip", F.when(apart == 0, F.col("skip")))
    return cut.withColumn("run", F.count("skip").over(order))


def schema_names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(",")]


def _encode_runs(stitched: DataFrame, path: str) -> DataFrame:
    """``(row, doc_id, run, ids)``: a run's text goes from its own stitch to the next run's."""
    order = Window.partitionBy("row").orderBy("run")
    runs = stitched.groupBy("row", "run").agg(
        F.first("doc_id").alias("doc_id"), F.max("skip").alias("skip"),
        F.array_sort(F.collect_list(F.struct("at", "head", "text"))).alias("parts"),
    )
    runs = runs.withColumn("more", F.coalesce(F.lead("skip").over(order), F.lit(0)))
    schema = "row string, doc_id bigint, run bigint, ids binary"

    def run(batches):
        pieces = Pieces(path)
        for batch in batches:
            out = []
            for parts, skip, more in zip(*(batch.column(c).to_pylist() for c in ("parts", "skip", "more"))):
                text = "".join(p["text"][: p["head"]] for p in parts[:-1])
                text += parts[-1]["text"][: parts[-1]["head"] + more]
                out.append(pieces.encode(text[skip:]))
            yield table_of(
                schema, row=batch.column("row"), doc_id=batch.column("doc_id"),
                run=batch.column("run"), ids=pa.array(out, pa.binary()),
            )

    runs = runs.select("row", "doc_id", "run", "skip", "more", "parts").repartition("row", "run")
    return runs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, ids, decoded)``: the bytes of the ids, one behind the other."""
    path = path or vocabulary()
    schema = "doc_id bigint, ids binary, decoded binary"

    def run(batches):
        model = encoder(path)
        for part in slices(batches, "ids"):
            out = [decode_bytes(model, ids) for ids in part.column("ids").to_pylist()]
            yield table_of(
                schema, doc_id=part.column("doc_id"), ids=part.column("ids"),
                decoded=pa.array(out, pa.binary()),
            )

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


def decode_bytes(model, ids: bytes) -> bytes:
    return model.decode_bytes(unpacked(ids).tolist())


DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: each text encoded, decoded and digested.

    The ids never leave the Python task that made them: encoding, decoding and digests are one step.
    """
    path = path or vocabulary()
    held = {}

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            model = encoder(path)
            held["model"], held["names"] = model, [str(i) for i in range(model.n_vocab)]
        model, names = held["model"], held["names"]
        counts, of_ids, of_bytes = [], [], []
        for data in batch.column("ids").to_pylist():
            ids = unpacked(data).tolist()
            counts.append(len(ids))
            of_ids.append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
            of_bytes.append(hashlib.sha256(model.decode_bytes(ids)).hexdigest())
        return table_of(
            DIGESTS, doc_id=batch.column("doc_id"), n_tokens=pa.array(counts, pa.int64()),
            ids_sha256=pa.array(of_ids, pa.string()), decoded_sha256=pa.array(of_bytes, pa.string()),
        )

    return encode(docs, path, finish=finish, schema=DIGESTS)
