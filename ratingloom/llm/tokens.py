"""Token files in ORC: ids of every document in ascending order of the document id.

ORC writes integers in run-length encodings, keeps minima and maxima per stripe and per row group
(the row index), and here a Bloom filter on the document id. So a reader takes stripes in parallel,
skips stripes and row groups by their metadata, and finds a document without reading the others.

Texts are dealt by ranges of the document id before they are encoded, so the ids are never
shuffled. Each file carries, per document, its place in the file and the ids before it in the file;
a sum per file turns these into the start in the whole corpus.

Defined cases: a null text has the end id only; null document ids come first; rows with the same id
are ordered by their texts; an empty table gives an empty result; other columns are ignored; the
literal of a special token is its id, as the vocabulary file has it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratingloom.llm import lexicon
from ratingloom.llm.bpe import vocabulary
from ratingloom.llm.common import ship, slices, small, small_batches
from ratingloom.session import materialize, scratch_path

ship(__name__)

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
ROWS_PER_INDEX = 1_000
STRIPE_BYTES = 16 << 20

FILE = "doc_id bigint, part int, place bigint, before bigint, ids array<int>"


class Encoder(lexicon.Encoder):
    """Ids of texts, each with the end id: words that a task knows are looked up, new ones are merged.

    With ``special`` the vocabulary's special tokens are read as the file has them, as in
    ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``: the literal ``<|endoftext|>``
    is one id. They hold no white space, so no cut falls into one. Without it they are plain text.
    """

    def __init__(self, path: str, special: bool = False):
        super().__init__(None, lexicon.Merger(path, special))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with the end id, and the length of each."""
        ids, lengths = super().encode(texts)
        ends = np.cumsum(lengths + 1) - 1
        out = np.full(len(ids) + len(ends), END_ID, np.int32)
        inside = np.ones(len(out), bool)
        inside[ends] = False
        out[inside] = ids
        return out, lengths + 1


def write(
    docs: DataFrame, path: str, vocabulary_path: str | None = None, special: bool = True
) -> None:
    """Encode the documents and write the token files, in ascending order of ``doc_id``.

    ``special=False`` encodes the literals of special tokens as plain text.
    """
    vocabulary_path = vocabulary_path or vocabulary(VOCABULARY)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        model, place, before = Encoder(vocabulary_path, special), 0, 0
        for piece in slices(batches):
            ids, lengths = model.encode([t or "" for t in piece.column("text").to_pylist()])
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            n = piece.num_rows
            columns = [
                piece.column("doc_id"), pa.array(np.full(n, part, np.int32)),
                pa.array(place + np.arange(n, dtype=np.int64)), pa.array(before + offsets[:-1]),
                pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
            ]
            place, before = place + n, before + int(offsets[-1])
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in FILE.split(", ")])

    (
        small_batches(ordered).mapInArrow(run, FILE)
        .write.option("orc.compress", "ZSTD")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", ROWS_PER_INDEX)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of token files: ``(doc_id, start, n_tokens, ids_crc32, part, place)``.

    Stripes are read in parallel. ``start`` counts the ids of all documents before this one.
    """
    found = spark.read.schema(FILE).orc(path)
    schema = "doc_id bigint, part int, place bigint, before bigint, n_tokens bigint, ids_crc32 bigint"

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            offsets = ids.offsets.to_numpy()
            values = ids.values.to_numpy()
            sums = [
                zlib.crc32(values[a:b].astype("<u4").tobytes()) for a, b in zip(offsets, offsets[1:])
            ]
            columns = [batch.column(i) for i in range(4)]
            columns += [pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    rows = materialize(found.mapInArrow(run, schema), "token-rows")
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return rows.join(small(materialize(bases, "token-bases")), "part").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32",
        "part", "place",
    )


def lookup(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """The ids of one document; the scan skips stripes and row groups by index and Bloom filter."""
    return spark.read.schema(FILE).orc(path).where(F.col("doc_id") == doc_id)


def round_trip(docs: DataFrame) -> DataFrame:
    """Write token files to the shared folder and read them back."""
    path = scratch_path(docs.sparkSession, "tokens")
    write(docs, path)
    return read(docs.sparkSession, path).drop("part", "place")
