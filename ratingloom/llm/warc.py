"""WARC archives: a writer with revisit records, and a sequential reader that verifies everything.

Every record is one gzip member. The writer streams the pages of a task into archives of bounded
size; of pages with equal payloads the one with the largest id is stored as a ``response``, the
others as ``revisit`` records that name it and carry no payload. The reader walks an archive once:
it inflates member by member in small steps, cuts records by their ``Content-Length``, and checks
the block and payload digests.

Archives are opened through pyarrow's file systems, under the shared folder of the session. A task
writes under a name of its own attempt and lists the file in its output; a lost or repeated attempt
leaves a file that nothing lists.

Defined cases: a null page text is an empty payload; null addresses are left out; of rows that share
the largest id of an equal payload each is a response; a null id is smaller than any other, and such
rows are responses if no other row has their payload; an empty table gives no archives and an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.llm.common import ship, slices, small_batches, table_of, texts
from ratingloom.session import materialize, scratch_path

ship(__name__)

#: An archive is closed when its compressed size reaches this.
ARCHIVE_BYTES = 64 << 20
#: Compressed bytes that the reader inflates at once.
STEP = 1 << 16

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def file_system(path: str):
    """pyarrow's file system for a path or URI, and the path inside it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    lines = [*headers, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in lines)
    body = b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(body) + packer.flush()


def page_record(page_id, url, payload: bytes, payload_digest: str, refers_to) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    headers = [
        ("WARC-Type", kind), ("WARC-Date", DATE),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"),
        ("WARC-Payload-Digest", f"sha1:{payload_digest}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if url is not None:
        headers.append(("WARC-Target-URI", " ".join(url.split())))
    if refers_to is not None:
        headers += [("WARC-Profile", REVISIT), ("X-Refers-To-Page-Id", str(refers_to))]
    return record(headers, HTTP + (payload if refers_to is None else b""))


def mark_revisits(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, payload_digest, refers_to)``: ``refers_to`` is null for responses.

    Only digests that occur more than once are joined back, so most pages meet an empty table side;
    a digest that very many pages share is split by the skew join.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("text"),
    )
    key = F.sha1(F.col("text").cast("binary"))
    shared = rows.groupBy(key.alias("key")).agg(
        F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n")
    )
    shared = materialize(shared.where("n > 1 AND largest IS NOT NULL").drop("n"), "shared-payloads")
    marked = rows.withColumn("key", key).join(shared, "key", "left")
    return marked.select(
        "page_id", "url", "text",
        F.when(F.coalesce("page_id", F.lit(-1 << 63)) < F.col("largest"), F.col("largest")).alias("refers_to"),
    )


def write(pages: DataFrame, path: str) -> DataFrame:
    """Write the pages into archives under ``path``; the manifest has ``(path, records, bytes)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(path)
        system.create_dir(root, recursive=True)
        out, done = None, []

        def close():
            out[0].close()
            done.append((f"{path}/{out[1]}", out[2], out[3]))

        for part in slices(batches):
            ids, urls, refs = (part.column(c).to_pylist() for c in ("page_id", "url", "refers_to"))
            for page_id, url, payload, ref in zip(ids, urls, texts(part.column("text")), refs):
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out = [system.open_output_stream(f"{root}/{name}", compression=None), name, 0, 0]
                data = page_record(page_id, url, payload, digest(payload), ref)
                out[0].write(data)
                out[2], out[3] = out[2] + 1, out[3] + len(data)
                if out[3] >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield table_of(
            "path string, records long, bytes long",
            path=pa.array([d[0] for d in done], pa.string()),
            records=pa.array([d[1] for d in done], pa.int64()),
            bytes=pa.array([d[2] for d in done], pa.int64()),
        )

    manifest = small_batches(mark_revisits(pages)).mapInArrow(run, "path string, records long, bytes long")
    return materialize(manifest, "warc-manifest")


def members(stream) -> Iterator[bytes]:
    """The inflated gzip members of a stream, one at a time, read in small steps."""
    data = stream.read(STEP)
    while data:
        inflater, out = zlib.decompressobj(31), bytearray()
        while True:
            out += inflater.decompress(data)
            if inflater.eof:
                data = inflater.unused_data or stream.read(STEP)
                break
            data = stream.read(STEP)
            if not data:
                raise ValueError("the archive ends inside a gzip member")
        yield bytes(out)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of the record in a member, verified."""
    head, gap, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    length = int(headers["content-length"])
    block, end = rest[:length], rest[length:]
    if len(block) != length or end != b"\r\n\r\n":
        raise ValueError("Content-Length does not frame the record")
    if headers.get("warc-block-digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}":
        raise ValueError("the block does not match its digest")
    return headers, block


def payload_of(headers: dict[str, str], block: bytes) -> bytes | None:
    """The payload behind the HTTP headers, verified; None for a revisit."""
    if headers["warc-type"] != "response":
        return None
    payload = block.partition(b"\r\n\r\n")[2]
    if headers["warc-payload-digest"] != f"sha1:{digest(payload)}":
        raise ValueError("the payload does not match its digest")
    return payload


RECORDS = (
    "page_id long, url string, payload binary, payload_bytes long, payload_digest string,"
    " record_type string, refers_to long"
)


def read(spark: SparkSession, archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives listed in ``archives(path)``, one row each, in a task per archive.

    ``with_payload=False`` verifies the payloads and leaves them out.
    """
    chars = pa.string()

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, inside = file_system(path)
                with system.open_input_stream(inside, compression=None) as stream:
                    for member in members(stream):
                        headers, block = parse(member)
                        payload = payload_of(headers, block)
                        length = int(headers["x-payload-length"])
                        if payload is not None and len(payload) != length:
                            raise ValueError("the payload does not have its length")
                        page, ref = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
                        rows.append((
                            None if page is None else int(page), headers.get("warc-target-uri"),
                            payload if with_payload else None, length,
                            headers["warc-payload-digest"].removeprefix("sha1:"),
                            headers["warc-type"], None if ref is None else int(ref),
                        ))
                        held += len(member)
                        if held >= (4 << 20):
                            yield batch_of(rows)
                            rows, held = [], 0
        yield batch_of(rows)

    def batch_of(rows):
        kinds = [pa.int64(), chars, pa.binary(), pa.int64(), chars, chars, pa.int64()]
        columns = list(zip(*rows)) or [()] * 7
        names = [c.split()[0] for c in RECORDS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    files = max(1, archives.count())
    return archives.select("path").repartition(files).mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to fresh archives in the shared folder and read their records back."""
    spark = pages.sparkSession
    manifest = write(pages, scratch_path(spark, "warc"))
    return read(spark, manifest, with_payload=False).drop("payload")
