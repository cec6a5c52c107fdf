import hashlib
import os

import duckdb
import pytest

from ratingloom.llm import bpe

from . import odd

TEXTS = [
    "a" * 3000, "x  b\n\n  c " * 300, " " * 2000, "\n" * 999 + "b", "東京都に行く。" * 300,
    "don't we'll 123\t\t 45 " * 200, "", None, "a\x1cb \x1f c  d" * 200, "<|endoftext|> " * 99,
]


@pytest.mark.parametrize("chunk, overlap", [(50, 10), (97, 31), (4096, 256)])
def test_stitched_chunks_are_the_library_s_ids(spark, chunk, overlap):
    model = bpe.encoder(bpe.vocabulary())
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    got = {r.doc_id: bpe.unpacked(r.ids).tolist() for r in bpe.encode(docs, None, chunk, overlap).collect()}
    assert got == {i: model.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("chunk, overlap", [(1, 1), (7, 3), (64, 16), (bpe.PIECE, bpe.PIECE_OVERLAP)])
def test_runs_in_a_task_are_the_library_s_ids(chunk, overlap):
    pieces = bpe.Pieces(bpe.vocabulary())
    for text in [t or "" for t in TEXTS]:
        runs = bpe.stitched(text, pieces.finder, pieces.blank, chunk, overlap)
        assert "".join(runs) == text
        assert [i for r in runs for i in pieces.model.encode_ordinary(r)] == pieces.model.encode_ordinary(text)


def test_documents_pass_through_stitching():
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    texts = [t for (t,) in duckdb.sql(f"SELECT text FROM '{folder}/documents.parquet' WHERE text IS NOT NULL").fetchall()]
    pieces = bpe.Pieces(bpe.vocabulary())
    runs = [(len(t), len(bpe.stitched(t, pieces.finder, pieces.blank))) for t in texts]
    long = [(n, r) for n, r in runs if n > bpe.PIECE + bpe.PIECE_OVERLAP]
    assert len(long) > 20 and all(r > 1 for _, r in long)
    assert sum(r for _, r in long) >= 0.9 * sum(n / bpe.PIECE for n, _ in long)


def test_round_trip(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    got = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(docs, None, 500, 50)).collect()}
    assert got == {i: (t or "").encode() for i, t in enumerate(TEXTS)}


def test_odd_rows(spark):
    model = bpe.encoder(bpe.vocabulary())
    docs = odd.documents(spark)
    got = sorted(tuple(r) for r in bpe.digests(docs).fillna(-1, ["doc_id"]).collect())
    want = []
    for r in docs.fillna(-1, ["doc_id"]).collect():
        ids = model.encode_ordinary(r.text or "")
        want.append((
            r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256((r.text or "").encode()).hexdigest(),
        ))
    assert got == sorted(want)
    assert bpe.digests(odd.empty(spark)).count() == 0


def test_chunks_that_never_meet_become_one_run(spark):
    text = "word " * 30 + "z" * 500 + " more words" * 30
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    stitched = bpe._stitch(bpe._chunks(docs, 100, 10), 10).orderBy("at").collect()
    assert any(r.skip is None for r in stitched)
    assert len({r.run for r in stitched}) < len(stitched)
