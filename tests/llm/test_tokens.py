import glob
import os
import zlib

import numpy as np
import pyarrow.orc as orc
from tokenizers import Tokenizer

from ratingloom.llm import bpe, tokens
from ratingloom.session import scratch_path

from . import odd
from .test_bpe import TEXTS


def library():
    model = Tokenizer.from_file(bpe.vocabulary(tokens.VOCABULARY))
    model.encode_special_tokens = True
    return model


def test_pieces_are_the_library_s_ids():
    more = ["  lead", "trail ", " ", "a  b   c", "x\n y", "a \nb", "tab\t x", "x　 y", "é ñ "]
    mine, model = tokens.Encoder(bpe.vocabulary(tokens.VOCABULARY)), library()
    texts = [t or "" for t in TEXTS + more]
    for _ in range(2):
        ids, lengths = mine.encode(texts)
        ends = np.cumsum(lengths)
        got = [ids[e - n : e].tolist() for e, n in zip(ends, lengths)]
        assert got == [model.encode(t, add_special_tokens=False).ids + [2] for t in texts]
        mine.forget()


#: The literal of the vocabulary's special token: alone, glued to words, between spaces and marks.
LITERALS = [
    "<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|>y", "a  <|endoftext|>  b", "<|endoftext|>.",
    "end.<|endoftext|> Next, <|endoftext|>! <|endoftext|><|endoftext|> 1<|endoftext|>2.", " <|endoftext|>",
    "a\n<|endoftext|>\n b", "<|endoftext|", "< |endoftext|>", "é<|endoftext|>\u3000 東京", "<|endoftext|> " * 99,
]


def test_literals_of_special_tokens_are_read_as_the_file_has_them(spark):
    path = bpe.vocabulary(tokens.VOCABULARY)
    model, mine = Tokenizer.from_file(path), tokens.Encoder(path, special=True)
    rng = np.random.default_rng(4)
    bits = ["<|endoftext|>", " ", "  ", "a", "word", ".", "!?", "\n", "é", "<|", "|>", "'s", "12", "\t"]
    texts = LITERALS + ["".join(rng.choice(bits, rng.integers(1, 25))) for _ in range(3000)]
    want = [model.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    for at in range(0, len(texts), 500):
        ids, lengths = mine.encode(texts[at : at + 500])
        ends = np.cumsum(lengths)
        assert [ids[e - n : e].tolist() for e, n in zip(ends, lengths)] == want[at : at + 500]
    assert want[1] == [64, 220, 50256, 275, 2]
    docs = spark.createDataFrame(list(enumerate(LITERALS)), "doc_id bigint, text string")
    start = 0
    for r in tokens.round_trip(docs).orderBy("doc_id").collect():
        ids = want[r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    plain = scratch_path(spark, "token-plain")
    tokens.write(docs, plain, special=False)
    got = {r.doc_id: r.ids for r in spark.read.schema(tokens.FILE).orc(plain).collect()}
    assert got == {i: library().encode(t, add_special_tokens=False).ids + [2] for i, t in enumerate(LITERALS)}


def test_odd_rows(spark):
    docs, model = odd.documents(spark), library()
    got = sorted(tuple(r) for r in tokens.round_trip(docs).fillna(-1, ["doc_id"]).collect())
    start, want = 0, []
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id, r.text or "")):
        ids = model.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((-1 if r.doc_id is None else r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want)
    assert tokens.round_trip(odd.empty(spark)).count() == 0


def test_files_are_in_order_and_can_be_looked_up(spark):
    docs = spark.range(3000).selectExpr("id * 7 % 3000 AS doc_id", "concat('text ', id) AS text")
    path = scratch_path(spark, "token-test")
    tokens.write(docs.repartition(4), path)
    ranges = []
    for name in glob.glob(os.path.join(path.removeprefix("file://"), "*.orc")):
        ids = orc.ORCFile(name).read(columns=["doc_id"]).column(0).to_pylist()
        assert ids == sorted(ids)
        ranges += [(ids[0], ids[-1])] if ids else []
    ranges.sort()
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    found = tokens.lookup(spark, path, 77)
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,77)]" in found._jdf.queryExecution().toString()
    text = f"text {next(i for i in range(3000) if i * 7 % 3000 == 77)}"
    assert [r.ids for r in found.collect()] == [library().encode(text, add_special_tokens=False).ids + [2]]
