"""The lexicon's automaton against a dictionary, and all ids against the tokenizers library."""

import hashlib
import os
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyarrow import fs
from tokenizers import Tokenizer

from ratingloom.llm import bpe, lexicon, queries
from ratingloom.session import scratch_path

from . import odd
from .test_bpe import TEXTS
from .test_tokens import LITERALS

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def library():
    return Tokenizer.from_file(bpe.vocabulary(lexicon.VOCABULARY))


def merger():
    return lexicon.Merger(bpe.vocabulary(lexicon.VOCABULARY))


def random_words(rng, n):
    """Words of few letters with outputs that often agree on their first and last ids."""
    words = {bytes(rng.choice(list(b"abc"), rng.integers(0, 7))) for _ in range(n)}
    return sorted((w, tuple(w[k] - 96 for k in range(0, len(w), 2)) if len(w) % 3 else (7, *w[:1])) for w in words)


def states(start):
    found, todo = {id(start): start}, [start]
    while todo:
        for _, target in todo.pop().arcs.values():
            if id(target) not in found:
                found[id(target)] = target
                todo.append(target)
    return list(found.values())


def future(state):
    """All words from a state on with their ids."""
    out = {(b"", state.output)} if state.final else set()
    for byte, (ids, target) in state.arcs.items():
        out |= {(bytes([byte]) + w, ids + rest) for w, rest in future(target)}
    return frozenset(out)


@pytest.mark.parametrize("seed", range(6))
def test_automaton_is_minimal_and_exact(seed, tmp_path, spark):
    words = random_words(np.random.default_rng(seed), 20 * 4**seed if seed < 5 else 0)
    start = lexicon.minimal(words)
    assert future(start) == frozenset(words)
    futures = [future(s) for s in states(start)]
    assert len(set(futures)) == len(futures)  # no two states have the same future
    for state in states(start)[1:]:  # ids stand as early as they can
        said = [ids for ids, _ in state.arcs.values()] + [state.output] * state.final
        assert not os.path.commonprefix(said)
    lexicon.store(lexicon.flat(start), f"{tmp_path}/a/automaton.bin")
    mine = lexicon.Lexicon(f"{tmp_path}/a/automaton.bin")
    asked = [w for w, _ in words] + [b"", b"abcabcabc", b"x", "é".encode(), b"ab"]
    known, ids, lengths = mine.ids(asked)
    table, at = dict(words), 0
    assert known.tolist() == [w in table for w in asked]
    for w, n in zip([w for w in asked if w in table], lengths):
        assert tuple(ids[at : at + n].tolist()) == table[w]
        at += n
    assert at == len(ids) and len(mine.ids([])[0]) == 0


def test_a_file_without_a_local_path_is_read(tmp_path, monkeypatch):
    words = random_words(np.random.default_rng(1), 300)
    lexicon.store(lexicon.flat(lexicon.minimal(words)), f"{tmp_path}/automaton.bin")
    monkeypatch.setattr(lexicon, "file_system", lambda p: (fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem()), "automaton.bin"))
    known, _, lengths = lexicon.Lexicon("x").ids([w for w, _ in words])
    assert known.all() and lengths.tolist() == [len(i) for _, i in words]


ODD_BLANKS = [chr(c) for c in range(0x3001) if chr(c).isspace()] + ["\x1c", "᠎", "​", "﻿", "­"]


def texts_of(rng, n=1500):
    bits = ["<|endoftext|>", " ", "  ", "a", "word", ".", "!?", "\n", "é", "<|", "|>", "'s", "12", "\t", "東京", "Ж", "𝒳",
            "<|between words|>", "<|between", " words|>", "ꟲ", "\U0001e030", "½", "²", "Ⅷ", "_", "́", "\x00"]
    for _ in range(n):
        yield "".join(rng.choice(bits, rng.integers(1, 25)))
    for _ in range(n):
        yield "".join(rng.choice([*ODD_BLANKS, "a", "b!", "7", " ", "."], rng.integers(1, 14)))


@pytest.mark.parametrize("words", [[], [" word", "word", " a", "a", " b!", "<|endoftext|>", " .", " 東京"]])
def test_all_ids_are_the_library_s(tmp_path, words, monkeypatch):
    mine, model = merger(), library()
    rows = sorted((w.encode(), tuple(i.tolist())) for w, i in zip(words, mine.ids(words)))
    lexicon.store(lexicon.flat(lexicon.minimal(rows)), f"{tmp_path}/lexicon.bin")
    encoder = lexicon.Encoder(lexicon.Lexicon(f"{tmp_path}/lexicon.bin"), mine)
    texts = [t or "" for t in TEXTS] + LITERALS + list(texts_of(np.random.default_rng(5)))
    monkeypatch.setattr(lexicon, "MEMORY", 300)
    for at in range(0, len(texts), 250):
        part = texts[at : at + 250]
        ids, lengths = encoder.encode(part)
        ends = np.cumsum(lengths)
        got = [ids[e - n : e].tolist() for e, n in zip(ends, lengths)]
        assert got == [model.encode(t, add_special_tokens=False).ids for t in part]
        assert [lexicon.decode(mine, g) for g in got] == part
        assert [model.decode(g, skip_special_tokens=False) for g in got] == part
    assert mine.ranked and encoder.encode([])[0].tolist() == []


def test_words_are_counted_over_all_texts(spark):
    docs = spark.createDataFrame([(t,) for t in [*TEXTS, *TEXTS, "x" * 60 + " y"]], "text string")
    split, want = lexicon.splitter(), Counter()
    for t in [*TEXTS, *TEXTS, "x" * 60 + " y"]:
        if t is not None:
            first, *rest = split(t)
            want.update([first, *[" " + w for w in rest]])
    got = {bytes(r.word).decode(): r.n for r in lexicon.word_counts(docs).collect()}
    assert got == {w: n for w, n in want.items() if len(w.encode()) <= lexicon.LONGEST}
    path = scratch_path(spark, "lexicon-test") + ".bin"
    levels = sorted({int(np.floor(np.log2(n) * lexicon.STEPS)) for n in got.values() if n >= lexicon.LEAST}, reverse=True)
    frequent = []
    for level in levels:
        more = [w for w, n in got.items() if n >= lexicon.LEAST and int(np.floor(np.log2(n) * lexicon.STEPS)) == level]
        if len(frequent) + len(more) > 9:
            break
        frequent += more
    assert lexicon.compile_lexicon(docs, path, words=9) == len(frequent) > 3
    assert lexicon.Lexicon(path).ids([w.encode() for w in frequent])[0].all()
    assert not lexicon.Lexicon(path).ids([w.encode() for w in got if w not in frequent])[0].any()
    assert lexicon.compile_lexicon(docs, path, words=0) == 0


def digests(model, text):
    ids = model.encode(text or "", add_special_tokens=False).ids
    decoded = model.decode(ids, skip_special_tokens=False)
    return (
        len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
    )


def test_op12_is_the_library(spark):
    model = library()
    rows = queries.op12_lexicon_bpe(spark, SF_DIR).collect()
    documents = duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == {i: digests(model, t) for i, t in documents}
    assert len(rows) == len(documents)


def test_odd_rows(spark):
    model = library()
    docs = odd.documents(spark)
    got = sorted(tuple(r) for r in lexicon.digests(docs).fillna(-1, ["doc_id"]).collect())
    assert got == sorted((r.doc_id, *digests(model, r.text)) for r in docs.fillna(-1, ["doc_id"]).collect())
    assert lexicon.digests(odd.empty(spark)).count() == 0
    path = scratch_path(spark, "lexicon-test") + ".bin"
    lexicon.compile_lexicon(docs, path)
    lists = lexicon.encode(docs, path).where("doc_id = 5").first()
    assert lists.ids == model.encode("one two three four", add_special_tokens=False).ids
