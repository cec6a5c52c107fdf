"""Byte-level BPE by a lexicon of frequent words: a minimal acyclic transducer, mapped into memory.

A *word* is a space with what follows it up to the next cut; a text is cut before every space that
follows a character other than white space. The vocabulary's pattern always ends a pre-token there, and
nothing before it looks further, so the ids of a text are those of its words, one after the other.

1. All words of the corpus are counted (in every task first, then by a shuffle of words and counts).
2. The most frequent ones, ``WORDS`` at most, reach the driver, are merged and compiled into a transducer: a
   histogram of the counts tells from which count on words fit. Sorted words share prefixes, states with equal futures are one state, and ids stand on
   arcs as early as all words through the arc agree on them, so that endings can be shared.
3. The automaton is a file of flat arrays in the shared folder. Tasks map it into memory (a file system
   without local paths is read instead) and look up all new words of a slice of texts at once, byte by byte.
4. Words that the lexicon lacks are merged exactly, by the ranks of the vocabulary. A task remembers what
   it has merged, up to ``MEMORY`` words, beyond which it starts anew.

So the lexicon decides how fast a word is encoded and never how. Words with the literal of a special
token, and words with characters beyond ``PLAIN``, whose classes differ between versions of Unicode, go
to the tokenizers library itself.

Defined cases: a null text is empty and has no ids; rows with equal ids are rows of their own; a null id is
kept; an empty table has an empty lexicon and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.llm.bpe import vocabulary
from ratingloom.llm.common import ship, slices, small_batches, table_of
from ratingloom.llm.warc import file_system
from ratingloom.session import materialize, scratch_path

ship(__name__)

VOCABULARY = "byte_bpe_50k.json"
#: Words of the lexicon at most: frequent ones that occur ``LEAST`` times at least, of up to ``LONGEST`` bytes.
WORDS, LEAST, LONGEST = 65_536, 3, 48
#: Steps of the histogram of counts in each doubling.
STEPS = 32
#: Merged words that a task remembers.
MEMORY = 400_000
#: Words with a character from here on are left to the library.
PLAIN = "԰"

#: A space behind a character that is not white space, in any sense of the word.
CUT = r"(?<=[^\s\x1c-\x1f\x85]) "


def byte_of_char() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Merger:
    """Ids of words, exactly as the tokenizers library has them for the vocabulary file.

    ``special=False`` reads the literals of special tokens as plain text.
    """

    #: Words that are merged in one call.
    JOINED = 4_000

    def __init__(self, path: str, special: bool = True):
        import os

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task per core
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not special
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        byte, vocab = byte_of_char(), model["model"]["vocab"]
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items()}
        self.special = [t["content"] for t in model["added_tokens"]]
        #: The bytes of every id; a special token's are its literal.
        self.bytes_of = {i: token for token, i in ranks.items()}
        self.bytes_of |= {t["id"]: t["content"].encode() for t in model["added_tokens"]}
        # The ids must be in the order of the merges, for ranks to be ids.
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["model"]["merges"]]
        in_order = [vocab[m] for m in merged]
        self.ranked = in_order == sorted(in_order) and model["pre_tokenizer"].get("use_regex", True)
        self.end = max(self.bytes_of) + 1
        self.mark = "<|between words|>"
        self.merge = tiktoken.Encoding(
            path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={self.mark: self.end}
        )

    def ids(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        plain, other = [], []
        for k, word in enumerate(words):
            odd = not self.ranked or not word.isascii() and max(word) >= PLAIN
            odd = odd or "<|" in word and any(s in word for s in [*self.special, self.mark])
            (other if odd else plain).append(k)
        for at in range(0, len(plain), self.JOINED):
            part = plain[at : at + self.JOINED]
            found = self.merge.encode(self.mark.join([words[k] for k in part]), allowed_special="all")
            row = np.array(found, np.int32)
            ends = np.append(np.flatnonzero(row == self.end), len(row))
            for k, a, b in zip(part, [0, *(ends[:-1] + 1)], ends):
                out[k] = row[a:b]
        found = self.library.encode_batch_fast([words[k] for k in other], add_special_tokens=False)
        for k, encoding in zip(other, found):
            out[k] = np.array(encoding.ids, np.int32)
        return out


class _State:
    __slots__ = ("arcs", "final", "output")

    def __init__(self):
        self.arcs: dict[int, list] = {}  # byte: [output, target]
        self.final, self.output = False, ()

    def future(self) -> tuple:
        return self.final, self.output, tuple((c, o, id(t)) for c, (o, t) in self.arcs.items())


def shared_prefix(a: tuple, b: tuple) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def minimal(words: list[tuple[bytes, tuple[int, ...]]]) -> _State:
    """The start state of the minimal transducer of sorted, distinct words with their ids.

    Only the states along the word before are still open; the others are closed, and a closed state
    is the one with the same future if there is one. Ids that a new word does not share are pushed from
    its common prefix with the word before to what lies behind it.
    """
    closed: dict[tuple, _State] = {}
    path, before = [_State()], b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            state = path.pop()
            arc = path[-1].arcs[before[len(path) - 1]]
            arc[1] = closed.setdefault(state.future(), state)

    for word, ids in words:
        common = shared_prefix(word, before)
        close(common)
        for k in range(common):
            arc = path[k].arcs[word[k]]
            n = shared_prefix(arc[0], ids)
            rest, arc[0], ids = arc[0][n:], arc[0][:n], ids[n:]
            if rest:
                below = path[k + 1]
                for other in below.arcs.values():
                    other[0] = rest + other[0]
                if below.final:
                    below.output = rest + below.output
        for byte in word[common:]:
            path[-1].arcs[byte] = [(), None]
            path.append(_State())
        path[-1].final = True
        if common < len(word):
            path[common].arcs[word[common]][0] = ids
        else:
            path[-1].output = ids
        before = word
    close(0)
    return path[0]


#: The arrays of a stored automaton, in the order of the file, with their types.
ARRAYS = (
    ("keys", np.int64), ("targets", np.int32), ("arc_ids", np.int32), ("state_ids", np.int32), ("pool", np.int32),
    ("final", np.int8),
)


def flat(start: _State) -> dict[str, np.ndarray]:
    """The automaton as arrays: arcs sorted by ``state * 256 + byte``, ids as stretches of one pool.

    ``arc_ids`` and ``state_ids`` have one entry more than arcs and states: where the ids of each begin.
    """
    number, order = {id(start): 0}, [start]
    for state in order:  # grows while it is read
        for _, target in state.arcs.values():
            if id(target) not in number:
                number[id(target)] = len(order)
                order.append(target)
    arcs = [
        (number[id(s)] * 256 + byte, output, number[id(target)])
        for s in order for byte, (output, target) in sorted(s.arcs.items())
    ]
    of_arcs, of_states = [o for _, o, _ in arcs], [s.output for s in order]
    sizes = np.cumsum([0, *map(len, of_arcs), *map(len, of_states)])
    return {
        "keys": np.array([k for k, _, _ in arcs], np.int64), "targets": np.array([t for _, _, t in arcs], np.int32),
        "arc_ids": sizes[: len(arcs) + 1].astype(np.int32), "final": np.array([s.final for s in order], np.int8),
        "state_ids": sizes[len(arcs) :].astype(np.int32),
        "pool": np.array([i for o in (*of_arcs, *of_states) for i in o], np.int32),
    }


def store(arrays: dict[str, np.ndarray], path: str) -> None:
    """Write an automaton: the lengths of its arrays, then the arrays."""
    system, place = file_system(path)
    system.create_dir(place.rpartition("/")[0], recursive=True)
    with system.open_output_stream(place, compression=None) as out:
        out.write(np.array([len(arrays[n]) for n, _ in ARRAYS], np.int64).tobytes())
        for name, kind in ARRAYS:
            out.write(np.ascontiguousarray(arrays[name], kind).tobytes())


class Lexicon:
    """A stored automaton, mapped into memory where its file has a local path."""

    def __init__(self, path: str):
        from pyarrow import fs

        system, place = file_system(path)
        if isinstance(system, fs.LocalFileSystem):
            data = np.asarray(np.memmap(place, np.uint8, "r"))
        else:
            with system.open_input_file(place) as file:
                data = np.frombuffer(file.read(), np.uint8)
        at = 8 * len(ARRAYS)
        for (name, kind), n in zip(ARRAYS, data[:at].view(np.int64)):
            end = at + int(n) * np.dtype(kind).itemsize
            setattr(self, name, data[at:end].view(kind) if n else np.zeros(0, kind))
            at = end

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(known, ids, lengths)``: which words the lexicon has, their ids in a row, how many each has."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        letters = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        begin = np.cumsum(size) - size
        state, alive = np.zeros(n, np.int64), np.arange(n)
        # Word, place in the pool, how many.
        said = [tuple(np.zeros(0, np.int64) for _ in range(3))]
        known = np.zeros(n, bool)
        depth = 0
        while len(alive):
            done = size[alive] == depth
            ended = alive[done]
            ended = ended[self.final[state[ended]] == 1]
            known[ended] = True
            said.append((ended, *self._stretch(self.state_ids, state[ended])))
            alive = alive[~done]
            if not len(alive) or not len(self.keys):
                break
            key = state[alive] * 256 + letters[begin[alive] + depth]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[arc] == key
            alive, arc = alive[found], arc[found]
            said.append((alive, *self._stretch(self.arc_ids, arc)))
            state[alive] = self.targets[arc]
            depth += 1
        word, place, count = (np.concatenate(x) for x in zip(*said))
        use = known[word] & (count > 0)
        word, place, count = word[use], place[use], count[use]
        order = np.argsort(word, kind="stable")  # of each word the stretches stay in the order of its bytes
        word, place, count = word[order], place[order], count[order]
        ids = self.pool[stretches(place, count)]
        return known, ids, np.bincount(word, weights=count, minlength=n).astype(np.int64)[known]

    def _stretch(self, begins: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return begins[which].astype(np.int64), (begins[which + 1] - begins[which]).astype(np.int64)


def stretches(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places ``begin .. begin + size`` of all stretches, one after the other."""
    upto = np.cumsum(size)
    return np.repeat(begin - upto + size, size) + np.arange(int(upto[-1]) if len(upto) else 0)


def splitter() -> Callable[[str], list[str]]:
    """Cut a text into words, without the space that all but the first begin with."""
    import re

    cut = re.compile(CUT)
    blanks = [chr(c) + " " for c in range(0x3001) if chr(c).isspace()]
    low = [b for b in blanks if b.isascii()]

    def split(text: str) -> list[str]:
        odd = low if text.isascii() else blanks
        return cut.split(text) if any([b in text for b in odd]) else text.split(" ")

    return split


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, n)``: how often each word occurs in all texts, as bytes with the space it begins with.

    Words over ``LONGEST`` bytes are left out: they are merged and never looked up.
    """
    rows = docs.select(F.col("text").cast("string")).where("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter()
        for part in slices(batches, limit=16 << 20):
            inner: Counter[str] = Counter()
            first: Counter[str] = Counter()
            for text in part.column("text").to_pylist():
                words = split(text)
                first[words[0]] += 1
                inner.update(words[1:])
            words = [" " + w for w in inner] + list(first)
            found = pa.array(words, pa.string()).cast(pa.binary())
            batch = table_of("word binary, n bigint", word=found, n=[*inner.values(), *first.values()])
            short = np.array([len(w) <= LONGEST for w in words], bool)
            yield batch.filter(pa.array(short))

    return small_batches(rows).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(
        F.sum("n").alias("n")
    )


def frequent_words(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The most frequent words of all texts, ``(word, n)``, ``words`` at most.

    The cut is a step of a histogram of the logarithms of the counts: words of the step that does not fit as
    a whole are left out.
    """
    step = F.floor(F.log2("n") * STEPS).alias("step")
    counts = materialize(word_counts(docs).where(F.col("n") >= LEAST), "word-counts")
    left, least = words, None
    for r in sorted(counts.groupBy(step).count().collect(), reverse=True):
        left -= r["count"]
        if left < 0:
            break
        least = r["step"]
    return counts.where(F.lit(False) if least is None else step >= least)


def compile_lexicon(docs: DataFrame, path: str, vocabulary_path: str | None = None, words: int = WORDS) -> int:
    """Count the words of all texts, and store the automaton of the most frequent ones.

    Returns how many words it has.
    """
    chosen = sorted(bytes(r["word"]) for r in frequent_words(docs, words).select("word").collect())
    ids = Merger(vocabulary_path or vocabulary(VOCABULARY)).ids([w.decode() for w in chosen])
    store(flat(minimal([(w, tuple(i.tolist())) for w, i in zip(chosen, ids)])), path)
    return len(chosen)


class Numbers(dict):
    """Numbers names as they are asked for; new ones go to ``fresh`` with what they begin with."""

    def __init__(self, owner: Encoder, begin: str):
        self.owner, self.begin = owner, begin

    def __missing__(self, name: str) -> int:
        self[name] = number = self.owner.count
        self.owner.count += 1
        self.owner.fresh.append(self.begin + name)
        return number


class Encoder:
    """Encodes texts by a lexicon, if there is one, and merges and remembers the words that it lacks."""

    def __init__(self, lexicon: Lexicon | None, merger: Merger):
        self.lexicon, self.merger, self.split = lexicon, merger, splitter()
        self.forget()

    def forget(self) -> None:
        self.inner, self.first = Numbers(self, " "), Numbers(self, "")
        self.fresh: list[str] = []
        self.table = np.zeros(1 << 16, np.int32)
        self.used = self.count = 0
        self.begin, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _room(self, name: str, wanted: int) -> None:
        held = getattr(self, name)
        if wanted > len(held):
            grown = np.zeros(max(wanted, 2 * len(held)), held.dtype)
            grown[: len(held)] = held
            setattr(self, name, grown)

    def _add(self, at: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Remember ids of the words with these numbers."""
        self._room("table", self.used + len(ids))
        self.table[self.used : self.used + len(ids)] = ids
        self.begin[at] = self.used + np.cumsum(sizes) - sizes
        self.size[at] = sizes
        self.used += len(ids)

    def learn(self) -> None:
        """Look up or merge the words that are new to the task; their numbers are the last ones."""
        fresh, self.fresh = self.fresh, []
        base = self.count - len(fresh)
        self._room("begin", self.count)
        self._room("size", self.count)
        known = np.zeros(len(fresh), bool)
        if self.lexicon is not None:
            known, ids, sizes = self.lexicon.ids([w.encode() for w in fresh])
            self._add(base + np.flatnonzero(known), ids, sizes)
        missing = np.flatnonzero(~known)
        merged = self.merger.ids([fresh[k] for k in missing])
        if merged:
            self._add(base + missing, np.concatenate(merged), np.array([len(m) for m in merged], np.int64))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the length of each."""
        if self.count > MEMORY:
            self.forget()
        ask, rows = self.inner.__getitem__, []
        for text in texts:
            names = self.split(text)
            row = np.empty(len(names), np.int64)
            row[0] = self.first[names[0]]
            row[1:] = np.fromiter(map(ask, names[1:]), np.int64, len(names) - 1)
            rows.append(row)
        if self.fresh:
            self.learn()
        if not rows:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        words = np.concatenate(rows)
        size = self.size[words]
        upto = np.append(0, np.cumsum(size))
        ends = np.cumsum([len(r) for r in rows])
        return self.table[stretches(self.begin[words], size)], np.diff(upto[ends], prepend=0)


ENCODED = "doc_id bigint, ids array<int>"


def encode(
    docs: DataFrame, path: str, vocabulary_path: str | None = None,
    finish: Callable[[Merger, pa.Array, np.ndarray, np.ndarray], pa.RecordBatch] | None = None, schema: str = ENCODED,
) -> DataFrame:
    """``(doc_id, ids)`` of each text, by the lexicon stored at ``path``.

    ``finish`` may turn the ids of a slice (document ids, ids, lengths) into other columns, ``schema``, in
    the same task.
    """
    vocabulary_path = vocabulary_path or vocabulary(VOCABULARY)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string"))

    def lists(_, doc_id: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
        offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
        return table_of(ENCODED, doc_id=doc_id, ids=pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)))

    finish = finish or lists

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger(vocabulary_path)
        mine = Encoder(Lexicon(path), merger)
        for part in slices(batches):
            ids, lengths = mine.encode([t or "" for t in part.column("text").to_pylist()])
            yield finish(merger, part.column("doc_id"), ids, lengths)

    return small_batches(rows).mapInArrow(run, schema)


def decode(merger: Merger, ids: list[int]) -> str:
    """The text of ids, special tokens included; bytes that are no UTF-8 become replacement characters."""
    return b"".join(map(merger.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """Compile a lexicon of all documents, encode and decode them by it, and digest both."""
    path = scratch_path(docs.sparkSession, "lexicon") + ".bin"
    compile_lexicon(docs, path, vocabulary_path)

    def finish(merger: Merger, doc_id: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
        of_ids, of_texts, ends = [], [], np.cumsum(lengths)
        for end, n in zip(ends, lengths):
            row = ids[end - n : end]
            of_ids.append(hashlib.sha256(row.astype("<u4").tobytes()).hexdigest())
            of_texts.append(hashlib.sha256(decode(merger, row.tolist()).encode()).hexdigest())
        return table_of(
            DIGESTS, doc_id=doc_id, n_tokens=pa.array(lengths, pa.int64()), ids_sha256=pa.array(of_ids, pa.string()),
            decoded_sha256=pa.array(of_texts, pa.string()),
        )

    return encode(docs, path, vocabulary_path, finish, DIGESTS)
