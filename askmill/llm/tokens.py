"""Token counts by the whole-token shortcut, and ids of whole texts by a bounded cache of their pieces.

Both split a text at places where the tokenizer can't join what stands on either side, so that a piece's
tokens don't depend on what is around it. A piece seen before costs one look-up; the tokenizers library
itself encodes each new one.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askmill.llm.words import gathered, numbered, slices

#: Bytes that a cache holds in each of its two generations, about.
CACHE = 48_000_000
#: What an entry of a cache takes besides its piece.
ENTRY = 180
#: Rows turned into Python strings at a time.
SLICE = 512

# The pre-tokens of the byte-level tokenizer.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Pieces(dict):
    """piece -> what ``make`` gives for it; the less recent of two generations goes when the newer is full."""

    def __init__(self, make: Callable[[str], object], most: int = CACHE):
        super().__init__()
        self.make, self.most, self.old, self.bytes = make, most, {}, 0

    def __missing__(self, piece: str):
        found = self.old.get(piece)
        if found is None:
            found = self.make(piece)
        if self.bytes >= self.most:
            self.old = dict(self)
            self.clear()
            self.bytes = 0
        self[piece] = found
        self.bytes += ENTRY + len(piece)
        return found


#: The cache of this worker process, by what it is for. Spark reuses its workers for other operators' tasks: another's cache takes its place.
_HELD: dict[tuple, object] = {}


def held(what: tuple, make: Callable[[], object]) -> object:
    """The process's one cache, made if it is for something else."""
    if what not in _HELD:
        _HELD.clear()
        _HELD[what] = make()
    return _HELD[what]


def load(path: str):
    """The tokenizer of a ``.json`` file, on one thread: Spark's tasks are the parallel part."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


# --- the whole-token shortcut ---------------------------------------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 ones stand for themselves, the rest follow from code point 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def whole_tokens(path: str) -> list[str]:
    """The vocabulary strings which are one pre-token and, encoded alone, are one token: a proof by trying each.

    The list has at most as many entries as the vocabulary.
    """
    t, letters, pre = load(path), byte_letters(), regex.compile(PRE_TOKEN)
    added = {x.content for x in t.get_added_tokens_decoder().values()}
    strings, ids = [], []
    for token, i in t.get_vocab(with_added_tokens=False).items():
        try:
            s = bytes(letters[c] for c in token).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if s not in added and pre.fullmatch(s):
            strings.append(s)
            ids.append(i)
    found = t.encode_batch_fast(strings, add_special_tokens=False)
    return [s for s, i, e in zip(strings, ids, found, strict=True) if e.ids == [i]]


#: A space before white space or at the end: here a split at spaces would part a run of white space.
_RUN = re.compile(r" (?=\s|$)")
_BEFORE_WORD = re.compile(r" (?=\S)")


def space_pieces(text: str) -> list[str]:
    """The text cut before each space that a non-space follows; such a piece is given without its space, but the first.

    The pre-tokens never reach over these places: a run of white space gives its last space to what follows.
    """
    if _RUN.search(text):
        return _BEFORE_WORD.split(text)
    return text.split(" ")


def token_counter(path: str, whole: Callable[[], Iterable[str]]) -> Callable[[str], int]:
    """Counts a text's tokens. Pre-tokens of ``whole`` count 1; only the others are merged by the library's model."""
    t, pre, one = load(path), regex.compile(PRE_TOKEN), frozenset(whole())
    special = [x.content for x in t.get_added_tokens_decoder().values()]
    letter = {b: c for c, b in byte_letters().items()}
    merge = t.model.tokenize

    def tokens(piece: str) -> int:
        if any(s in piece for s in special):
            return len(t.encode(piece, add_special_tokens=False).ids)
        parts = pre.findall(piece)
        rest = [p for p in parts if p not in one]
        return len(parts) - len(rest) + sum(len(merge("".join([letter[b] for b in p.encode()]))) for p in rest)

    first, later = Pieces(tokens, CACHE // 10), Pieces(lambda p: tokens(" " + p))

    def count(text: str) -> int:
        if not text:
            return 0
        head, *rest = space_pieces(text)
        return (first[head] if head else 0) + sum(map(later.__getitem__, rest))

    return count


def count_tokens(docs: DataFrame, path: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its bytes, its tokens and whether they exceed ``limit``.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows and null keys keep their rows; other columns
    are left out, so their names can't clash. No shuffle: the set of whole tokens (bounded by the vocabulary)
    goes to each task, and the texts stay where they are read.
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = held(("count", path), lambda: token_counter(path, lambda: whole.value))
        for batch in batches:
            n = []
            for k in range(0, batch.num_rows, SLICE):
                n += [count(x) if x else 0 for x in batch.column(2).slice(k, SLICE).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["k", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    out = rows.mapInArrow(run, f"k {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


# --- ids -----------------------------------------------------------------------------------------------------------


#: A word of Latin-1 letters, composed already: one pre-token, whatever the case and normal form.
_PLAIN = r"\A[A-Za-zÀ-ÖØ-öø-ÿ]+\z"
#: Letters and digits of common scripts whose small letter and normal form is one letter or digit again. Others may end in a combining mark
#: (a dotted capital I does), which a mark of punctuation joins; words that end so are left to the library.
_LAST = "[0-9A-Za-zÀ-ÖØ-öø-įıĲ-ſΑ-ΡΣ-Ωα-ωЀ-џ一-鿿]\\z"
#: Marks that are a pre-token of their own after such a letter or digit, if nothing follows.
_MARKS = ".,;:!?"


class WordIds:
    """The ids of words met so far, found by 96 bits of hashes: some 30 bytes a word. Begun anew when it holds MOST words."""

    MOST = 500_000

    def __init__(self):
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def __call__(self, words: list[str], make: Callable[[list[int]], list[list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct words a place in ``flat`` each, how many ids are there, and ``flat``. ``make`` gives the ids of the words of these numbers."""
        names = np.asarray(words, object)
        key, check = (pd.util.hash_array(names, hash_key=k, categorize=False) for k in ("the first of two", "the other of two"))
        check = check.astype(np.uint32)
        at = np.searchsorted(self.key, key)
        near = np.minimum(at, max(len(self.key) - 1, 0))
        known = (self.key[near] == key) & (self.check[near] == check) if len(self.key) else np.zeros(len(key), bool)
        fresh = np.flatnonzero(~known)
        if len(fresh):
            found = make(fresh.tolist())
            size = np.fromiter(map(len, found), np.int32, len(found))
            start = len(self.flat) + np.cumsum(size, dtype=np.int64) - size
            self.flat = np.r_[self.flat, np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(size.sum()))]
            order = np.argsort(key[fresh], kind="stable")
            into = at[fresh][order]
            old = self.key, self.check, self.start, self.size
            self.key, self.check, self.start, self.size = (np.insert(x, into, y[order]) for x, y in zip(old, (key[fresh], check[fresh], start, size), strict=True))
            at = np.searchsorted(self.key, key)
            if (self.check[at] != check).any():  # two words of one key: told apart by hand
                return self._apart(words, make)
        out = self.start[at], self.size[at], self.flat
        if len(self.key) > self.MOST:
            self.__init__()
        return out

    def _apart(self, words: list[str], make: Callable[[list[int]], list[list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.__init__()
        found = make(list(range(len(words))))
        size = np.fromiter(map(len, found), np.int32, len(found))
        return np.cumsum(size, dtype=np.int64) - size, size, np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(size.sum()))


class IdEncoder:
    """Gives texts' ids, for the tokenizer that makes letters small and drops white space.

    Texts are cut at spaces and line ends only, and before a mark at a word's end: each tokenizer pattern and normal form
    keeps these apart. The distinct words of a slice are looked up once; plain ones that are new go to the library's model at
    once, all other pieces through the whole of the library.
    """

    def __init__(self, path: str):
        t = load(path)
        self.merge, self.letter = t.model.tokenize, {b: c for c, b in byte_letters().items()}
        self.whole = lambda piece: t.encode(piece, add_special_tokens=False).ids if piece else []
        self.special = [x.content for x in t.get_added_tokens_decoder().values()]
        if any(" " in x or "\n" in x for x in self.special):
            raise ValueError("special tokens with white space in them can't be kept whole")
        self.known = WordIds()
        ones = {m: self.whole(m) for m in _MARKS}
        self.marks = "".join(m for m, x in ones.items() if len(x) == 1)
        self.mark_id = np.zeros(256, np.uint32)
        for m in self.marks:
            self.mark_id[ord(m)] = ones[m][0]

    def _encoded(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        names, merge, letter = pieces.to_pylist(), self.merge, self.letter

        def make(fresh: list[int]) -> list[list[int]]:
            plain = pc.match_substring_regex(pieces.take(pa.array(fresh)), _PLAIN).to_pylist()
            out = []
            for k, simple in zip(fresh, plain, strict=True):
                name = names[k]
                if simple:
                    # Printable ASCII stands for itself.
                    name = name.lower()  # texts with special strings in them come as they are written
                    out.append([x.id for x in merge(name if name.isascii() else "".join([letter[b] for b in name.encode()]))])
                else:
                    out.append(self.whole(name))
            return out

        return self.known(names, make)

    def _distinct(self, words: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each word, one after the other, and how many each has; behind them the end id as a word of its own."""
        cores = pc.ascii_rtrim(words, characters=self.marks)
        marked = np.asarray(pc.equal(pc.subtract(pc.binary_length(words), pc.binary_length(cores)), 1))
        marked = marked & np.asarray(pc.match_substring_regex(cores, _LAST))
        ends = np.frombuffer(words.buffers()[1], np.int64 if words.type == pa.large_string() else np.int32)[words.offset + 1 : words.offset + len(words) + 1]
        last = np.frombuffer(words.buffers()[2], np.uint8)[ends[marked] - 1] if marked.any() else np.zeros(0, np.uint8)
        found = pc.if_else(pa.array(marked), cores, words).dictionary_encode()
        core = np.asarray(found.indices)
        start, sizes, flat = self._encoded(found.dictionary)
        flat, _ = gathered(flat, sizes, core, start)
        n = np.r_[sizes[core] + marked, 1]
        ids, own = np.empty(int(n.sum()), np.uint32), np.ones(int(n.sum()), bool)
        tails = np.cumsum(n)[:-1][marked] - 1
        own[tails] = own[-1] = False
        ids[own], ids[tails], ids[-1] = flat, self.mark_id[last], end
        return ids, n

    def __call__(self, texts: pa.Array, end: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """For each slice of the texts: the slice, the ids of all its texts, each with ``end`` behind them, and how many each text has."""
        for part in slices(texts):
            # A special string counts as it is written; elsewhere, capitals and small letters are the same.
            held = functools.reduce(pc.or_, [pc.match_substring(part, x[:2]) for x in self.special], pa.array(np.zeros(len(part), bool)))
            small = pc.if_else(held, part, pc.ascii_lower(part))
            number, sizes, words = numbered(pc.split_pattern(pc.replace_substring(small, "\n", " "), " "))
            ids, n = self._distinct(words, end)
            ends = np.cumsum(sizes)
            number = np.insert(number, ends, len(words))
            flat, done = gathered(ids, n, number)
            upto = done[ends + np.arange(len(ends))]
            yield part, flat, np.diff(upto, prepend=0)
        pa.default_memory_pool().release_unused()  # a worker waits for its next task without what this batch took


def id_encoder(path: str) -> IdEncoder:
    """The process's encoder of this file, so that the tasks of a worker share one cache."""
    return held(("ids", path), lambda: IdEncoder(path))


def crc(ids) -> int:
    return zlib.crc32(ids)
