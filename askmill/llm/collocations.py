"""Phrases whose words come together, by hash-filtered counting in passes of growing length.

While the phrases of one length are counted, those of the next are counted in buckets of a hash. A phrase can be frequent only
if its bucket is, and if the two phrases within it that are one word shorter are. Both are known as bitmaps of a bounded size, which every task gets:
only what passes both is counted exactly, by its words. Bitmaps may let too much through, never too little, and the exact
counts decide. Bucket counts stop at the threshold, so that they are bytes: a task sends a byte for each bucket, whatever it has read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askmill.llm.common import cut, dealt, groups
from askmill.llm.words import hashes, numbered, slices

LONGEST = 4
LEAST = 30
#: A candidate goes if a longer one around it has so many hundredths of its count.
COVERED = 80
MOST = 2000
SCALE = 2_000_000
#: Buckets are 2^bits, by the bytes that are read, between these bounds: a bitmap of the most is 2 MB.
LEAST_BITS, MOST_BITS = 18, 24
#: Buckets of a row of counts.
PART = 1 << 14
#: Bytes of texts that are counted together.
SLICE = 8 << 20

# What parts pieces, and what parts words.
_BREAKS, _SPACES = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
_KIND, _CLEAN = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
_KIND[list(_SPACES)], _KIND[list(_BREAKS)] = 1, 2
_CLEAN[65:91] += 32
_CLEAN[list(_SPACES + _BREAKS)] = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)
COUNTED = "kind int, lang string, phrase string, place int, n long, counts binary"


@dataclass
class Pass:
    """What a pass over the texts knows: the length that it counts, the number of bits, and the bitmaps (of frequent phrases one word shorter, and of frequent buckets)."""

    length: int
    bits: int
    shorter: Broadcast | None = None
    buckets: Broadcast | None = None


def _mixed(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (h ^ word) * _MIX
    return h ^ (h >> np.uint64(29))


def _has(bitmap: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


class _Slice:
    """A slice of texts as word numbers, with each word's piece and the hash of its language."""

    def __init__(self, texts: pa.Array, langs: np.ndarray, lang_hash: np.ndarray):
        texts = texts.cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        kind = _KIND[raw]
        clean = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(_CLEAN[raw]))
        self.number, sizes, self.words = numbered(pc.split_pattern(clean, " "))
        starts = kind == 0
        first = ends[:-1][np.diff(ends) > 0]
        starts[1:] &= kind[:-1] != 0
        starts[first] = kind[first] == 0
        at = np.flatnonzero(starts)
        text = np.repeat(np.arange(len(sizes)), sizes)
        # Breaks and texts both only grow along the words: their sum is the same for words of one piece alone.
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[at] + text.astype(np.int32) if len(at) else np.zeros(0, np.int32)
        self.lang = langs[text]
        self.hash = hashes(self.words)[self.number]
        self.seed = lang_hash[self.lang]

    def grams(self, length: int) -> np.ndarray:
        """The hash of the phrase of ``length`` words that begins at each word, of whatever pieces."""
        n = max(len(self.number) - length + 1, 0)
        h = self.seed[:n]
        for k in range(length):
            h = _mixed(h, self.hash[k : n + k])
        return h

    def whole(self, length: int) -> np.ndarray:
        """Whether the phrase at each word lies in one piece."""
        n = max(len(self.number) - length + 1, 0)
        return self.piece[:n] == self.piece[length - 1 : n + length - 1]

    def exact(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the phrases at these words, told apart by their words and language: where each first begins, and how often it comes."""
        key, n = self.lang[at].astype(np.int64), len(self.words)
        for k in range(length):
            key = key * n + self.number[at + k]
            if k + 1 < length:
                key = np.unique(key, return_inverse=True)[1]
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        return at[first], count


def _count(batches: Iterator[pa.RecordBatch], this: Pass) -> Iterator[pa.RecordBatch]:
    m, shift = this.length, np.uint64(64 - this.bits)
    shorter, bucket = ((np.frombuffer(x.value, np.uint8) if x else None) for x in (this.shorter, this.buckets))
    counts = np.zeros(1 << this.bits, np.uint8) if m < LONGEST else None
    total: dict[str, int] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column("lang").dictionary_encode()
        langs, distinct = np.asarray(names.indices), names.dictionary.to_pylist()
        lang_hash = pd.util.hash_array(np.asarray(distinct, object), categorize=False)
        done = 0
        for part in slices(batch.column("text"), SLICE):
            s = _Slice(part, langs[done : done + len(part)], lang_hash)
            done += len(part)
            if m == 1:
                for k, n in enumerate(np.bincount(s.lang, minlength=len(distinct))):
                    total[distinct[k]] = total.get(distinct[k], 0) + int(n)
            h, on = s.grams(m), s.whole(m)
            if m > 1:
                less = _has(shorter, s.grams(m - 1) >> shift)
                on = on & less[: len(on)] & less[1 : len(on) + 1] & _has(bucket, h >> shift)
            at, count = s.exact(np.flatnonzero(on), m)
            words = [s.words.take(pa.array(s.number[at + k])) for k in range(m)]
            phrase = pc.binary_join_element_wise(*words, pa.scalar(" ", words[0].type)) if m > 1 else words[0]
            none = pa.nulls(len(at), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(at), np.int32)), pa.array(np.asarray(distinct, object)[s.lang[at]], pa.string()), phrase.cast(pa.string()), pa.array((h[at] >> shift).astype(np.int32)), pa.array(count, pa.int64()), none], names=["kind", "lang", "phrase", "place", "n", "counts"])
            if counts is not None:
                # What is frequent one word longer has a frequent phrase at its beginning and at its end.
                n = max(len(s.number) - m, 0)
                longer = s.whole(m + 1) & on[:n] & on[1 : n + 1]
                place, c = np.unique(s.grams(m + 1)[longer] >> shift, return_counts=True)
                counts[place] = np.minimum(counts[place] + np.minimum(c, LEAST), LEAST)
    rows = [(1, None, None, k, None, counts[k * PART : (k + 1) * PART].tobytes()) for k in range(len(counts) // PART) if counts[k * PART : (k + 1) * PART].any()] if counts is not None else []
    rows += [(2, lang, None, None, n, None) for lang, n in total.items()]
    if rows:
        columns = list(zip(*rows, strict=True))
        kinds = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["kind", "lang", "phrase", "place", "n", "counts"])


def _bucket_bitmap(found: DataFrame, bits: int, least: int) -> bytes:
    """The buckets with so many: the tasks' bytes of a range are summed where that range is dealt to, and only bits come to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["place"]):
            total = np.zeros(PART, np.int64)
            for counts in group.column("counts"):
                total += np.frombuffer(counts.as_buffer(), np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([group.column("place")[0].as_py()], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], names=["place", "bits"])

    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in dealt(found.filter("kind = 1").select("place", "counts"), "place").mapInArrow(add, "place int, bits binary").collect():
        out[r.place * PART // 8 : (r.place + 1) * PART // 8] = np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


def _phrase_bitmap(frequent: DataFrame, bits: int) -> bytes:
    """The places of frequent phrases, put together in words of 64 bits before they come to the driver."""
    places = frequent.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, place % 64)")).alias("bits")).toArrow()
    out = np.zeros((1 << bits) // 64, np.int64)
    out[np.asarray(places.column("word"))] = np.asarray(places.column("bits"))
    return out.astype("<i8").tobytes()


def bits_for(docs: DataFrame) -> int:
    """A bucket for some sixteen bytes that are read."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size()))
    return min(MOST_BITS, max(LEAST_BITS, (size // 16).bit_length()))


def frequent_phrases(docs: DataFrame, least: int = LEAST, bits: int | None = None, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """lang, phrase, words, f of all phrases of up to LONGEST words that come at least ``least`` times (at most LEAST), and lang, n: all words of each language."""
    if not 1 <= least <= LEAST:
        raise ValueError("bucket counts stop at LEAST")
    spark, bits = docs.sparkSession, bits or bits_for(docs)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    this, out, totals = Pass(1, bits), None, None
    while True:
        found = cut(rows.mapInArrow(lambda b, this=this: _count(b, this), COUNTED), f"phrases-{this.length}", "zstd")
        frequent = found.filter("kind = 0").groupBy("lang", "phrase", "place").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
        frequent = cut(frequent, "frequent")
        if this.length == 1:
            totals = found.filter("kind = 2").groupBy("lang").agg(F.sum("n").alias("n"))
        known = frequent.select("lang", "phrase", F.lit(this.length).alias("words"), "f")
        out = known if out is None else out.unionByName(known)
        if this.length == LONGEST:
            return out, totals
        send = spark.sparkContext.broadcast
        this = Pass(this.length + 1, bits, send(_phrase_bitmap(frequent, bits)), send(_bucket_bitmap(found, bits, least)))


def phrases(docs: DataFrame, least: int = LEAST, most: int = MOST, bits: int | None = None, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases of two words or more.

    a, l and r count the phrase and its two parts at the cut where the score, floor(2000000 a / (l + r)), is lowest; the first such cut counts. A phrase
    within a longer frequent one that has 80 % of its count goes. A null language is ``und``; null, empty and wordless texts have no words, and
    repeated rows count as often as they come. Other columns are left out. Numbers are exact: products are decimals.
    """
    known, totals = frequent_phrases(docs, least, bits, lang, text)
    known = cut(known, "known")
    words = F.split("phrase", " ")
    candidates = known.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), words.alias("ws"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("ws", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("ws", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"))
    part = lambda name, f: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    score = F.expr(f"cast({SCALE} as decimal(10, 0)) * cast(a as decimal(20, 0)) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("e"))
    inner = candidates.filter("words > 2").withColumn("s", F.explode(F.sequence(F.lit(2), F.col("words") - 1))).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("s") + 1)))
    inner = inner.groupBy("lang", F.array_join(F.slice("ws", F.col("i"), F.col("s")), " ").alias("phrase")).agg(F.max("a").alias("around"))
    covered = F.expr(f"cast(100 as decimal(10, 0)) * cast(around as decimal(20, 0)) >= cast({COVERED} as decimal(10, 0)) * cast(a as decimal(20, 0))")
    kept = best.join(inner, ["lang", "phrase"], "left").filter(~F.coalesce(covered, F.lit(False)))
    order = Window.partitionBy("lang").orderBy(F.col("e.score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("e.l").alias("l"), F.col("e.r").alias("r"), "n", F.col("e.score").cast("long").alias("score"))
