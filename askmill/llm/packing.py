"""Packing documents into sequences of a fixed length by the sum-of-squares rule."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askmill.llm.common import cut
from askmill.llm.tokens import crc, id_encoder
from askmill.llm.words import binaries

#: Pieces that one task packs, on average. More leave fewer bins open; each group leaves some.
GROUP = 8192


def cut_pieces(docs: DataFrame, path: str, length: int, end_id: int, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Per piece of at most ``length`` ids: key, piece, start, length, ids_crc32 and, if asked for, ids. A null text counts as empty: it has the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = id_encoder(path)
        for batch in batches:
            at = 0
            for part, flat, sizes in encode(batch.column(1), end_id):
                n = -(-sizes // length)
                text_of = np.repeat(np.arange(len(sizes)), n)
                piece = np.arange(len(text_of)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * length
                size = np.minimum(length, sizes[text_of] - start)
                ends = np.cumsum(size)  # pieces lie side by side, as their texts do
                raw = memoryview(flat).cast("B")
                sums = [crc(raw[4 * a : 4 * b]) for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)]
                columns = [batch.column(0).take(pa.array(at + text_of)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(sums, pa.int64())]
                if ids:
                    columns.append(binaries(flat, size))
                at += len(part)
                yield pa.RecordBatch.from_arrays(columns, names=["k", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    out = rows.mapInArrow(run, f"k {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids)
    return out.withColumnRenamed("k", key)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Places items of 1 to ``capacity`` one after the other; gives each one's bin and its offset there.

    N[g] counts the open bins with a gap g. An item of length s goes from a gap g >= s (a new bin: g = capacity)
    to g - s, where the sum of N[g]^2 becomes smallest; full bins (gap 0) don't count. Among equals the
    smallest gap wins. Long items come first: the short ones then fill what those leave.
    """
    count = np.zeros(capacity + 1, np.int64)
    gain = np.empty(capacity + 1, np.float64)  # what taking a bin out of gap g changes; infinite if there is none
    gain[:] = np.inf
    gain[capacity] = 0
    extra = np.zeros(capacity + 1, np.int64)  # what a bin more at gap g changes
    extra[1:] = 1
    extra[0] = 0
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k in np.argsort(-lengths, kind="stable"):
        s = int(lengths[k])
        g = s + int(np.argmin(gain[s:] + extra[: capacity + 1 - s]))
        if g == capacity:
            b, made = made, made + 1
        else:
            b = open_bins[g].pop()
            count[g] -= 1
            gain[g] = 1 - 2 * count[g] if count[g] else np.inf
            extra[g] = 2 * count[g] + 1
        bins[k], offsets[k] = b, capacity - g
        if left := g - s:
            open_bins[left].append(b)
            count[left] += 1
            gain[left] = 1 - 2 * count[left]
            extra[left] = 2 * count[left] + 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int, length: str = "length", group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to each row of ``pieces``, whose lengths are 1 to ``capacity``.

    Pieces are dealt evenly over groups of about ``group``, by a hash that also takes the row's place, so that
    repeated rows spread too; each group is packed on its own. An empty table gives an empty table. ``pieces``
    should be a written table, as its rows are counted first.
    """
    n = pieces.count()
    groups = max(1, -(-n // group))
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(7)), F.lit(groups)).cast("int"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = sum_of_squares(rows[length].to_numpy(np.int64), capacity)
        return rows.assign(sequence_id=rows["__group"].astype("int64") * (1 << 40) + bins, offset=offsets).drop(columns="__group")

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy("__group").applyInPandas(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, length: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Cuts whole texts into pieces and packs these: key, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty (one piece, the end id alone), repeated rows are packed as often as they come,
    other columns are left out. Only lengths and checksums are shuffled; ``cut_pieces`` gives the ids where they are wanted.
    """
    pieces = cut(cut_pieces(docs, path, length, end_id, key, text), "pieces")
    return pack(pieces, length)
