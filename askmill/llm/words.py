"""Texts as numbers of their distinct words, so that what a word needs is done once for a slice of texts, by Arrow and numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of the texts that are taken together. A longer text is taken alone.
SLICE_BYTES = 2 << 20


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Runs of texts, nulls as empty ones: each of at most ``most`` bytes, or of one text."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield texts.slice(at, to - at)
        at = to


def numbered(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of lists of words, empty ones left out: each word's number in order, how many words each list has, and the distinct words."""
    sizes, found = np.diff(np.asarray(lists.offsets)), lists.flatten().dictionary_encode()
    number, distinct = np.asarray(found.indices), found.dictionary
    empty = pc.index(distinct, pa.scalar("", distinct.type)).as_py()
    if empty >= 0:
        full = number != empty
        sizes = np.bincount(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[full], minlength=len(sizes))
        number = number[full]
    return number, sizes, distinct


def ascii_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``numbered`` words: A-Z in small letters, between ASCII white space."""
    return numbered(pc.ascii_split_whitespace(pc.ascii_lower(texts)))


def hashes(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, the same in every task."""
    return pd.util.hash_array(np.asarray(distinct.to_pylist(), object), categorize=False) if len(distinct) else np.zeros(0, np.uint64)


def gathered(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``flat`` holds runs of ``sizes``, side by side or at ``starts``; the runs ``which``, one after the other, and where each ends."""
    first = (np.cumsum(sizes, dtype=np.int64) - sizes if starts is None else starts)[which]
    n = sizes[which]
    ends = np.cumsum(n, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 2**31 else np.int64
    at = np.repeat((first - (ends - n)).astype(kind), n)
    at += np.arange(total, dtype=kind)
    return flat[at], ends


def binaries(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary value for each run of ``flat``, without copying it."""
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes * flat.itemsize, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))])
