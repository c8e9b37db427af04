"""Whole texts as words in Arrow batches: each distinct word of a slice is handled once in Python, the rest is numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time; a longer single text is one slice.
SLICE_BYTES = 4 << 20


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) with about ``most`` bytes of text each."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        base = ends[first - 1] if first else 0
        last = max(int(np.searchsorted(ends, base + most, side="right")), first + 1)
        yield first, texts.slice(first, last - first)
        first = last


def release() -> None:
    """Give freed memory back to the machine: workers are used again by later stages, and keep what they once had otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def split_arrow(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct ASCII-white-space separated words, the number of the word at each place, and the places where each text begins (one more than texts)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    coded = pc.list_flatten(lists).dictionary_encode()
    words, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.index(words, "").as_py()
    if empty >= 0:  # white space at either end of a text leaves empty words
        keep = at != empty
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        at = at[keep]
    return words, at, bounds


def split(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """As ``split_arrow``, with the words as strings."""
    words, at, bounds = split_arrow(texts)
    return words.to_pylist(), at, bounds


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit moves every output bit."""
    x = np.asarray(x, dtype=np.uint64).copy()
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


def reduce_at(op: np.ufunc, values: np.ndarray, bounds: np.ndarray, empty: float) -> np.ndarray:
    """``op`` over each part between neighbouring ``bounds``; ``empty`` where a part has nothing."""
    full = bounds[1:] > bounds[:-1]
    out = np.full(len(bounds) - 1, empty, dtype=values.dtype)
    if full.any():
        out[full] = op.reduceat(values, bounds[:-1][full])
    return out
