"""Words of whole Arrow batches as arrays: places, owners and 64-bit hashes.

A batch's texts lie one after the other in one byte buffer, so all its words are found and hashed by
a few array operations. Hashes are deterministic: equal words have equal hashes in every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Text bytes that are taken as one block; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: What is part of a word. SPACED: ``[^\x20\x09-\x0D]+``. PLAIN: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
PLAIN = np.zeros(256, bool)
PLAIN[48:58] = PLAIN[97:123] = PLAIN[128:] = True


@dataclass
class Words:
    """Words of a block: byte range, text number and hash of each; ``first[d]:first[d + 1]`` are text d's."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def mix(h: np.ndarray) -> np.ndarray:
    """A fixed mixing of 64 bits (multiply, shift, multiply, shift), in which every input bit counts."""
    h = h * _C1
    h ^= h >> np.uint64(32)
    h *= _C2
    h ^= h >> np.uint64(29)
    return h


def text_blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first text, last text + 1, bytes, offsets)`` of consecutive texts; a NULL text has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, where, held = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    if texts.null_count:  # Arrow may keep bytes under a NULL
        data, offsets = _without_nulls(texts, data, offsets)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
        to = min(to, n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def _without_nulls(texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(offsets) * np.asarray(texts.is_valid())
    if (size == np.diff(offsets)).all():
        return data, offsets
    full = texts.fill_null("")
    _, where, held = full.buffers()
    offsets = np.frombuffer(where, np.int64)[full.offset : full.offset + len(full) + 1]
    return np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8), offsets


def find_words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = SPACED, lower: bool = False) -> Words:
    """All words of a block of texts."""
    if lower:
        data = _LOWER[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    inside = kind[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[edges - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, hash_ranges(data, start, end), np.searchsorted(start, offsets))


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, eight bytes at a time."""
    size = end - start
    h = size.astype(np.uint64) + _C2
    if not len(start):
        return h
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    live, step = np.arange(len(start)), 0
    while len(live):
        left = size[live] - 8 * step
        got = eight[start[live] + 8 * step]
        keep = np.uint64(8) * np.minimum(left, 8).astype(np.uint64)
        short = left < 8
        got[short] &= (np.uint64(1) << keep[short]) - np.uint64(1)
        h[live] = mix(h[live] ^ got)
        live, step = live[left > 8], step + 1
    return h


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of every ``k`` consecutive entries (over text borders too; see :func:`same_text`)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = h[:n].copy()
    for j in range(1, k):
        g = mix(g) ^ h[j : j + n]
    return mix(g)


def same_text(words: Words, k: int) -> np.ndarray:
    """Whether the ``k`` words from each place belong to one text."""
    n = len(words.hash) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    doc = words.doc
    return doc[:n] == doc[k - 1 :]


def list_array(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """An Arrow list column from flat values and the size of each list."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def as_long(h: np.ndarray) -> np.ndarray:
    """Hashes as Spark's signed long."""
    return h.view(np.int64)
