"""Words of Arrow text columns as numpy arrays: places, owners and 64-bit hashes, for many texts at once.

A word is a run of bytes other than the six ASCII white-space characters, which is the
pattern ``[^\\x20\\x09-\\x0D]+`` on UTF-8 text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"): ord("Z") + 1] += 32

SEED = np.random.default_rng(20_240_601)
BYTE_CODES = SEED.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SLICE_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), MULTIPLIER, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """``row`` is the text a word belongs to, ``start`` and ``stop`` are byte places in the column's data."""

    n_rows: int
    start: np.ndarray
    stop: np.ndarray
    row: np.ndarray
    code: np.ndarray

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.n_rows)

    def bounds(self) -> np.ndarray:
        """First word of every row, and the number of words at the end."""
        return np.concatenate(([0], np.cumsum(self.counts())))


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts with about ``limit`` bytes each, with the place of the first; a longer text comes alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first = 0
    while first < len(texts):
        room, last = limit, first
        while last < len(texts) and (last == first or room >= sizes[last]):
            room -= int(sizes[last])
            last += 1
        yield first, texts.slice(first, last - first)
        first = last


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the place of each text in them; NULL is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    texts = pa.concat_arrays([texts])
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset:]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0]: offsets[-1]], offsets - offsets[0]


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    """All words of the texts, in order."""
    data, offsets = raw(texts)
    n = len(offsets) - 1
    if not data.size:
        none = np.zeros(0, np.int64)
        return Words(n, none, none, none, np.zeros(0, np.uint64))
    inside = ~WHITE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    code = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):  # a block of words, so that the 8-byte arrays stay small next to a very long text
        upto = max(at + 1, int(np.searchsorted(stop, start[at] + SLICE_BYTES, side="right")))
        block = data[start[at]: stop[upto - 1]]
        block = block[inside[start[at]: stop[upto - 1]]]
        if lower:
            block = LOWER[block]
        sizes = stop[at:upto] - start[at:upto]
        begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        local = np.arange(len(block)) - np.repeat(begins, sizes)
        code[at:upto] = mix(np.add.reduceat(BYTE_CODES[block] * powers(int(sizes.max()))[local], begins) + sizes.astype(np.uint64))
        at = upto
    return Words(n, start, stop, row, code)


def window_codes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words inside one text, and the index of its first word."""
    if len(words.code) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(words.row[: len(words.row) - size + 1] == words.row[size - 1:])
    total = np.zeros(len(at), dtype=np.uint64)
    for k in range(size):
        total = total * MULTIPLIER + words.code[at + k]
    return mix(total), at
