"""Hashes of the words of many texts at once, from the bytes of an Arrow column.

A word's hash is a polynomial over its bytes, taken as a difference of running sums, so whole
columns are hashed by a few array operations and no string object is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from mercalith.llm.perfect_hash import mix

SLICE_BYTES = 2_000_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_BYTE = mix(np.arange(256, dtype=np.uint64), 11)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(size, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, part) for parts of about `size` bytes, or one longer text; NULL becomes empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    total = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, "right")))
        yield at, texts.slice(at, end - at)
        at = end


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of the first word of every text and the end of the last).

    `texts` is a large_string array without NULLs; words are `[^\\x20\\x09-\\x0D]+`.
    """
    _, offsets, data = texts.buffers()
    begin = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[begin[0] : begin[-1]] if data else np.empty(0, np.uint8)
    bounds = begin - begin[0]
    inside = ~_SPACE[raw]
    starts_at = inside.copy()
    starts_at[1:] &= ~inside[:-1]
    edges = bounds[:-1][bounds[:-1] < len(raw)]
    starts_at[edges] = inside[edges]  # a text's first byte starts a word of its own
    starts = np.flatnonzero(starts_at)
    ends_at = inside.copy()
    ends_at[:-1] &= ~inside[1:] | starts_at[1:]
    ends = np.flatnonzero(ends_at) + 1
    power, inverse = _powers(1 << max(16, int(len(raw)).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.empty(len(raw) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[raw] * power[: len(raw)], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)
    return mix(hashes, 3), np.searchsorted(starts, bounds)


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` words; runs across the end of a text are for the caller to skip."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = out * np.uint64(_BASE) + hashes[j : j + n]
    return mix(out, 5)
