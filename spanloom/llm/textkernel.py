"""Whole texts as numpy arrays, straight from Arrow's string buffers.

The kernels work on slices of about a megabyte of concatenated texts, so that their temporaries stay in cache and the
memory of a task is bounded by one batch plus its longest single text.  No Python string is made per row or per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 20

#: Rows in an Arrow batch are regrouped to about this many bytes of text before a kernel sees them.
_M1, _M2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
_POWER = U64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser: every output bit depends on every input bit."""
    h = h ^ (h >> U64(33))
    h = h * _M1
    h = h ^ (h >> U64(33))
    h = h * _M2
    return h ^ (h >> U64(33))


#: One random-looking 64-bit value per byte.
_BYTE = mix(np.arange(1, 257, dtype=U64) * _POWER)

#: The separators of the contract: space and the bytes 9 to 13.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes with A-Z folded to a-z.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

#: Letters and digits of ASCII, and every byte of a multi-byte character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@lru_cache(maxsize=1)
def _powers(n: int) -> np.ndarray:
    out = np.full(n, _POWER, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int) -> np.ndarray:
    """The first powers of the hash multiplier, at least ``n`` of them."""
    return _powers(max(1024, 1 << (int(n) - 1).bit_length() if n > 1 else 1))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, valid) of an Arrow string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.large_string()), np.int64
    n = len(column)
    valid = np.asarray(column.is_valid()) if column.null_count else np.ones(n, dtype=bool)
    _, offs, data = column.buffers()
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), valid
    offsets = np.frombuffer(offs, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count and (np.diff(offsets)[~valid] > 0).any():
        filled = column.fill_null("")
        return text_buffers(filled)[:2] + (valid,)
    return data, offsets, valid


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes together; a longer text stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, word: np.ndarray, prefixes: tuple[int, ...] = ()
) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Hashes of the words of some texts.

    ``word`` marks the bytes of which words consist; ``offsets`` start at 0.  Returns the words' hashes, their first
    bytes' positions, the index of each text's first word (one more entry than texts), and for each number in
    ``prefixes`` the hashes of the words' first so many bytes.
    """
    inside = word[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    start[heads] = inside[heads]
    starts = np.flatnonzero(start)
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        empty = np.zeros(0, U64)
        return empty, starts, first, [empty for _ in prefixes]
    length = np.diff(np.append(starts, len(data)))
    at = np.arange(int(starts[0]), len(data)) - np.repeat(starts, length)
    value = np.where(inside, _BYTE[FOLD[data]], U64(0))[int(starts[0]) :] * powers(int(length.max()) + 1)[at]
    cuts = starts - starts[0]
    short = [mix(np.add.reduceat(np.where(at < k, value, U64(0)), cuts) + U64(k)) for k in prefixes]
    return mix(np.add.reduceat(value, cuts)), starts, first, short


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each text its set of ``k``-word shingles as sorted 64-bit hashes; a shorter text is one shingle as a whole."""
    odd = mix(np.arange(1, k + 1, dtype=U64)) | U64(1)
    n = len(words)
    every = np.zeros(max(0, n - k + 1), dtype=U64)
    for i in range(k):
        every += words[i : i + len(every)] * odd[i]
    every = mix(every)
    for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if e - s >= k:
            yield np.unique(every[s : e - k + 1])
        elif e > s:
            yield mix((words[s:e] * odd[: e - s]).sum(keepdims=True) + U64(e - s))
        else:
            yield every[:0]
