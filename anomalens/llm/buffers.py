"""Texts of an Arrow column as one byte array, and hashes over it in whole-array
steps. Texts are UTF-8; a null text has no bytes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xD6E8FEB86659FD93)
_LONG = 64
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2 ** 64 - 1], np.uint64)


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets between them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes each (at least one text)."""
    out, low, n = [], 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1)
        out.append((low, high))
        low = high
    return out


def stir(h: np.ndarray) -> np.ndarray:
    h = h * _A
    h ^= h >> np.uint64(32)
    h *= _B
    h ^= h >> np.uint64(29)
    return h


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number; beyond the end zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; no word crosses a text's end."""
    word = _IS_WORD[data]
    before, after = np.empty_like(word), np.empty_like(word)
    before[1:], after[:-1] = word[:-1], word[1:]
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    before[full] = False
    after[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = False
    return np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased."""
    data = _LOWER[data]
    length = ends - starts
    h = length.astype(np.uint64)
    at = eights(data)
    live = np.flatnonzero(length <= _LONG)
    step = 0
    while len(live):
        left = length[live] - step
        h[live] = stir(h[live] ^ (at[starts[live] + step] & _LOW_BYTES[np.minimum(left, 8)]))
        step += 8
        live = live[left > 8]
    for i in np.flatnonzero(length > _LONG):
        digest = hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest()
        h[i] = np.frombuffer(digest, np.uint64)[0]
    return h


def shingles(column: pa.Array, width: int = 5, size: int = 1 << 21):
    """Yield, for each range of texts, its first text and the distinct shingle hashes
    of each text: (first, hashes, offsets), hashes sorted within a text. A text of
    fewer words is one shingle; one without words has none."""
    data, offsets = texts(column)
    for low, high in pieces(offsets, size):
        part = data[offsets[low]:offsets[high]]
        bounds = offsets[low:high + 1] - offsets[low]
        starts, ends = word_spans(part, bounds)
        words = word_hashes(part, starts, ends)
        owner = np.searchsorted(bounds, starts, "right") - 1
        many = np.bincount(owner, minlength=high - low)
        first = np.concatenate([[0], np.cumsum(many)])[:-1]
        n = max(0, len(words) - width + 1)
        h = np.full(n, width, np.uint64)
        for j in range(width):
            h = h * _B + words[j:n + j]
        same = owner[:n] == owner[width - 1:] if n else np.zeros(0, bool)
        h, whose = stir(h[same]), owner[:n][same]
        short = np.flatnonzero((many > 0) & (many < width))
        if len(short):
            g = many[short].astype(np.uint64)
            for j in range(width - 1):
                has = many[short] > j
                g[has] = g[has] * _B + words[first[short[has]] + j]
            h, whose = np.concatenate([h, stir(g)]), np.concatenate([whose, short])
        order = np.lexsort((h, whose))
        h, whose = h[order], whose[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (whose[1:] != whose[:-1])
        h, whose = h[new], whose[new]
        yield low, h, np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=high - low))])
