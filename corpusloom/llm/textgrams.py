"""Numpy helpers over the bytes of a batch of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
ROUND = U(0x9E3779B97F4A7C15)
LEFT = U(0xD6E8FEB86659FD93)
RIGHT = U(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> U(32))
    x *= ROUND
    x ^= x >> U(29)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit fingerprint for the ordered pair of two."""
    return mix(a * LEFT + (b ^ (b >> U(31))) * RIGHT)


def prefix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """A fingerprint of ``data[p:p + length]`` for every p that has so many bytes.

    Prefix doubling: the rank of a string is made of the ranks of its two halves, so
    ``log2(length)`` steps over whole arrays reach the length.
    """
    n = len(data) - length + 1
    if n <= 0:
        return np.empty(0, U)
    rank, have = mix(data.astype(U) + U(1)), 1
    while have * 2 <= length:
        rank = pair(rank[:-have], rank[have:])
        have *= 2
    if have < length:  # two overlapping halves
        gap = length - have
        rank = pair(rank[:n], rank[gap:gap + n])
    return rank[:n]


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    if have < width:
        gap = width - have
        values = np.minimum(values[:n], values[gap:gap + n])
    return values[:n]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, joined, and the n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary()
    column = column.cast(pa.large_string()).cast(kind) if pa.types.is_string(column.type) else column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


def ranges(counts: np.ndarray) -> np.ndarray:
    """0 .. c-1 for each count, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray,
                space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each maximal run of bytes outside ``space``; none crosses texts."""
    inside = ~space[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    begins[cuts] = inside[cuts]
    start = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[cuts - 1] = inside[cuts - 1]
    end = np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_ranks(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint for each word: a sum of hashes of (place in the word, byte)."""
    if len(start) == 0:
        return np.empty(0, U)
    size = end - start
    at = np.repeat(start, size) + ranges(size)
    place = ranges(size).astype(U)
    total = np.add.reduceat(mix(data[at] + (place << U(8)) + U(1)), np.cumsum(size) - size)
    return mix(total + size.astype(U))


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, fingerprint) of each run of ``words`` words; a shorter text is one shingle."""
    start, end, owner = word_bounds(data, offsets)
    ranks = word_ranks(data, start, end)
    count = np.bincount(owner, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    per = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(len(per)), per)
    at = first[text] + ranges(per)
    size = np.minimum(count[text], words)
    out = size.astype(U)
    for k in range(words):
        have = size > k
        out[have] = pair(out[have], ranks[at[have] + k])
    return text, out


def counted(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, value) in order, and how often each occurs."""
    if len(text) == 0:
        return text, value, np.empty(0, np.int64)
    order = np.lexsort([value, text])
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    heads = np.flatnonzero(new)
    return text[heads], value[heads], np.diff(np.append(heads, len(text)))


def slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes each; a longer text is alone."""
    out, at, n = [], 0, len(offsets) - 1
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        out.append((at, min(stop, n)))
        at = out[-1][1]
    return out
