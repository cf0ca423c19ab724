"""Numpy views of Arrow string columns: words, hashes and counts of whole batches at once.

A batch's texts lie one after the other in one byte buffer; every function here works on that buffer
and on the offsets at which its documents begin, so no Python code runs per document or per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)  # odd, so that powers of it can be inverted modulo 2**64
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, U), np.ones(1, U)]

#: Bytes of words: digits, letters in lower case and whatever is not ASCII. The rest becomes 0.
WORD = np.zeros(256, np.uint8)
WORD[48:58] = range(48, 58)
WORD[97:123] = range(97, 123)
WORD[65:91] = range(97, 123)
WORD[128:] = range(128, 256)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of them at least; kept for later calls."""
    if len(_powers[0]) < n:
        n = max(n, 1 << 20)
        for k, base in enumerate((_BASE, _INVERSE)):
            x = np.full(n, base, U)
            x[0] = 1
            _powers[k] = np.cumprod(x)
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser: each bit of the input reaches each bit of the output."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of documents of about `most` bytes; a longer document is a run by itself."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that no document's end cuts."""
    n = len(inside)
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:n])
    edge |= cut
    at = np.flatnonzero(edge)
    at, following = at[:-1], at[1:]
    keep = inside[at]
    return at[keep], following[keep]


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: differences of one prefix sum, brought to a common power."""
    up, down = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * up[: len(buf)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mixed(h + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes (0 between words), starts, ends and the number of words before each document."""
    low = WORD[buf]
    starts, ends = runs(low != 0, off)
    return low, starts, ends, np.searchsorted(starts, off)


def shingles(word_hash: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `width` consecutive words and the document of each, documents ascending.

    A document of fewer words, but not none, has one shingle: all its words.
    """
    n, docs = len(word_hash), len(first) - 1
    count = np.diff(first)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum(word_hash * up[:n], out=total[1:])
    made = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(docs), made)
    begins = np.zeros(docs, np.int64)
    np.cumsum(made[:-1], out=begins[1:])
    at = first[:-1][doc] + np.arange(len(doc)) - begins[doc]
    length = np.minimum(count, width)[doc]
    return mixed((total[at + length] - total[at]) * down[at] + length.astype(U)), doc
