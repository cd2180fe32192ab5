"""Vectorised hashing of words and character runs inside Arrow tasks.

A run of rows is hashed at once: every byte or code point gets a random 64-bit value, prefix sums weighted by powers of an odd
base are taken modulo 2**64, and the hash of any span follows from two of them. Equal spans have equal hashes wherever they lie;
different spans of a corpus collide with probability about pairs / 2**64.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
VALUES = np.random.Generator(np.random.PCG64(20)).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHUNK = 1 << 19


def separators(*spans: tuple[int, int]) -> np.ndarray:
    """A table that marks the bytes between the given ends (inclusive) as separators."""
    table = np.zeros(256, bool)
    for low, high in spans:
        table[low:high + 1] = True
    return table


WHITE = separators((0x20, 0x20), (0x09, 0x0D))
NOT_ALNUM = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xA0761D6478BD642F)
    return x ^ (x >> U(32))


@functools.cache
def _powers(log2: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(1 << log2, base, U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(20, int(n).bit_length()))


def runs(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, bytes) of runs of rows of about `limit` bytes; null texts are empty. No text is cut."""
    col = pc.fill_null(batch.column(column).cast(pa.large_binary()), b"")
    if not len(col):
        return
    buffers = col.buffers()
    off = np.frombuffer(buffers[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, off[i:j + 1] - off[i], data[off[i]:off[j]]
        i = j


def prefix_sums(values: np.ndarray) -> np.ndarray:
    power, _ = _powers_to(len(values) + 1)
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * power[:len(values)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inverse = _powers_to(len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U) * U(0xE7037ED1A0B428DB))


def word_spans(off: np.ndarray, data: np.ndarray, table: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a run of rows, and where each row's words begin among them (one more at the end).

    `cuts` marks bytes at which a word begins anew.
    """
    inside = ~table[data]
    first = np.zeros(len(data) + 1, bool)
    if cuts is not None:
        first[:-1] = cuts
    first[off] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    now = np.append(inside, False)
    start = np.flatnonzero(now & (~before | first))
    end = np.flatnonzero(before & (~now | first))
    return start, end, np.searchsorted(start, off)


def words(off: np.ndarray, data: np.ndarray, table: np.ndarray = WHITE, lower: bool = True):
    """(hash of every word, where each row's words begin, starts, ends); A-Z are lower-cased first unless told otherwise."""
    data = LOWER[data] if lower else data
    start, end, rows = word_spans(off, data, table)
    return span_hashes(prefix_sums(VALUES[data]), start, end), rows, start, end


def grams(word: np.ndarray, rows: np.ndarray, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word runs of each row and where each row's begin.

    With `short`, a row of 1 to k-1 words has one hash for its whole sequence; otherwise it has none.
    """
    n = np.diff(rows)
    count = np.maximum(n - k + 1, 0)
    if short:
        count = np.where((n > 0) & (n < k), 1, count)
    begin = np.concatenate(([0], np.cumsum(count)))
    at = np.repeat(rows[:-1] - begin[:-1], count) + np.arange(begin[-1])
    end = np.minimum(at + k, np.repeat(rows[1:], count))
    return span_hashes(prefix_sums(word), at, end), begin


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def char_grams(points: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-character runs of each row of code points; a shorter row that isn't empty has one, of all it has."""
    n = np.diff(off)
    count = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    begin = np.concatenate(([0], np.cumsum(count)))
    at = np.repeat(off[:-1] - begin[:-1], count) + np.arange(begin[-1])
    end = np.minimum(at + k, np.repeat(off[1:], count))
    return span_hashes(prefix_sums(mix(points.astype(U) + U(1))), at, end), begin


def hash_words(text: bytes, table: np.ndarray = WHITE, lower: bool = True) -> np.ndarray:
    """Hashes of the words of one text, as `words` has them."""
    data = np.frombuffer(text, np.uint8)
    return words(np.array([0, len(data)]), data, table, lower)[0]
