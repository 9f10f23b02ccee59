"""Words of whole batches of texts as numpy arrays.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; as UTF-8 holds these bytes
only as those characters, this equals the code point class ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = (np.arange(256) + 1).astype(np.uint64)
_LOWER = _BYTE.copy()
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.ones(1 << 10, np.uint64)
#: Bytes that are hashed at once, which bounds what a long text takes beside itself.
_AT_ONCE = 1 << 19


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n or _POWERS[1] == 1:
        size = max(1 << 10, 1 << int(n).bit_length())
        p = np.full(size, _BASE, np.uint64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on a copy."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


@dataclass
class Words:
    data: np.ndarray  #: the bytes of the block
    text_at: np.ndarray  #: byte offsets of the texts, one more than texts
    start: np.ndarray  #: byte offset of each word
    end: np.ndarray
    hash: np.ndarray  #: 64 bits for each word
    word_at: np.ndarray  #: index of each text's first word, one more than texts


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its texts' offsets; null counts as empty."""
    if col.null_count:
        col = pc.fill_null(col, "" if not pa.types.is_binary(col.type) else b"")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if large else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[offsets[0] : offsets[-1]] if buf is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def runs(inside: np.ndarray, text_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs where ``inside`` holds; a run ends with its text."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[text_at] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of table[data[start:end]] for each of the non-empty, ordered, disjoint runs."""
    out = np.zeros(len(start), np.uint64)
    length = end - start
    before = np.append(0, np.cumsum(length))
    first = 0
    while first < len(start):
        last = max(first + 1, int(np.searchsorted(before, before[first] + _AT_ONCE, "right")) - 1)
        n = length[first:last]
        at = before[first:last] - before[first]
        within = np.arange(before[last] - before[first], dtype=np.int64) - np.repeat(at, n)
        powers = _powers(int(n.max()) + 1)
        picked = table[data[np.repeat(start[first:last], n) + within]]
        out[first:last] = mix(np.add.reduceat(picked * powers[within], at) + n.astype(np.uint64))
        first = last
    return out


def words(col: pa.Array, lower: bool = True) -> Words:
    data, text_at = raw(col)
    start, end = runs(~_SPACE[data], text_at)
    h = hash_runs(data, start, end, _LOWER if lower else _BYTE)
    return Words(data, text_at, start, end, h, np.searchsorted(start, text_at))


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word shingles of one word sequence; with fewer words, of the whole sequence."""
    if len(h) < n:
        n = len(h)
    if not n:
        return np.zeros(0, np.uint64)
    m = len(h) - n + 1
    out = np.full(m, n, np.uint64)
    for k in range(n):
        out = mix(out * U64(0xD6E8FEB86659FD93) + h[k : k + m])
    return out


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of every n-word window that lies in one text, and the index of its first word."""
    m = len(w.hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(m, n, np.uint64)
    for k in range(n):
        out = mix(out * U64(0xD6E8FEB86659FD93) + w.hash[k : k + m])
    left = np.repeat(w.word_at[1:], np.diff(w.word_at))[:m]  # where each window's text ends
    at = np.flatnonzero(np.arange(m) + n <= left)
    return out[at], at


def code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many code points begin before each byte offset."""
    return at - np.searchsorted(np.flatnonzero((data & 0xC0) == 0x80), at)
