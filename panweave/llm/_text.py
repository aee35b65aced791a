"""Vectorised word and line kernels over Arrow string buffers.

A chunk is a run of whole documents laid end to end in one byte array. Words are maximal runs of bytes other than
0x20 and 0x09-0x0D inside one document, which is the same as runs of code points, since UTF-8 uses none of these bytes
within a longer character. Every word and line gets a hash from prefix sums over the bytes, so no Python object is
made per word. A very long document is a chunk of its own, in which words are found and hashed piece by piece.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Spans are hashed as polynomials over the field of this prime at a fixed base drawn at random: two unlike spans of at
#: most n bytes have one hash for at most n of the 2**61 bases, however regular they are.
_PRIME = (1 << 61) - 1
_BASE = 1_318_271_440_092_874_693
#: Bytes hashed at a time; tables of powers have this length. Longer documents are cut into pieces.
_PIECE = 1 << 18
_LONG = 1 << 23

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32

_P, _30, _31, _61 = np.uint64(_PRIME), np.uint64(30), np.uint64(31), np.uint64(61)
_LOW30, _LOW31 = np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1)


def _reduce(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def _shift31(x: np.ndarray) -> np.ndarray:
    """x * 2**31 of any 64-bit x, below 2**62 and equal to it modulo the prime."""
    return ((x & _LOW30) << _31) + (x >> _30)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, of numbers below it: products of halves of 30 and 31 bits."""
    a1, a0, b1, b0 = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    return _reduce(a1 * b1 * np.uint64(2) + _shift31(a1 * b0 + a0 * b1) + a0 * b0)


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base**i for i < _PIECE, as halves of 31 and 30 bits, and base**-i; kept for the life of the worker."""
    out = []
    for base in (_BASE, pow(_BASE, -1, _PRIME)):
        p = np.ones(_PIECE, np.uint64)
        done = 1
        while done < _PIECE:
            p[done : 2 * done] = _times(p[:done], np.uint64(pow(base, done, _PRIME)))
            done *= 2
        out.append(p)
    return out[0] & _LOW31, out[0] >> _31, out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur style): spreads the sum over all bits."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


@dataclass
class Chunk:
    """data: bytes of the documents laid end to end; bounds: n + 1 offsets; rows: their places in the batch."""

    data: np.ndarray
    bounds: np.ndarray
    rows: slice

    def __len__(self) -> int:
        return len(self.bounds) - 1


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray  # exclusive
    bounds: np.ndarray  # word offsets of the documents, n + 1

    @property
    def per_doc(self) -> np.ndarray:
        return np.diff(self.bounds)


def chunks(column: pa.Array, limit: int = 1 << 19) -> Iterator[Chunk]:
    """Whole documents of a string column, about `limit` bytes at a time; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield Chunk(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], slice(i, j))
        i = j


def words(data: np.ndarray, bounds: np.ndarray) -> Words:
    """The words of a chunk; those of a long document that is alone in it are found piece by piece."""
    if len(bounds) == 2 and len(data) > _LONG:
        parts = [(a, words(data[a:b], np.array([0, b - a]))) for a, b in pieces(data)]
        start, end = (np.concatenate([getattr(w, side) + a for a, w in parts]) for side in ("start", "end"))
        return Words(start, end, np.array([0, len(start)]))
    n = len(data)
    ink = np.empty(n + 2, bool)
    ink[0] = ink[-1] = False
    np.logical_not(_IS_SPACE[data], out=ink[1:-1])
    begins = ink[1:] & ~ink[:-1]  # at i: a word may begin at i; at n: never
    ends = ink[:-1] & ~ink[1:]  # at i: a word may end before i
    cut = bounds[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    both = cut[ink[cut] & ink[cut + 1]]  # a border between two documents inside a run
    begins[both] = True
    ends[both] = True
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return Words(start, end, np.searchsorted(start, bounds))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand in the chunk; starts and ends rise.

    Prefix sums are taken over pieces of bounded size; only spans over a border between pieces need the sums before it.
    """
    low, high, inverse = _powers()
    n = -(-len(data) // _PIECE)
    at_start, at_end = np.zeros(len(start), np.uint64), np.zeros(len(end), np.uint64)
    before = [0]  # the sum of all earlier pieces
    for k in range(n):
        a, b = k * _PIECE, min(len(data), (k + 1) * _PIECE)
        value = data[a:b].astype(np.uint64) + np.uint64(1)
        sums = []
        for half in (low, high):  # at most 2**8 * 2**31 * 2**18
            s = np.zeros(b - a + 1, np.uint64)
            np.cumsum(value * half[: b - a], out=s[1:])
            sums.append(s)
        starts, ends = slice(*np.searchsorted(start, (a, b))), slice(*np.searchsorted(end, (a, b), side="right"))
        for out, places, some in ((at_start, start, starts), (at_end, end, ends)):
            here = places[some] - a
            out[some] = _reduce(_shift31(sums[1][here]) + sums[0][here])
        whole = int(sums[0][-1]) + (int(sums[1][-1]) << 31)
        before.append((before[-1] + whole * pow(_BASE, a, _PRIME)) % _PRIME)
    base = np.array([pow(_BASE, k * _PIECE, _PRIME) for k in range(n)], np.uint64)
    back = np.array([pow(_BASE, -k * _PIECE, _PRIME) for k in range(n)], np.uint64)
    sums = np.array(before, np.uint64)
    out = np.empty(len(start), np.uint64)
    for a in range(0, len(start), _PIECE):
        b, e, s, t = start[a : a + _PIECE], end[a : a + _PIECE], at_start[a : a + _PIECE], at_end[a : a + _PIECE]
        h = _times(_reduce(t + _P - s), inverse[b % _PIECE])
        i, j = b // _PIECE, np.maximum(e - 1, 0) // _PIECE
        over = np.flatnonzero(i != j)
        if len(over):
            i, j = i[over], j[over]
            far = _reduce(_times(t[over], base[j]) + sums[j] + (_P - _times(s[over], base[i])) + (_P - sums[i]))
            h[over] = _times(_times(far, back[i]), inverse[b[over] % _PIECE])
        out[a : a + _PIECE] = mix(h)
    return out


_SHINGLE = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(64)]


def pieces(data: np.ndarray, limit: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of about `limit` bytes that end behind a separator, so that no word comes apart."""
    a = 0
    while a < len(data):
        b = a + limit
        while b < len(data):  # on to the next separator
            gap = np.flatnonzero(_IS_SPACE[data[b : b + 4096]])
            if len(gap):
                b += int(gap[0]) + 1
                break
            b += 4096
        b = min(b, len(data))
        yield a, b
        a = b


def word_hashes(chunk: Chunk, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and the word offsets of the documents."""
    if len(chunk) > 1:
        data = LOWER_ASCII[chunk.data] if lower else chunk.data
        w = words(data, chunk.bounds)
        return span_hash(data, w.start, w.end), w.bounds
    out = [np.zeros(0, np.uint64)]
    for a, b in pieces(chunk.data):
        data = LOWER_ASCII[chunk.data[a:b]] if lower else chunk.data[a:b]
        w = words(data, np.array([0, b - a]))
        out.append(span_hash(data, w.start, w.end))
    hashed = np.concatenate(out)
    return hashed, np.array([0, len(hashed)])


def window_hash(word: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words in a chunk; callers keep those inside one document.

    Sums of hashes that mix() has spread, at odd factors; meant for windows of a few words.
    """
    m = max(0, len(word) - width + 1)
    total = np.zeros(m, np.uint64)
    for k in range(width):
        total += word[k : k + m] * _SHINGLE[k % 64]
    return mix(total)


def inside(bounds: np.ndarray, width: int, total: int) -> np.ndarray:
    """Marks the starts of windows of `width` words that lie inside one document."""
    ok = np.ones(max(0, total - width + 1), bool)
    for k in range(1, width):
        at = bounds[1:-1] - k
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


def shingle_sets(chunk: Chunk, width: int = 5, lower: bool = True) -> tuple[list[np.ndarray], np.ndarray]:
    """The sorted distinct shingle hashes of each document, and its number of words.

    A document with 1 to width - 1 words has its whole sequence as its one shingle; one without words has none.
    """
    hashed, bounds = word_hashes(chunk, lower)
    windows = window_hash(hashed, width)
    out, per_doc = [], np.diff(bounds)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(windows[a : b - width + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            part = hashed[a:b]
            out.append(mix(np.array([int((part * np.array(_SHINGLE[: b - a])).sum(dtype=np.uint64)) ^ (b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out, per_doc
