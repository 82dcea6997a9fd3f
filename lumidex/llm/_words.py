"""Vectorised word scanning over Arrow string buffers.

Every operator of this subpackage reads words as maximal runs of bytes outside
``0x20, 0x09-0x0D``.  All of those are single-byte characters in UTF-8, so the
scan works on the raw Arrow buffer: no Python string is made per word.  Word
hashes are 64-bit polynomial hashes (random byte table, multiplication in
Z/2^64, finalised) computed from prefix sums; they are stable across runs and
machines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BLOCK = 1 << 18
_MULT = 0x9E3779B97F4A7C15 | 1
_OTHER = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, in place where the input is a fresh array."""
    x = np.array(x, dtype=U)
    x ^= x >> U(33)
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


_TABLE = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
_TABLE_2 = mix(np.arange(1, 257, dtype=U) * U(0xA24BAED4963EE407))
_known_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _known_powers or len(_known_powers[base][0]) < n:
        both = []
        for x in (base, pow(base, -1, 1 << 64)):
            a = np.full(max(n, BLOCK + 1), x, dtype=U)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        _known_powers[base] = tuple(both)
    return _known_powers[base]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = 0, second: bool = False) -> np.ndarray:
    """64-bit hashes of ``data[start:end]`` for each span; spans are absolute, ``base`` is where data[0] lies.

    ``second``: another, independent hash.
    """
    fwd, inv = _powers(len(data) + 1, _OTHER if second else _MULT)
    s = np.zeros(len(data) + 1, dtype=U)
    np.cumsum((_TABLE_2 if second else _TABLE)[data] * fwd[: len(data)], out=s[1:])
    a, b = start - base, end - base
    return mix((s[b] - s[a]) * inv[a] + (b - a).astype(U))


@dataclass
class Words:
    """Words of documents ``first .. first+len(counts)-1`` of a batch."""

    first: int
    data: np.ndarray  # the whole batch's bytes
    offsets: np.ndarray  # of these documents, absolute, one more than documents
    start: np.ndarray  # absolute byte positions
    end: np.ndarray
    bounds: np.ndarray  # word index at which each document begins, one more than documents
    hashes: np.ndarray | None
    second: np.ndarray | None = None  # independent hashes, where asked for

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.diff(self.bounds))


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets; null counts as the empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets


def _pieces(data: np.ndarray, lo: int, hi: int, space: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts [lo, hi) behind separators into pieces of about BLOCK bytes; a longer word stays whole."""
    while hi - lo > BLOCK:
        gap = np.flatnonzero(space[data[lo + BLOCK // 2 : lo + BLOCK]])
        if len(gap):
            cut = lo + BLOCK // 2 + int(gap[-1]) + 1
        else:
            cut, step = hi, lo + BLOCK
            while step < hi:
                gap = np.flatnonzero(space[data[step : step + BLOCK]])
                if len(gap):
                    cut = step + int(gap[0]) + 1
                    break
                step += BLOCK
        yield lo, cut
        lo = cut
    yield lo, hi


def scan(column: pa.Array | pa.ChunkedArray, *, hashes: bool = True, second: bool = False, block: int = BLOCK, space: np.ndarray = SPACE) -> Iterator[Words]:
    """Yields the words of all documents of a batch, a few documents (about ``block`` bytes) at a time.

    ``space`` tells which bytes separate words.
    """
    data, offsets = string_buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + block, side="right")) - 1)
        off = offsets[i : j + 1]
        starts, ends, hs, more = [], [], [], []
        for lo, hi in _pieces(data, int(off[0]), int(off[-1]), space):
            part = data[lo:hi]
            full = np.zeros(len(part) + 2, dtype=bool)
            full[1:-1] = ~space[part]
            first = full[1:-1] & ~full[:-2]
            last = full[1:-1] & ~full[2:]
            edge = off[(off >= lo) & (off < hi)] - lo  # a document's first byte starts a word, the byte before it ends one
            first[edge] = full[1:-1][edge]
            before = edge[edge > 0] - 1
            last[before] = full[1:-1][before]
            s, e = np.flatnonzero(first) + lo, np.flatnonzero(last) + lo + 1
            starts.append(s)
            ends.append(e)
            if hashes:
                hs.append(span_hashes(part, s, e, lo))
            if second:
                more.append(span_hashes(part, s, e, lo, True))
        start, end = np.concatenate(starts), np.concatenate(ends)
        yield Words(i, data, off, start, end, np.searchsorted(start, off), np.concatenate(hs) if hashes else None, np.concatenate(more) if second else None)
        i = j


def window_hashes(h: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of n consecutive words within a document, and the index of each window's first word."""
    if len(h) < n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    m = len(h) - n + 1
    key = np.zeros(m, dtype=U)
    for k in range(n):
        key = key * U(0x9FB21C651E98DF25) + (h[k : k + m] ^ U(0x5851F42D4C957F2D))
    # windows that would run past their document's end (a document shorter than n has no other)
    ok = np.ones(m, dtype=bool)
    ends = bounds[1:]
    for k in range(1, n):
        at = ends - k
        at = at[(at >= 0) & (at < m)]
        ok[at] = False
    at = np.flatnonzero(ok)
    return mix(key[at]), at


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans data[start:end] as a binary array."""
    size = end - start
    off = np.zeros(len(size) + 1, dtype=np.int64)
    np.cumsum(size, out=off[1:])
    flat = data[np.repeat(start - off[:-1], size) + np.arange(off[-1])]
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(flat)]).cast(pa.binary())
