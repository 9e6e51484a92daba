"""Words, word hashes and window hashes of whole batches of texts, in numpy.

Texts are taken as one UTF-8 buffer with offsets, as Arrow holds them, so no string object is made for a word. A hash is
a polynomial modulo 2^64 read off a running sum, then mixed; any window of words costs two lookups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 19  # bytes looked at together; a longer piece is taken only for a single longer word
_U = np.uint64
_BASE, _WORD_BASE, _SECOND_BASE = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0xA24BAED4963EE407)

SPACED = np.ones(256, bool)  # words are runs of anything but \x20 and \x09-\x0D
SPACED[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)  # words are runs of digits, lower-case letters and everything beyond ASCII
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which every bit depends on every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of an odd base modulo 2^64, and of its inverse, as far as they were needed."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.inverse, self.up, self.down = base, _U(pow(int(base), -1, 1 << 64)), None, None

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.up is None or len(self.up) < n:
            ones = np.ones(n + PIECE // 2, np.uint64)
            self.up, self.down = ones.copy(), ones
            self.up[1:], self.down[1:] = self.base, self.inverse
            np.cumprod(self.up, out=self.up)
            np.cumprod(self.down, out=self.down)
        return self.up[:n], self.down[:n]


_bytes, _words, _second = _Powers(_BASE), _Powers(_WORD_BASE), _Powers(_SECOND_BASE)


def buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n + 1 offsets into them. NULL is an empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = SPACED, lower: bool = False
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of every word, and n + 1 offsets of the texts into the words."""
    hashes, firsts, lasts, at, n = [], [], [], 0, len(data)
    while at < n:
        end = min(at + PIECE, n)
        while end < n:  # on to a byte outside words, or to the next text
            ahead = data[end:end + 65536]
            gap = np.flatnonzero(~kind[LOWER[ahead] if lower else ahead])
            text = int(offsets[np.searchsorted(offsets, end)])
            end = min(end + (int(gap[0]) if len(gap) else len(ahead)), text)
            if len(gap) or end == text:
                break
        b = data[at:end]
        b = LOWER[b] if lower else b
        inside = kind[b]
        cuts = offsets[np.searchsorted(offsets, at, "right"):np.searchsorted(offsets, end)] - at
        before = np.concatenate(([False], inside[:-1]))
        before[cuts] = False
        after = np.concatenate((inside[1:], [False]))
        after[cuts - 1] = False
        first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        up, down = _bytes.upto(len(b))
        run = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + _U(1)) * up, out=run[1:])
        hashes.append(mix((run[last] - run[first]) * down[first] + (last - first).astype(np.uint64)))
        firsts.append(first + at)
        lasts.append(last + at)
        at = end
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    first = np.concatenate(firsts)
    return np.concatenate(hashes), first, np.concatenate(lasts), np.searchsorted(first, offsets)


class Windows:
    """Hashes of windows of words: `of(start, end)` for word numbers; `second` is an independent hash."""

    def __init__(self, hashes: np.ndarray, second: bool = False) -> None:
        self.powers = (_second if second else _words).upto(len(hashes) + 1)
        self.run = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self.powers[0][:len(hashes)], out=self.run[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.run[end] - self.run[start]) * self.powers[1][start] + (end - start).astype(np.uint64))


def starts(at: np.ndarray, length: int) -> np.ndarray:
    """Word numbers at which a window of `length` words begins and stays inside its text; `at`: offsets of the texts."""
    left = np.repeat(at[1:], np.diff(at)) - np.arange(at[-1])
    return np.flatnonzero(left >= length)
