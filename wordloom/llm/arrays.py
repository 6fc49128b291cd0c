"""Word and window arithmetic on Arrow text columns (numpy, inside Spark tasks).

Tasks receive text as Arrow batches.  :func:`pieces` cuts a batch at row
boundaries into pieces of a few megabytes, :class:`Words` finds the words of a
piece by a byte table and hashes each word to 64 bits, and :meth:`Words.windows`
hashes every run of ``n`` words.  All cost a bounded number of array passes, so
a task's memory follows the piece and not the batch.

A word is a maximal run of bytes that a 256-entry table marks; for the patterns
used here (ASCII classes negated) bytes and code points give the same runs, as
every byte of a non-ASCII code point is above 0x7F.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 21

_C1 = np.uint64(0xBF58476D1CE4E5B9)
_C2 = np.uint64(0x94D049BB133111EB)
_BASE = 0xD1342543DE82EF95
_INV = pow(_BASE, -1, 1 << 64)


def not_space() -> np.ndarray:
    """Bytes of ``[^\\x20\\x09-\\x0D]``."""
    t = np.ones(256, dtype=bool)
    t[[32, 9, 10, 11, 12, 13]] = False
    return t


def letters_digits() -> np.ndarray:
    """Bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``."""
    t = np.zeros(256, dtype=bool)
    t[48:58] = t[97:123] = t[128:] = True
    return t


def fold_ascii() -> np.ndarray:
    """Byte table that lower-cases A-Z."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


NOT_SPACE, LETTERS_DIGITS, FOLD = not_space(), letters_digits(), fold_ascii()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the window base and of its inverse, grown on demand per worker."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", _BASE), ("down", _INV)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up[:n], cls.down[:n]


class Piece:
    """Some rows of a batch: their bytes (padded by 8) and byte offsets."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray):
        self.lo, self.hi, self.data, self.offsets = lo, hi, data, offsets

    @property
    def rows(self) -> int:
        return self.hi - self.lo


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null rows have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset:column.offset + n + 1]
    return np.frombuffer(data, dtype=np.uint8), offsets


def pieces(column, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """Cuts a text column at row boundaries into pieces of about ``limit`` bytes."""
    data, offsets = text_buffers(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        a, b = int(offsets[lo]), int(offsets[hi])
        part = np.zeros(b - a + 8, dtype=np.uint8)
        part[:b - a] = data[a:b]
        yield Piece(lo, hi, part, offsets[lo:hi + 1] - a)
        lo = hi


class Words:
    """Words of a piece: byte ranges, row of each word, 64-bit hashes.

    ``first[r] .. first[r + 1]`` are the words of the piece's row ``r``.
    """

    def __init__(self, piece: Piece, table: np.ndarray = NOT_SPACE, fold: np.ndarray | None = None):
        self.piece = piece
        n, offs = len(piece.data) - 8, piece.offsets
        data = piece.data if fold is None else fold[piece.data]
        self.data = data
        marks = table[data[:n]]
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0] = after[-1] = False
            before[1:], after[:-1] = marks[:-1], marks[1:]
            inner = offs[(offs > 0) & (offs < n)]
            before[inner] = False
            after[inner - 1] = False
        self.start = np.flatnonzero(marks & ~before)
        self.end = np.flatnonzero(marks & ~after) + 1
        self.first = np.searchsorted(self.start, offs)
        self.counts = np.diff(self.first)
        self._hash: np.ndarray | None = None
        self._row: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def row(self) -> np.ndarray:
        """Row (within the piece) of each word."""
        if self._row is None:
            self._row = np.repeat(np.arange(self.piece.rows), self.counts)
        return self._row

    @property
    def hash(self) -> np.ndarray:
        """64-bit hash of each word: its bytes in groups of eight, then its length."""
        if self._hash is None:
            length = self.end - self.start
            eight = np.ndarray(shape=(max(len(self.data) - 7, 1),), dtype="<u8", buffer=np.ascontiguousarray(self.data), strides=(1,))
            h = length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            at, left, live = self.start, length, None
            while len(at):
                got = eight[at]
                short = left < 8
                if short.any():
                    keep = np.minimum(left, 8).astype(np.uint64)
                    got = np.where(short, got & ((np.uint64(1) << (keep * np.uint64(8)) % np.uint64(64)) - np.uint64(1)), got)
                if live is None:
                    h = mix(h ^ got)
                    more = np.flatnonzero(left > 8)
                    live = more
                else:
                    h[live] = mix(h[live] ^ got)
                    more = np.flatnonzero(left > 8)
                    live = live[more]
                at, left = at[more] + 8, left[more] - 8
            self._hash = h
        return self._hash

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of ``n`` words inside a row."""
        total = len(self)
        if total < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        up, down = _Powers.upto(total + 1)
        sums = np.zeros(total + 1, dtype=np.uint64)
        np.cumsum(self.hash * up[:total], out=sums[1:])
        ids = np.arange(total - n + 1)
        ids = ids[self.row[:total - n + 1] == self.row[n - 1:]]
        return ids, mix((sums[ids + n] - sums[ids]) * down[ids] + np.uint64(n))

    def range_hash(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hash of the words ``lo .. hi`` (exclusive); equal to ``windows`` for equal lengths."""
        up, down = _Powers.upto(len(self) + 1)
        sums = np.zeros(len(self) + 1, dtype=np.uint64)
        np.cumsum(self.hash * up[:len(self)], out=sums[1:])
        return mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64))

    def text(self, lo: int, hi: int) -> bytes:
        """Words ``lo .. hi`` joined by one space."""
        d = self.data
        return b" ".join(d[a:b].tobytes() for a, b in zip(self.start[lo:hi], self.end[lo:hi]))


def signed(h: np.ndarray) -> np.ndarray:
    """The hashes as Spark longs."""
    return h.view(np.int64)


def in_sorted(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Position of each of ``values`` in the sorted ``wanted``, -1 where absent."""
    if not len(wanted):
        return np.full(len(values), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)
    return np.where(wanted[at] == values, at, -1)
