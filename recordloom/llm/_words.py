"""Vectorised word and hash helpers over the UTF-8 bytes of Arrow string columns."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}

#: Fixed byte classes: white space of the word pattern, and the bytes that belong to alphanumeric words.
SPACES = b"\x09\x0a\x0b\x0c\x0d\x20"
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[list(SPACES)] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept per base."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U)
        have[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(have)
        if n > 1 << 25:
            del _POWERS[base]
    return have[:n]


class Rolling:
    """Prefix sums of a polynomial hash: the hash of any byte range is one subtraction and one product."""

    def __init__(self, data: np.ndarray) -> None:
        self._fill(_BYTE[data])

    @classmethod
    def over(cls, values: np.ndarray) -> "Rolling":
        """Of a sequence of 64-bit values in place of bytes."""
        self = cls.__new__(cls)
        self._fill(values)
        return self

    def _fill(self, values: np.ndarray) -> None:
        self.sums = np.empty(len(values) + 1, U)
        self.sums[0] = 0
        np.cumsum(values * powers(_BASE, len(values)), out=self.sums[1:])
        self.inverse = powers(_INVERSE, len(values) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(U))


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts with a line feed after each, and where each text starts (one more than texts). Null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    at = offsets - offsets[0]
    return np.insert(data, at[1:], 10), at + np.arange(len(at))


def spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(flags.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edges[::2], edges[1::2]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of each hold at most so many bytes, or are one text."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        i = 0
        while i < len(sizes):
            before = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(i, j - i)
            i = j


def doc_of(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The text that each position lies in."""
    return np.searchsorted(at, starts, "right") - 1
