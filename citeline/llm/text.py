"""Words of many texts at once: byte classes, spans and hashes computed on whole Arrow buffers with numpy.

A word hash is a polynomial over the bytes modulo 2**64, taken from one running sum over the buffer, and then
mixed by an invertible function. Hashing costs a few array passes a byte and no Python object per word.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 17  # bytes handled at once; texts are never cut, a longer text makes a longer segment

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_M1_INV, _M2_INV = np.uint64(pow(0xBF58476D1CE4E5B9, -1, 2**64)), np.uint64(pow(0x94D049BB133111EB, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _unshift(x: np.ndarray, by: int) -> np.ndarray:
    out = x
    for _ in range(64 // by):
        out = x ^ (out >> np.uint64(by))
    return out


def unmix(x: np.ndarray) -> np.ndarray:
    """Reverses ``mix``."""
    x = _unshift(x, 31) * _M2_INV
    x = _unshift(x, 27) * _M1_INV
    return _unshift(x, 30)


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, nothing else."""
    return raw + ((raw - np.uint8(65)) < 26).view(np.uint8) * np.uint8(32)


def in_words(raw: np.ndarray) -> np.ndarray:
    """Bytes outside the white space ``[\\x20\\x09-\\x0D]``."""
    return (raw != 0x20) & ((raw - np.uint8(9)) > 4)


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SEGMENT + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        _powers[base] = have
    return have[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary())
    if column.null_count:
        column = column.fill_null(b"")
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind, len(column) + 1 + column.offset)[column.offset:].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def segments(offsets: np.ndarray, size: int = SEGMENT):
    """Row ranges whose bytes make about ``size``; a row is never cut."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def runs(inside: np.ndarray, starts_of_rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of maximal runs of True that do not cross a row start."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = (edges[1::2], edges[::2]) if inside[0] else (edges[::2], edges[1::2])
    if inside[0]:
        starts = np.concatenate([[0], starts])
    if inside[-1]:
        ends = np.concatenate([ends, [n]])
    cuts = np.unique(starts_of_rows[(starts_of_rows > 0) & (starts_of_rows < n)])
    cuts = cuts[inside[cuts] & inside[cuts - 1]]
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends


class Hasher:
    """Hashes of spans of one byte buffer."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.sums = np.zeros(n + 1, np.uint64)
        values = raw.astype(np.uint64)
        values *= powers(_BASE, n)
        np.cumsum(values, out=self.sums[1:])
        self.back = powers(_INVERSE, n + 1)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        value = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        return mix(value + (ends - starts).astype(np.uint64))


def hash_of(word: bytes) -> int:
    """The hash that ``Hasher`` gives a span with these bytes."""
    raw = np.frombuffer(word, np.uint8)
    return int(Hasher(raw).spans(np.array([0]), np.array([len(word)]))[0])


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every lower-cased word, index of the first word of every row plus the end).

    Words are maximal runs without the white space ``[\\x20\\x09-\\x0D]``; A-Z are lower-cased, nothing else.
    """
    raw = lowered(raw)
    starts, ends = runs(in_words(raw), offsets)
    return Hasher(raw).spans(starts, ends), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every window of ``size`` words, row of each); a shorter row that has words gives its whole sequence."""
    rows = len(first) - 1
    counts = np.diff(first)
    windows = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(rows), windows)
    place = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = first[:-1][row] + place
    length = np.minimum(counts, size)[row]
    out = np.zeros(len(row), np.uint64)
    for k in range(size):
        live = length > k
        got = out[live] * np.uint64(0x9E3779B97F4A7C15) + words[start[live] + k] if not live.all() else out * np.uint64(0x9E3779B97F4A7C15) + words[start + k]
        if live.all():
            out = got
        else:
            out[live] = got
    return mix(out + length.astype(np.uint64)), row
