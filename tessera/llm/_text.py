"""Vectorised byte and word kernels over Arrow string columns.

Everything here works on slices of a few hundred kilobytes, so a Python worker needs a few tens of
megabytes whatever the size of an Arrow batch.  Hashes are polynomials modulo 2**64 over an odd base,
which is invertible, so the hash of any substring is one subtraction and one product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
WORD_BASE = 0xD1342543DE82EF95
WORD_INV = pow(WORD_BASE, -1, 1 << 64)

SLICE_BYTES = 1 << 19

#: True for the bytes that stand between words.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: True for the ASCII bytes that are neither letters nor digits; bytes over 0x7F belong to words.
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[:0x30] = NON_ALNUM[0x3A:0x61] = NON_ALNUM[0x7B:0x80] = True
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1024)
        step = np.full(size, base, U64)
        step[0] = 1
        have = _powers[base] = np.multiply.accumulate(step)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values.astype(U64) * powers(base, len(values)), out=out[1:])
    return out


class Slice:
    """Rows ``first`` to ``first + n`` of a batch: their bytes end to end, row i at offsets[i]:offsets[i+1]."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets, self.n = first, data, offsets, len(offsets) - 1

    def words(self, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of each word, and the index of each row's first word (n + 1 values)."""
        inside = ~separators[self.data]
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.offsets] = True  # a word never crosses rows
        before = np.zeros_like(inside)
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.zeros_like(inside)
        after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def word_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = prefix_sums(self.data.astype(U64) + U64(1), BASE)
        raw = (sums[ends] - sums[starts]) * powers(BASE_INV, len(sums))[starts]
        return mix(raw + (ends - starts).astype(U64) * U64(0xA0761D6478BD642F))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The column in slices of about ``limit`` bytes (one row at least); nulls count as empty."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, offsets_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offsets_buffer, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield Slice(row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


def ngram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive values; runs across rows are there too, for the caller to leave out."""
    if len(hashes) < k:
        return np.zeros(0, U64)
    sums = prefix_sums(hashes, WORD_BASE)
    return mix((sums[k:] - sums[:-k]) * powers(WORD_INV, len(sums))[: len(sums) - k])


def byte_ngram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    if len(data) < k:
        return np.zeros(0, U64)
    sums = prefix_sums(data.astype(U64) + U64(1), BASE)
    return mix((sums[k:] - sums[:-k]) * powers(BASE_INV, len(sums))[: len(sums) - k])


def sliding(values: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """pick over each run of ``width`` consecutive values."""
    have, out = 1, values
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    return pick(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


def spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


def covered(length: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``length`` positions lie in any of the half-open intervals."""
    level = np.zeros(length + 1, np.int32)
    np.add.at(level, starts, 1)
    np.add.at(level, ends, -1)
    return np.cumsum(level[:-1]) > 0
