"""Vectorised work on Arrow string batches: whole words and word shingles as 64-bit hashes.

A batch's UTF-8 buffer is taken as one byte array, so no Python string is made for each word.
Words are maximal runs of bytes other than ASCII white space (0x20, 0x09-0x0D), lower-cased A-Z.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time; one longer text is worked on alone.
STEP = 2 << 20
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Which of the next eight bytes belong to a span of so many bytes.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


@dataclass
class Texts:
    """Some rows' texts: their bytes back to back, and where each begins and ends."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def texts(column: pa.Array | pa.ChunkedArray, step: int = STEP) -> Iterator[tuple[int, Texts]]:
    """Runs of rows with about ``step`` bytes, each with its first row; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if not len(column):
        return
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + step, "right")) - 1)
        hi = min(hi, len(column))
        yield lo, Texts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


@dataclass
class Words:
    """Words of some texts. first[i]:first[i + 1] are text i's."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """One 64-bit hash for each byte span, equal for equal bytes (A-Z lower-cased if ``lower``).

    A span of up to 16 bytes is two integers that are mixed; a longer one is hashed by BLAKE2b, so no rule
    for making texts, such as one that cancels in a polynomial, gives different words one hash.
    """
    size = ends - starts
    text = np.zeros(len(data) + 16, np.uint8)
    text[: len(data)] = _LOWER[data] if lower else data
    eight = np.ndarray(len(data) + 9, "<u8", text, strides=(1,))  # the eight bytes from each place on
    h = mixed((eight[starts] & _MASK[np.minimum(size, 8)]) + size.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    longer = np.flatnonzero(size > 8)
    h[longer] = mixed(h[longer] * _U(0xD6E8FEB86659FD93) + (eight[starts[longer] + 8] & _MASK[np.minimum(size[longer] - 8, 8)]))
    for i in np.flatnonzero(size > 16).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(text[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h


def words(t: Texts, lower: bool = True) -> Words:
    n = len(t.data)
    solid = ~_SPACE[t.data]
    edge = np.zeros(n + 1, bool)
    edge[t.offsets] = True
    before = np.ones(n, bool)
    before[1:] = ~solid[:-1]
    after = np.ones(n, bool)
    after[:-1] = ~solid[1:]
    starts = np.flatnonzero(solid & (before | edge[:n]))
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    return Words(spans_hash(t.data, starts, ends, lower), starts, ends, np.searchsorted(starts, t.offsets))


_PLACE = mixed(np.arange(1, 17, dtype=np.uint64)) | _U(1)


def shingles(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words, repeats included, and where each text's begin and end.

    A text with fewer words, but at least one, has its whole sequence as the only one.
    """
    count = np.diff(w.first)
    many = np.where(count >= size, count - size + 1, (count > 0).astype(count.dtype))
    first = np.zeros(len(many) + 1, np.int64)
    np.cumsum(many, out=first[1:])
    if not first[-1]:
        return np.zeros(0, np.uint64), first
    # the word where each shingle begins
    begins = np.arange(first[-1]) - np.repeat(first[:-1] - w.first[:-1], many)
    padded = np.concatenate([w.hashes, np.zeros(size, np.uint64)])
    length = np.repeat(np.minimum(count, size), many)
    out = np.zeros(first[-1], np.uint64)
    for j in range(size):
        part = padded[begins + j] * _PLACE[j]
        out += part if j == 0 else np.where(length > j, part, _U(0))
    return mixed(out + length.astype(np.uint64)), first
