"""Vectorised word kernels over Arrow text columns.

Everything here works on the UTF-8 buffer of an Arrow string array: words are byte ranges, and a word's
64-bit hash is made eight bytes at a time, so no Python object is created per word. All separators used by
the operators are ASCII, hence byte-wise splitting never cuts a multi-byte character.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: Everything below 0x80 but digits and lower-case letters.
NOT_ALNUM = bytes(b for b in range(0x80) if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Bytes of text that a map works on at a time.
MAP_BYTES = 2 << 20
#: Words beyond this many bytes are hashed one by one.
LONG_WORD = 96


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x ^= x >> np.uint64(27)
    x *= _C
    return x ^ (x >> np.uint64(31))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = MAP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of whole rows, of about so many bytes of text or a single row; none is empty."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // most
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in itertools.pairwise(edges):
            if a < b:
                yield batch.slice(a, b - a)


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and len + 1 offsets into them; a null text is empty."""
    column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


class Words:
    """The words of a batch of texts: ``data[starts[i]:ends[i]]`` is word i, text d has words first[d]:first[d + 1]."""

    def __init__(self, column: pa.Array | pa.ChunkedArray, fold: bool = False, separators: bytes = SPACES) -> None:
        self.data, self.offsets = text_buffer(column)
        if fold:
            self.data = _FOLD[self.data]
        table = np.zeros(256, bool)
        table[list(separators)] = True
        inside = ~table[self.data]
        before = np.empty_like(inside)
        before[1:], before[:1] = inside[:-1], False
        cuts = self.offsets[1:-1][self.offsets[1:-1] < len(inside)]
        before[cuts] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[:-1], after[-1:] = inside[1:], False
        after[cuts[cuts > 0] - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.inside = inside
        self.first = np.searchsorted(self.starts, self.offsets)
        self.n = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), self.n)

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def hashes(self) -> np.ndarray:
        return hash_ranges(self.data, self.starts, self.ends)


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every byte range."""
    size = ends - starts
    out = mix(size.astype(np.uint64) * _A + _A)
    if not len(size):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded.view(np.uint8)[:8].view("<u8"), (len(data) + 1,), (1,))
    short = np.flatnonzero(size <= LONG_WORD)
    at, left, k = starts[short], size[short], 0
    acc = out[short]
    live = np.arange(len(short))
    while len(live):
        acc[live] = mix((acc[live] ^ (eight[at[live] + k] & _KEEP[np.minimum(left[live] - k, 8)])) * _A + _C)
        k += 8
        live = live[left[live] > k]
    out[short] = acc
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, odd: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2**64, and of its inverse; kept up to a million."""
    if n <= 1 << 20 and odd in _POWERS and len(_POWERS[odd][0]) >= n:
        return _POWERS[odd][0][:n], _POWERS[odd][1][:n]
    size = max(n, 1 << 16)
    out = []
    for base in (odd, pow(odd, -1, 1 << 64)):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    if size <= 1 << 20:
        _POWERS[odd] = out[0], out[1]
    return out[0][:n], out[1][:n]


def windows(hashes: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """The hash of every run of width hashes, len - width + 1 of them; lanes are independent of each other."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    odd = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)[lane]
    power, inverse = _powers(len(hashes), odd)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum((hashes if not lane else mix(hashes + _A)) * power, out=total[1:])
    return mix((total[width:] - total[:-width]) * inverse[:n] + np.uint64(width))


def window_starts(words: Words, width: int) -> np.ndarray:
    """Positions at which a window of so many words of one text starts."""
    ok = np.zeros(len(words) + 1, np.int32)
    many = words.n >= width
    np.add.at(ok, words.first[:-1][many], 1)
    np.add.at(ok, words.first[1:][many] - width + 1, -1)
    return np.flatnonzero(np.cumsum(ok[:-1]) > 0)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n positions lie in a run of the width that starts at one of starts."""
    step = np.zeros(n + width + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return np.cumsum(step[:n]) > 0


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[d]:first[d + 1]], 0 where that is empty. Works text by text: exact for floats of any batch."""
    if not len(values):
        return np.zeros(len(first) - 1, values.dtype if values.dtype != bool else np.int64)
    values = values.astype(np.int64) if values.dtype == bool else values
    empty = first[:-1] == first[1:]
    out = np.add.reduceat(np.append(values, values.dtype.type(0)), first[:-1])
    out[empty] = 0
    return out


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending uint64 keys as byte planes of their differences; the high planes are all but zero and compress away."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def tally(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the sum of their weights (rows without), and each row's place among them."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.empty(len(keys), bool)
    new[:1], new[1:] = True, ordered[1:] != ordered[:-1]
    at = np.flatnonzero(new)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    if weights is None:
        return ordered[at], np.diff(np.append(at, len(keys))), place
    return ordered[at], np.add.reduceat(weights[order], at) if len(at) else weights[:0], place
