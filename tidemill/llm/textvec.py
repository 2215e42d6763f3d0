"""Words and word n-grams of whole Arrow text columns, as NumPy arrays: no Python loop over words.

A batch's texts are one byte buffer. Words are maximal runs of bytes that a table marks; their 64-bit hashes are mixed from 8
bytes of all words at a time. Long batches are cut into slices of SLICE bytes, so that memory is bounded by the slice, or by
the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE = 1 << 20
LONG_WORD = 256
P = 0x9E3779B97F4A7C15
Q = 0xD6E8FEB86659FD93
M64 = (1 << 64) - 1

#: Not white space: all bytes but 0x20 and 0x09 to 0x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Digits, ASCII letters and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about size bytes, one row at least."""
    n = len(column)
    if not n:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < n:
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right"))
        b = max(b, a + 1)
        yield a, b
        a = b


class Words:
    """The words of some texts: byte ranges start:end, and at[d]:at[d + 1] are document d's words. spelling maps bytes first."""

    def __init__(self, column: pa.Array, table: np.ndarray, fold: bool, spelling: np.ndarray | None = None):
        column = pc.fill_null(column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column, b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        buffer = column.buffers()[2]
        self.data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.data = self.data if spelling is None else spelling[self.data]
        self.offsets, self.fold, self.n = offsets - offsets[0], fold, len(column)
        inside = table[self.data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cut = self.offsets[(self.offsets > 0) & (self.offsets < len(self.data))]
        first[cut] = inside[cut]
        last[cut - 1] = inside[cut - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.at)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes: 8 bytes at a time are mixed into it, with the length. Each step is a bijection
        of the state, so words of up to 8 bytes have no clash but by their lengths, and no structure of longer words
        (periods, complements) makes them clash. Words over LONG_WORD bytes are hashed by XXH64 instead."""
        data = np.zeros(len(self.data) + 8, np.uint8)
        data[: len(self.data)] = LOWER[self.data] if self.fold else self.data
        eight = np.ndarray(len(self.data) + 1, "<u8", buffer=data, strides=(1,))  # the 8 bytes from each place on
        start, length = self.start, self.end - self.start
        out = mix(length.astype(np.uint64) * np.uint64(P) + np.uint64(Q))
        live, k = np.flatnonzero(length <= LONG_WORD), 0
        while len(live):
            left = np.minimum(length[live] - 8 * k, 8).astype(np.uint64)
            chunk = eight[start[live] + 8 * k] & (np.uint64(M64) >> (np.uint64(64) - np.uint64(8) * left))
            out[live] = mix((out[live] ^ chunk) * np.uint64(P) + np.uint64(k))
            k += 1
            live = live[length[live] > 8 * k]
        for i in np.flatnonzero(length > LONG_WORD):
            out[i] = xxhash.xxh64_intdigest(data[start[i] : self.end[i]].tobytes())
        return out

    def fits(self, k: int) -> np.ndarray:
        """For each word, whether k words of its document start with it."""
        return np.arange(len(self.start)) + k <= np.repeat(self.at[1:], self.counts)

    def bytes(self, i: int, j: int) -> bytes:
        """Words i to j - 1, joined by one space."""
        data = LOWER[self.data[self.start[i] : self.end[j - 1]]] if self.fold else self.data[self.start[i] : self.end[j - 1]]
        base = self.start[i]
        return b" ".join(data[s - base : e - base].tobytes() for s, e in zip(self.start[i:j], self.end[i:j]))


    def spelled(self) -> tuple[bytes, np.ndarray]:
        """All words, a space after each, and where each starts; at the end, where the next would."""
        length = self.end - self.start + 1
        place = np.concatenate([[0], np.cumsum(length)])
        out = self.data[np.minimum(np.arange(place[-1]) + np.repeat(self.start - place[:-1], length), max(len(self.data) - 1, 0))] if len(length) else np.zeros(0, np.uint8)
        out = LOWER[out] if self.fold else out
        out[place[1:] - 1] = 0x20
        return out.tobytes(), place


def ngrams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words i to i + k - 1 at each i, without regard to documents; len(words) - k + 1 of them."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h ^= h >> np.uint64(29)
        h *= np.uint64(Q)
        h += words[j : j + n]
    return mix(h + np.uint64(k))


def per_document(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[d]:at[d + 1]], whole numbers: sums of floats would depend on the texts before."""
    if values.dtype.kind == "f":
        raise TypeError("whole numbers only")
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def joined(words: Words, keep: np.ndarray) -> pa.Array:
    """Each text's kept words, joined by one space."""
    kept = np.flatnonzero(keep)
    start, length = words.start[kept], words.end[kept] - words.start[kept] + 1
    place = np.concatenate([[0], np.cumsum(length)])
    out = words.data[np.minimum(np.arange(place[-1]) + np.repeat(start - place[:-1], length), max(len(words.data) - 1, 0))] if len(kept) else np.zeros(0, np.uint8)
    out[place[1:] - 1] = 0x20
    at = place[np.searchsorted(kept, words.at)]
    last = at[1:][np.diff(at) > 0] - 1  # the space after each text's last word goes
    out = np.delete(out, last)
    offsets = at - np.concatenate([[0], np.cumsum(np.diff(at) > 0)])
    return pa.Array.from_buffers(pa.string(), words.n, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])
