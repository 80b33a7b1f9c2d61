"""Words of many UTF-8 texts at once, as numpy arrays.

The operators that look at every word of the corpus work on byte offsets and
64-bit word hashes instead of Python strings: one Arrow column of texts is one
byte buffer, so words are found and hashed by a few vector operations.
Buffers are cut into slices of whole texts of at most ``SLICE_BYTES`` (a
longer text is a slice of its own), which bounds a task's memory by that
size or by its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 19

#: `[^\x20\x09-\x0D]+`, byte by byte (every byte of a longer UTF-8 character belongs to the word).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased.
LETTERS = np.zeros(256, bool)
LETTERS[0x30:0x3A] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: Two independent hash functions; odd factors of their steps.
_SEEDS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

#: Words of more bytes are hashed one by one, by XXH3.
LONG_WORD = 64

_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets between them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), bounds


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of whole texts of at most ``limit`` bytes together."""
    data, bounds = texts(column)
    first, n = 0, len(bounds) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1)
        last = min(last, n)
        yield first, last, data[bounds[first]:bounds[last]], bounds[first:last + 1] - bounds[first]
        first = last


def spans(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and the n + 1 places in these where the texts' words begin."""
    here = inside[data]
    cut = bounds[:-1][bounds[:-1] < len(data)]
    begins = here.copy()
    begins[1:] &= ~here[:-1]
    begins[cut] = here[cut]
    ends = here.copy()
    ends[:-1] &= ~here[1:]
    before = cut[cut > 0] - 1
    ends[before] = here[before]
    begin = np.flatnonzero(begins)
    return begin, np.flatnonzero(ends) + 1, np.searchsorted(begin, bounds)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def step(state: np.ndarray, x: np.ndarray, which: int) -> np.ndarray:
    """A running hash after one more value.  The shifts between the products keep
    it from being a polynomial, whose values modulo 2^64 some texts make equal."""
    state = (state ^ x) * np.uint64(_SEEDS[which])
    return state ^ (state >> np.uint64(32))


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; ``which`` takes one of two independent hash
    functions.  Words are read eight bytes at a time, so two words of at most
    eight bytes have one hash only if they are equal and, with very small
    probability, if their lengths differ; longer than ``LONG_WORD``: by XXH3."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    length = end - begin
    h = mix(length.astype(np.uint64) ^ np.uint64(_SEEDS[1 - which]))
    short = length <= LONG_WORD
    todo = np.flatnonzero(short)
    for at in range(0, LONG_WORD, 8):
        if not len(todo):
            break
        left = length[todo] - at
        own = eight[begin[todo] + at] & _LOW_BYTES[np.minimum(left, 8)]
        h[todo] = step(h[todo], own, which)
        todo = todo[left > 8]
    if not short.all():
        raw = memoryview(data.tobytes())
        for k in np.flatnonzero(~short).tolist():
            h[k] = xxhash.xxh3_64_intdigest(raw[begin[k]:end[k]], _SEEDS[which])
    return mix(h)


def windows(words: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """The hash of each run of ``size`` words in a row; the caller leaves out runs that cross texts."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = step(out, words[k:k + n], 1 - which)
    return mix(out)


def runs(words: np.ndarray, begin: np.ndarray, length: np.ndarray, which: int = 0) -> np.ndarray:
    """The hash of each run of ``length`` words from ``begin``; runs are short."""
    out = mix(length.astype(np.uint64))
    for k in range(int(length.max(initial=0))):
        todo = length > k
        out[todo] = step(out[todo], words[begin[todo] + k], 1 - which)
    return mix(out)


def same_bytes(data: np.ndarray, begin: np.ndarray, other: np.ndarray, other_begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether ``length`` bytes of ``data`` from each of ``begin`` equal those of ``other`` from ``other_begin``."""
    same = np.ones(len(begin), bool)
    some = np.flatnonzero(length > 0)
    if len(some):
        n = length[some]
        first = np.cumsum(n) - n
        within = np.arange(int(n.sum())) - np.repeat(first, n)
        equal = data[np.repeat(begin[some], n) + within] == other[np.repeat(other_begin[some], n) + within]
        same[some] = np.logical_and.reduceat(equal, first)
    return same


class Vocabulary:
    """Words with ids 0, 1, ..., looked up for all words of a slice at once; equal hashes are verified by their bytes."""

    def __init__(self, words: list[bytes]):
        self.size = len(words)
        self.data = np.frombuffer(b"".join(words), np.uint8)
        self.length = np.array([len(w) for w in words], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        h = hashes(self.data, self.begin, self.begin + self.length)
        self.order = np.argsort(h, kind="stable")
        self.sorted = h[self.order]

    def find(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The id of each word, -1 for others."""
        found = np.full(len(begin), -1, np.int64)
        if not self.size or not len(begin):
            return found
        h = hashes(data, begin, end)
        at = np.searchsorted(self.sorted, h)
        todo = np.flatnonzero(at < self.size)
        while len(todo):  # once, unless words of the vocabulary share a hash
            todo = todo[self.sorted[at[todo]] == h[todo]]
            k = self.order[at[todo]]
            length = end[todo] - begin[todo]
            equal = self.length[k] == length
            equal[equal] = same_bytes(data, begin[todo][equal], self.data, self.begin[k[equal]], length[equal])
            found[todo[equal]] = k[equal]
            todo = todo[~equal]
            at[todo] += 1
            todo = todo[at[todo] < self.size]
        return found


def starts(first: np.ndarray, size: int) -> np.ndarray:
    """Which places of the word sequence begin a run of ``size`` words of one text."""
    n = int(first[-1])
    ok = np.ones(max(0, n - size + 1), bool)
    for cut in first[1:-1]:
        ok[max(0, cut - size + 1):cut] = False
    return ok
