"""Words of whole texts as 64-bit hashes, computed on Arrow buffers in slices.

A word is a run of bytes other than space and 9 to 13, which for UTF-8 is the same
as the pattern [^\\x20\\x09-\\x0D]+ over characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time; a longer text is a slice of its own.
SLICE = 2 << 20
#: Bytes whose runs are hashed at a time; a longer run is a block of its own.
BLOCK = 1 << 18
#: Words of more bytes are hashed byte by byte in quick_slices().
LONG = 64
#: White space.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

M1, M2, GOLDEN, BASE = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
S27, S30, S31 = (np.uint64(x) for x in (27, 30, 31))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on one another (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> S30
    x *= M1
    x ^= x >> S27
    x *= M2
    x ^= x >> S31
    return x


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN) | np.uint64(1)
_PLAIN = np.where(_IS_SPACE, np.uint64(0), _VALUE)
_FOLDED = np.where(_IS_SPACE, np.uint64(0), _VALUE[_FOLD])
_SPACED = np.where(_IS_SPACE, np.uint8(0x20), _FOLD)
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
# Terms: runs of ASCII letters and digits and of all that is not ASCII.
_IS_TERM = np.zeros(256, bool)
_IS_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_TERM = np.where(_IS_TERM, _VALUE[_FOLD], np.uint64(0))
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, BASE, np.uint64))])
    return _powers


class Slice(NamedTuple):
    """Texts first to last - 1 of a batch: their bytes, where each begins in them, words, and where each text's words begin."""

    first: int
    last: int
    data: np.ndarray
    starts: np.ndarray
    words: np.ndarray
    offsets: np.ndarray


def raw_slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, starts) of slices of a string column, of about so many bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1))
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def runs(classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where runs of one class other than 0 begin; a text's start always begins one."""
    begin = classes != 0
    begin[1:] &= classes[1:] != classes[:-1]
    inner = starts[:-1][starts[:-1] < len(classes)]
    begin[inner] |= classes[inner] != 0
    return np.flatnonzero(begin)


def hash_runs(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash for each run; values are 0 outside runs that count."""
    if not len(at):
        return np.zeros(0, np.uint64)
    ends = np.append(at, len(values))
    found = np.empty(len(at), np.uint64)
    i = 0
    # By blocks of whole runs, as places and products take several times the text's memory.
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + BLOCK, "right")) - 1)
        begins, lengths = ends[i:j] - ends[i], np.diff(ends[i : j + 1])
        place = np.arange(ends[j] - ends[i]) - np.repeat(begins, lengths)
        found[i:j] = np.add.reduceat(values[ends[i] : ends[j]] * _power(int(lengths.max()))[place], begins)
        i = j
    return mix(found)


def word_slices(column: pa.Array, fold: bool = True, size: int = SLICE) -> Iterator[Slice]:
    """Slices with the hashes of all words in order; fold: A-Z count as a-z."""
    for i, j, data, starts in raw_slices(column, size):
        at = runs((~_IS_SPACE[data]).astype(np.uint8), starts)
        yield Slice(i, j, data, starts, hash_runs((_FOLDED if fold else _PLAIN)[data], at), np.searchsorted(at, starts))


def quick_slices(column: pa.Array, size: int = SLICE) -> Iterator[Slice]:
    """word_slices() with other hashes, made of eight bytes at a time; A-Z count as a-z."""
    for i, j, data, starts in raw_slices(column, size):
        n = len(data)
        padded = np.full(n + 8, 0x20, np.uint8)
        np.take(_SPACED, data, out=padded[:n], mode="clip")
        space, edge = padded[: n + 1] == 0x20, np.empty(n + 1, bool)
        edge[0] = not space[0]
        np.not_equal(space[1:], space[:-1], out=edge[1:])
        edges = np.flatnonzero(edge)
        # Between two texts without white space one word ends and another begins.
        inner = np.unique(starts[(starts > 0) & (starts < n)])
        split = np.repeat(inner[~space[inner] & ~space[inner - 1]], 2)
        edges = np.insert(edges, np.searchsorted(edges, split), split)
        at, lengths = edges[::2], edges[1::2] - edges[::2]
        eight = np.ndarray(n + 1, np.dtype("<u8"), padded, strides=(1,))
        found = mix((eight[at] & _FIRST_BYTES[np.minimum(lengths, 8)]) + lengths.astype(np.uint64) * GOLDEN)
        more, done = np.flatnonzero(lengths > 8), 8
        while len(more) and done < LONG:
            found[more] = mix(found[more] * BASE + (eight[at[more] + done] & _FIRST_BYTES[np.minimum(lengths[more] - done, 8)]))
            done += 8
            more = more[lengths[more] > done]
        if len(more):
            begins = np.cumsum(lengths[more]) - lengths[more]
            place = np.arange(lengths[more].sum()) + np.repeat(at[more] - begins, lengths[more])
            found[more] = hash_runs(_FOLDED[padded[place]], begins)
        yield Slice(i, j, data, starts, found, np.searchsorted(at, starts))


def term_slices(column: pa.Array, size: int = SLICE) -> Iterator[Slice]:
    """Slices with the hashes of all terms in order, A-Z counting as a-z: the pattern [^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+."""
    for i, j, data, starts in raw_slices(column, size):
        at = runs(_IS_TERM[data].astype(np.uint8), starts)
        yield Slice(i, j, data, starts, hash_runs(_TERM[data], at), np.searchsorted(at, starts))


def term_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the terms of one text's bytes begin and end."""
    edges = np.diff(np.concatenate([[0], _IS_TERM[data].astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def hash_word(word: str, fold: bool = True) -> int:
    """The hash that word_slices gives a single word, as a signed long."""
    (s,) = word_slices(pa.array([word]), fold)
    return int(s.words.view(np.int64)[0])


class Vocabulary:
    """Distinct word hashes with numbers in their order; most other hashes are turned away by a table of their first bits."""

    BITS = 20

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes.astype(np.uint64))
        self.seen = np.zeros(1 << self.BITS, bool)
        self.seen[self.hashes >> np.uint64(64 - self.BITS)] = True

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        found = np.full(len(hashes), -1, np.int32)
        maybe = np.flatnonzero(self.seen[hashes >> np.uint64(64 - self.BITS)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), max(0, len(self) - 1))
        good = self.hashes[at] == hashes[maybe] if len(self) else np.zeros(0, bool)
        found[maybe[good]] = at[good]
        return found
