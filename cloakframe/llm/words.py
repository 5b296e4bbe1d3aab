"""Words and word n-grams of a batch of texts as numpy arrays, straight from the Arrow buffers.

No Python object is made for a word: a batch's bytes are classified, words are cut at class changes, and a word's
64-bit hash comes from running sums over the bytes.  Texts are handled whole, in chunks of a bounded number of
bytes (a longer text is a chunk of its own)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)

#: White space: the six characters that end a word.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=4)
def _byte_values(fold: bool) -> np.ndarray:
    values = mix64(np.arange(1, 257, dtype=_U) * _GOLDEN)
    if fold:  # A-Z count as a-z
        values[65:91] = values[97:123]
    return values


@lru_cache(maxsize=2)
def _powers(base: int, size: int) -> np.ndarray:
    steps = np.full(size, base, _U)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def powers(base: int, size: int) -> np.ndarray:
    room = 1 << max(20, (size - 1).bit_length())
    return (_powers if room <= 1 << 24 else _powers.__wrapped__)(base, room)[:size]


@dataclass
class Texts:
    """Bytes of consecutive texts; text i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def characters(self) -> np.ndarray:
        """Code points of each text."""
        return self.per_text((self.data & 0xC0) != 0x80)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value of each byte over each text."""
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


@dataclass
class Words:
    """Words in order: hash, first byte, byte after the last, and for each text the number of its first word."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # len(texts) + 1 entries

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def chunks(column: pa.Array) -> Iterator[tuple[int, Texts]]:
    """(number of the first text, texts) for bounded pieces of a string column; null is the empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    begin = 0
    while begin < len(column):
        end = int(np.searchsorted(offsets, offsets[begin] + CHUNK_BYTES, "right")) - 1
        end = min(max(end, begin + 1), len(column))
        yield begin, Texts(data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin])
        begin = end


def cut(texts: Texts, classes: np.ndarray | None = None, fold: bool = False) -> Words:
    """Cut texts into words.  ``classes`` gives each byte value a class, 0 for white space; a word is a longest run
    of one other class, so two classes part letters from punctuation.  ``fold`` hashes A-Z as a-z."""
    data, size = texts.data, len(texts.data)
    if not size:
        none = np.zeros(0, np.int64)
        return Words(none.astype(_U), none, none, np.zeros(len(texts) + 1, np.int64))
    kind = (~SPACE if classes is None else classes)[data].astype(np.uint8)
    change = np.empty(size + 1, bool)
    change[0] = change[size] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:size])
    change[texts.offsets] = True
    edges = np.flatnonzero(change)
    inside = kind[edges[:-1]] != 0
    starts, ends = edges[:-1][inside], edges[1:][inside]
    sums = np.zeros(size + 1, _U)
    np.cumsum(_byte_values(fold)[data] * powers(_BASE, size), out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * powers(_INVERSE, size)[starts])
    return Words(hashes, starts, ends, np.searchsorted(starts, texts.offsets))


def ngrams(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``size`` words from each word on, and whether they lie in one text."""
    count = len(words.hashes)
    total = np.zeros(count, _U)
    for k in range(size):
        weight = mix64(np.array([k + 1], _U) * _GOLDEN)[0] | _U(1)
        total[: max(count - k, 0)] += words.hashes[k:] * weight
    last = np.repeat(words.first[1:], np.diff(words.first))
    return mix64(total), np.arange(count) + size <= last
