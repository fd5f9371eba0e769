"""Words, hashes and windows of whole Arrow string columns, computed on their UTF-8 bytes with numpy.

Word classes used here end only at ASCII bytes, so working on bytes gives the same words as working on
characters. All hashes are 64 bits and depend on content alone, never on the process that computes them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that are taken at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Bytes whose powers are held at once; a longer single word widens the table.
BLOCK_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random numbers."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


BYTE_CODE = seeded(256, 1)
BASE, WORD_BASE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
#: Codes and bases of a second, independent hash.
SECOND_CODE = seeded(256, 2)
SECOND_BASE, SECOND_WORD_BASE = 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3


@lru_cache(maxsize=8)
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64 for i below 2 ** bits."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p, step = np.ones(1, U64), b
        while len(p) < 1 << bits:
            p = np.concatenate([p, p * U64(step)])
            step = step * step % (1 << 64)
        out.append(p)
    return out[0], out[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(base, max(16, int(n).bit_length()))


def byte_set(*parts: int | tuple[int, int]) -> np.ndarray:
    """A table of 256 flags; parts are bytes or inclusive ranges."""
    table = np.zeros(256, bool)
    for x in parts:
        a, b = x if isinstance(x, tuple) else (x, x)
        table[a : b + 1] = True
    return table


#: Not in words of ``[^\x20\x09-\x0D]+``.
BLANK = byte_set(0x20, (0x09, 0x0D))
#: Not in words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased.
NOT_ALNUM = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``most`` bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


class Words:
    """The words of a run of texts: ``start`` and ``end`` bytes, ``hash``, and ``first``: the first word of each text, and the number of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, outside: np.ndarray, fold: np.ndarray | None = None):
        self.data = data if fold is None else fold[data]
        self.offsets = offsets
        inside = ~outside[self.data]
        n = len(self.data)
        opens, closes = inside.copy(), inside.copy()
        if n:
            opens[1:] &= ~inside[:-1]
            closes[:-1] &= ~inside[1:]
            cut = offsets[:-1][offsets[:-1] < n]
            opens[cut] = inside[cut]
            cut = offsets[1:][offsets[1:] > 0] - 1
            closes[cut] = inside[cut]
        self.inside = inside
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offsets)
        self._hash = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = hash_spans(self.data, self.start, self.end)
        return self._hash


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, code: np.ndarray = BYTE_CODE, base: int = BASE, block: int = BLOCK_BYTES) -> np.ndarray:
    """A hash of the bytes of each span; spans are in order and apart."""
    out = np.empty(len(start), U64)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + block, side="right")))
        lo, hi = int(start[a]), int(end[b - 1])
        p, inverse = powers(base, hi - lo + 1)
        total = np.zeros(hi - lo + 1, U64)
        np.cumsum(code[data[lo:hi]] * p[: hi - lo], out=total[1:])
        s, e = start[a:b] - lo, end[a:b] - lo
        out[a:b] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(U64))
        a = b
    return out


def window_hash(words: np.ndarray, length: int, base: int = WORD_BASE) -> np.ndarray:
    """A hash of each run of ``length`` consecutive numbers, texts' ends ignored."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.empty(n, U64)
    step = 1 << 18
    for a in range(0, n, step):
        b = min(n, a + step)
        part = words[a : b + length - 1]
        p, inverse = powers(base, len(part) + 1)
        total = np.zeros(len(part) + 1, U64)
        np.cumsum(part * p[: len(part)], out=total[1:])
        out[a:b] = mix((total[length:] - total[: b - a]) * inverse[: b - a] + U64(length))
    return out


def window_starts(first: np.ndarray, length: int) -> np.ndarray:
    """Of all words, whether a window of ``length`` words of one text starts there."""
    n = int(first[-1]) if len(first) else 0
    ends = np.repeat(first[1:], np.diff(first))
    return np.arange(n) + length <= ends


def cover(starts: np.ndarray, length: int | np.ndarray, n: int) -> np.ndarray:
    """Of n words, those inside any window that starts at one of ``starts``."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + length, -1)
    return np.cumsum(change[:-1]) > 0
