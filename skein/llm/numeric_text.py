"""Words and word windows of Arrow text columns as 64-bit hashes, in numpy.

A batch is cut into pieces of about ``PIECE`` bytes at document boundaries, so
memory is bounded by a piece or the longest document.  Words are separated by
the bytes 0x20 and 0x09 to 0x0D, in UTF-8.  A word's hash is the mixed sum of a
pseudo-random number for each (place, byte) of it, so no family of words has
equal hashes by its structure, as it has for polynomials modulo 2**64.  Window
hashes are polynomials over these word hashes, from prefix sums and powers of an
odd base and of its inverse, and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
U = np.uint64

# An odd base for windows, and fixed constants of the splitmix64 finalizer.
WORDS_BASE = 0xD1342543DE82EF95
STEP, MIX_A, MIX_B = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: a bijection that spreads every bit."""
    x = (x ^ (x >> U(30))) * MIX_A
    x = (x ^ (x >> U(27))) * MIX_B
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of ``base`` and of its inverse modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, PIECE + 1)
        up, down = np.full(size, base, U), np.full(size, pow(base, -1, 1 << 64), U)
        up[0] = down[0] = 1
        have = _powers[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


def spans_hashed(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A hash of values[start:end] for each span."""
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * STEP)


#: Places in a word whose numbers are kept in a table; those of later places are made as they come.
PLACES = 64
SEEDS = [MIX_A, MIX_B]
_numbers = [mixed(mixed(np.arange(PLACES * 256, dtype=U) * STEP + seed) ^ seed) for seed in SEEDS]


def words_hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of the bytes of each word, one of two; the spans rise and do not overlap."""
    if not len(starts):
        return np.zeros(0, U)
    begins = np.zeros(len(data), np.int64)
    begins[starts] = starts
    place = np.arange(len(data)) - np.maximum.accumulate(begins)
    key = place * 256 + data
    numbers = _numbers[which][np.minimum(key, PLACES * 256 - 1)]
    far = np.flatnonzero(place >= PLACES)
    numbers[far] = mixed(mixed(key[far].astype(U) * STEP + SEEDS[which]) ^ SEEDS[which])
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(numbers, out=sums[1:])
    return mixed(sums[ends] - sums[starts] + (ends - starts).astype(U) * STEP)


@dataclass
class Piece:
    """Some documents: rows [first, first + docs) of a batch, and their words."""

    first: int
    docs: int
    hashes: np.ndarray
    bounds: np.ndarray  # document d has the words bounds[d]:bounds[d + 1]
    data: np.ndarray
    starts: np.ndarray  # of words, in data
    ends: np.ndarray

    def other_hashes(self) -> np.ndarray:
        """Hashes of the words that are independent of ``hashes``."""
        return words_hashed(self.data, self.starts, self.ends, 1)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of ``k`` words within a document, and their first words."""
        ends = np.repeat(self.bounds[1:], np.diff(self.bounds))
        at = np.flatnonzero(np.arange(len(ends)) + k <= ends)
        if not len(at):
            return np.zeros(0, U), at
        return spans_hashed(self.hashes, at, at + k, WORDS_BASE), at

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, side="right") - 1

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, hash) of each window of k words; a shorter text is one shingle."""
        hashes, at = self.windows(k)
        n = np.diff(self.bounds)
        short = np.flatnonzero((n > 0) & (n < k))
        whole = spans_hashed(self.hashes, self.bounds[short], self.bounds[short + 1], WORDS_BASE) if len(short) else np.zeros(0, U)
        return np.concatenate([self.doc_of(at), short]), np.concatenate([hashes, whole])


#: Byte values that are in words: all but space and 0x09 to 0x0D.
INSIDE = np.ones(256, bool)
INSIDE[[32, *range(9, 14)]] = False

#: What bytes are read as where the letters A to Z stand for small ones.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def pieces(texts: pa.Array, read_as: np.ndarray | None = None, inside: np.ndarray = INSIDE, size: int = PIECE) -> Iterator[Piece]:
    """The documents of a text column, in order; null is an empty text.

    ``read_as``: what each of the 256 byte values is read as; ``inside``: which of them are in words; ``size``: bytes of a piece.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and len(buffers[2]) else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        part = data[offsets[first] : offsets[last]]
        yield cut(first, part if read_as is None else read_as[part], offsets[first : last + 1] - offsets[first], inside)
        first = last


def cut(first: int, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = INSIDE) -> Piece:
    docs = len(offsets) - 1
    word = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return Piece(first, docs, words_hashed(data, starts, ends), np.searchsorted(starts, offsets).astype(np.int64), data, starts, ends)


def gathered(source: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces of ``source`` one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return source[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


def counted(docs: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, hash) and how often each occurs."""
    if not len(hashes):
        return docs, hashes, np.zeros(0, np.int64)
    key = mixed(hashes + mixed(docs.astype(U) * STEP))
    order = np.argsort(key)
    new = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    first = order[new]
    return docs[first], hashes[first], np.diff(np.append(new, len(order)))
