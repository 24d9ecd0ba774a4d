"""Vectorised words and word-window hashes over Arrow string columns.

The helpers work on the UTF-8 bytes of a column of texts. All separators of
the word definitions used in this package are ASCII, so words can be cut on
bytes: every byte of a multi-byte character is a word byte.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: glibc's malloc_trim, where there is one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def _lookup(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], dtype=bool)


#: Words ``[^\x20\x09-\x0D]+``.
SPACED = _lookup(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of a text whose A-Z are lower-cased.
ALNUM = _lookup(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= (b | 0x20) <= 0x7A and chr(b).isalpha())
#: Bytes with A-Z lower-cased.
LOWER = np.array([b | 0x20 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _table(seed: int, lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return values[LOWER] if lower else values


_TABLES = {(seed, lower): _table(seed, lower) for seed in (1, 2) for lower in (False, True)}
_BASES = (0x9DDFEA08EB382D69, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64 for i < n."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        base = _BASES[which]
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(max(n, SLICE_BYTES // (1 if which < 2 else 4)), b, dtype=np.uint64)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        have = (pair[0], pair[1])
        if n <= 2 * SLICE_BYTES:  # tables for a single giant text are not kept
            _POWERS[which] = have
    return have


def ranges_hash(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, which: int) -> np.ndarray:
    """A position-independent 64-bit hash of values[lo:hi] for each range."""
    n = len(values)
    p, inverse = _powers(which, n + 1)
    c = np.empty(n + 1, dtype=np.uint64)
    c[0] = 0
    np.cumsum(values * p[:n], out=c[1:])
    return mix((c[hi] - c[lo]) * inverse[lo])


def columns_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    column = batch.column(batch.schema.get_field_index(name))
    return column


def released(batches: Iterator) -> Iterator:
    """The batches; at the task's end memory that pools hold goes back to the system, as workers live on."""
    yield from batches
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def trimmed(f):
    """``f`` over a task's batches, with ``released``."""
    return lambda batches: released(f(batches))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) over the rows in pieces of about ``limit`` bytes; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


@dataclass
class Words:
    starts: np.ndarray  # byte positions
    ends: np.ndarray
    first: np.ndarray  # index of each document's first word, and the number of words at the end
    doc: np.ndarray  # document of each word

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def cut(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    """Maximal runs of word bytes; documents end words too."""
    n = len(data)
    w = is_word[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begin = w.copy()
    begin[1:] &= ~w[:-1] | edge[1:n]
    end = w
    end[:-1] &= ~w[1:] | edge[1:n] if n else end[:-1]
    starts = np.flatnonzero(begin)
    first = np.searchsorted(starts, offsets)
    return Words(starts, np.flatnonzero(end) + 1, first, np.repeat(np.arange(len(offsets) - 1), np.diff(first)))


def word_hashes(data: np.ndarray, words: Words, lower: bool, seed: int = 1) -> np.ndarray:
    return ranges_hash(_TABLES[seed, lower][data], words.starts, words.ends, seed - 1)


def windows(hashes: np.ndarray, words: Words, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every window of k consecutive words of one document."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(words.doc[:n] == words.doc[k - 1 :])
    return at, ranges_hash(hashes, at, at + k, seed + 1)
