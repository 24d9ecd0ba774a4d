"""Byte-level BPE ids of whole columns.

Texts are cut into pre-tokens with array operations on whole Arrow columns, and
each distinct pre-token is merged once (``Encoder.encode``). Texts whose cut
needs more than the array rules know (contractions, characters beyond
``SAFE_BELOW``, literal special tokens) go through the tokenizer library itself,
so ids are always those of ``Tokenizer.from_file(path)`` with
``add_special_tokens=False``.
"""

from __future__ import annotations

import json
import unicodedata
from itertools import chain, starmap

import numpy as np
import pyarrow as pa

from lodestone.llm import _text as T

#: Characters below this (Latin, Greek, Cyrillic and their marks) have settled classes.
SAFE_BELOW = 0x0530
#: About 25 MB of a worker's memory.
CACHED_PIECES = 150_000
OTHER, LETTER, NUMBER, SPACE, UNSAFE = range(5)
WHITE = {*range(9, 14), 0x20, 0x85, 0xA0}


def _class(cp: int) -> int:
    kind = unicodedata.category(chr(cp))[0]
    return SPACE if cp in WHITE else LETTER if kind == "L" else NUMBER if kind == "N" else OTHER


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE files write bytes as printable characters: those that are, as they are, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts; one to a worker process."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"].encode() for x in spec.get("added_tokens", ())]
        char = _byte_of_char()
        special = {x["content"] for x in spec.get("added_tokens", ())}
        ranks = {bytes(char[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.merge = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.classes = np.full(SAFE_BELOW + 1, UNSAFE, dtype=np.uint8)
        self.classes[:SAFE_BELOW] = [_class(cp) for cp in range(SAFE_BELOW)]
        self._reset()

    def _reset(self) -> None:
        self.at: dict[int, int] = {}
        self.lengths = np.zeros(1 << 16, np.int32)
        self.begins = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _learn(self, keys: list[int], pieces: list[bytes]) -> None:
        found = list(map(self.merge, pieces))
        n, first = len(found), len(self.at)
        lengths = np.fromiter(map(len, found), np.int32, n)
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))
        while first + n > len(self.lengths):
            self.lengths, self.begins = np.resize(self.lengths, 2 * len(self.lengths)), np.resize(self.begins, 2 * len(self.begins))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.lengths[first : first + n] = lengths
        self.begins[first : first + n] = self.used + np.cumsum(lengths) - lengths
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.at.update(zip(keys, range(first, first + n), strict=True))

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte position of each pre-token, whether each text is safe to cut so)."""
        n = len(data)
        at = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        kind = self.classes[np.minimum(points, SAFE_BELOW)]
        m = len(points)
        edge = np.zeros(m + 1, dtype=bool)
        texts = np.searchsorted(at, offsets)
        edge[texts] = True
        turn = np.ones(m + 1, dtype=bool)  # a run of one class begins here
        turn[1:m] = (kind[1:] != kind[:-1]) | edge[1:m]
        white = kind == SPACE
        begin = turn[:m].copy()
        # the last white character before something else stands apart, and a blank joins what follows
        last = np.zeros(m, dtype=bool)
        last[:-1] = white[:-1] & ~white[1:] & ~edge[1:m]
        begin |= last
        joined = np.zeros(m, dtype=bool)
        joined[1:] = last[:-1] & (points[:-1] == 0x20)
        begin &= ~joined
        quote = np.flatnonzero((points[:-1] == 0x27) & begin[:-1] & ~edge[1:m] & (kind[1:] == LETTER)) if m > 1 else np.zeros(0, np.int64)
        quote = quote[np.isin(points[quote + 1], np.frombuffer("stmdrvl".encode("utf-32-le"), np.uint32))]
        bad = np.concatenate([np.flatnonzero(kind == UNSAFE), quote])
        safe = np.ones(len(offsets) - 1, dtype=bool)
        safe[np.searchsorted(texts, bad, side="right") - 1] = False
        raw = data.tobytes() if self.special else b""
        for token in self.special:
            found = raw.find(token)
            while found >= 0:
                safe[np.searchsorted(offsets, found, side="right") - 1] = False
                found = raw.find(token, found + 1)
        return (at[begin] if n else at), safe

    def encode(self, data: np.ndarray, offsets: np.ndarray, want_ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """(number of ids of each text, all ids one after another)."""
        docs = len(offsets) - 1
        starts, safe = self._cut(data, offsets)
        ends = np.append(starts[1:], len(data))
        first = np.searchsorted(starts, offsets)
        if not safe.all():
            keep = np.repeat(safe, np.diff(first))
            starts, ends = starts[keep], ends[keep]
            first = np.concatenate([[0], np.cumsum(np.where(safe, np.diff(first), 0))])
        keys, sample, inverse = np.unique(T.ranges_hash(T._TABLES[1, False][data], starts, ends, 0), return_index=True, return_inverse=True)
        if len(self.at) + len(keys) > CACHED_PIECES:
            self._reset()
        names = keys.tolist()
        new = [i for i, k in enumerate(names) if k not in self.at]
        if new:
            raw = data.tobytes()
            self._learn([names[i] for i in new], [raw[a:b] for a, b in zip(starts[sample[new]].tolist(), ends[sample[new]].tolist(), strict=True)])
        entry = np.fromiter(map(self.at.__getitem__, names), np.int64, len(names))[inverse] if names else np.zeros(0, np.int64)
        lengths = self.lengths[entry]
        total = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        counts = total[first[1:]] - total[first[:-1]]
        flat = None
        if want_ids:
            flat = self.ids[np.repeat(self.begins[entry] - total[:-1], lengths) + np.arange(total[-1])]
        if safe.all():
            return counts, flat
        slow = np.flatnonzero(~safe)
        raw = data.tobytes()
        texts = list(starmap(lambda a, b: raw[a:b].decode("utf-8"), zip(offsets[slow].tolist(), offsets[slow + 1].tolist(), strict=True)))
        found = [np.array(x.ids, dtype=np.uint32) for x in self.exact.encode_batch(texts, add_special_tokens=False)]
        if want_ids:
            parts, at = [], np.concatenate([[0], np.cumsum(counts)])
            mine = dict(zip(slow.tolist(), found, strict=True))
            for i in range(docs):
                parts.append(mine[i] if i in mine else flat[at[i] : at[i + 1]])
            flat = np.concatenate(parts)
        counts = counts.copy()
        counts[slow] = [len(x) for x in found]
        return counts, flat


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(column: pa.Array, path: str, want_ids: bool = True):
    """(first row, last row, ids per text, ids) in pieces of a few MB."""
    e = encoder(path)
    for lo, hi, data, offsets in T.slices(column):
        yield lo, hi, *e.encode(data, offsets, want_ids)
