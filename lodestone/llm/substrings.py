"""Substring dedup with a count-min prefilter.

Every chunk of documents hashes its windows of ``WINDOW`` words and sends the
sketch cells they fall into. A sketch shard adds up the cells of all chunks and
answers which windows are estimated to occur twice or more: an estimate never
falls below the true count, so no repeated window is lost. Only those windows
are then grouped exactly, by 96-bit hashes, to find the smallest document they
start in. Words under a window that starts in a smaller document are removed.

The sketch has ``CELLS`` cells a window and row, spread over as many shards as
it needs, so the prefilter stays as sharp at any corpus size.

Defined edge cases: null and empty texts have no words and keep the empty text;
texts below ``WINDOW`` words are kept; rows that share an id do not remove
each other's words; null ids come after all others; ids are whole numbers
(others fail to cast); other columns are ignored, whatever they are called. A
text is one piece of a chunk, so a task needs about 100 bytes of memory a byte
of its longest text.

A chunk sends one row for each shard it has keys of, so the rows are never more
than the distinct keys of the chunks, and grow with the corpus as keys do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import _chunks as C
from lodestone.llm import _text as T
from lodestone.llm._shared import table

WINDOW = 13
DEPTH = 2
CELLS = 4
BLOCK_BITS = 16  # cells of a block, addressed by 16-bit numbers
SHARD_BITS = 6  # blocks of a sketch shard
LAST = np.iinfo(np.int64).max
SKETCH, EXACT = 0, 1


class _Windows:
    """The windows of a chunk: distinct hashes, sorted, and where they occur."""

    def __init__(self, table: pa.Table):
        ids, self.texts = C.opened(table)
        self.raw_ids = ids
        self.ids = ids.fill_null(LAST).to_numpy()
        at, first, second, doc = [], [], [], []
        self.slices = []
        base = 0
        for lo, hi, data, offsets in T.slices(self.texts):
            words = T.cut(data, offsets, T.SPACED)
            h = T.word_hashes(data, words, lower=False)
            begin, f = T.windows(h, words, WINDOW)
            g = T.mix(f ^ T.ranges_hash(T.mix(h + np.uint64(0x9E3779B97F4A7C15)), begin, begin + WINDOW, 3)) >> np.uint64(32)
            at.append(begin)
            first.append(f)
            second.append(g.astype(np.uint32))
            doc.append((lo + words.doc[begin]).astype(np.int32))
            self.slices.append((lo, hi, data, offsets, words.starts, words.ends, words.first, base, base + len(begin)))
            base += len(begin)
        whole = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.at, self.doc = whole(at, np.int64), whole(doc, np.int32)
        self.keys, sample, self.which, counts = np.unique(whole(first, np.uint64), return_index=True, return_inverse=True, return_counts=True)
        self.second = whole(second, np.uint32)[sample]
        self.twice = counts > 1
        self.least = np.full(len(self.keys), LAST)
        np.minimum.at(self.least, self.which, self.ids[self.doc])


def _cells(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """((DEPTH, n) cells within the key's block, block within its shard); rows use different bits of the hash."""
    inside = (keys >> np.uint64(64 - bits - SHARD_BITS)) & np.uint64((1 << SHARD_BITS) - 1)
    again = T.mix(keys)
    low = [(keys >> np.uint64(64 - bits - SHARD_BITS - BLOCK_BITS)) & np.uint64(0xFFFF)]
    low += [(again >> np.uint64(16 * d)) & np.uint64(0xFFFF) for d in range(DEPTH - 1)]
    return np.stack([x.astype(np.uint16) for x in low]), inside.astype(np.uint8)


def _sketch(bits: int):
    def send(key, table):
        w = _Windows(table)
        rows = []
        edges = C.shard_edges(w.keys, bits)
        low, inside = _cells(w.keys, bits)
        blocks = np.uint8(1 << SHARD_BITS)
        for i in np.flatnonzero(np.diff(edges)):
            part = slice(edges[i], edges[i + 1])
            sizes = np.bincount(inside[part], minlength=int(blocks)).astype(np.uint32)
            rows.append((int(i), key[0].as_py(), sizes.tobytes(), low[:, part].tobytes(), np.packbits(w.twice[part]).tobytes()))
        return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate((("shard", pa.int64()), ("chunk", pa.int64()), ("sizes", pa.binary()), ("cells", pa.binary()), ("twice", pa.binary())))})

    return send


def _estimate(key, table):
    """Merges the sketches of all chunks in a shard; a bit for each window that sent a cell."""
    sizes, _ = C.joined(table, "sizes", np.uint32)
    sizes = sizes.reshape(-1, 1 << SHARD_BITS).astype(np.int64)
    n = sizes.sum(axis=1)
    cells, _ = C.joined(table, "cells", np.uint16)
    ends = np.cumsum(n)
    block = np.repeat(np.tile(np.arange(1 << SHARD_BITS, dtype=np.uint32), len(n)), sizes.ravel()) << np.uint32(BLOCK_BITS)
    twice = np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=int(c)) for x, c in zip(table.column("twice").combine_chunks(), n, strict=True)])
    repeated = np.ones(int(ends[-1]), dtype=bool)
    for d in range(DEPTH):
        # each chunk's cells come row by row
        row = np.concatenate([cells[DEPTH * (e - c) + d * c : DEPTH * (e - c) + (d + 1) * c] for e, c in zip(ends, n, strict=True)])
        cell = block | row
        count = np.bincount(cell, minlength=1) + np.bincount(cell, twice, minlength=1).astype(np.int64)
        repeated &= count[cell] > 1
    bits = [np.packbits(repeated[e - c : e]).tobytes() for e, c in zip(ends, n, strict=True)]
    return pa.table({"chunk": table.column("chunk"), "kind": pa.array([SKETCH] * len(n), pa.int32()), "shard": pa.array([key[0].as_py()] * len(n), pa.int64()), "bits": pa.array(bits, pa.binary())})


def _answers(table: pa.Table, kind: int, edges: np.ndarray) -> np.ndarray:
    """The bits of all ranges in the order of the keys."""
    out = np.zeros(int(edges[-1]), dtype=bool)
    for k, shard, bits in zip(table.column("kind").to_pylist(), table.column("shard").to_pylist(), table.column("bits").combine_chunks(), strict=True):
        if k == kind:
            n = int(edges[shard + 1] - edges[shard])
            out[edges[shard] : edges[shard + 1]] = np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), count=n)
    return out


def _candidates(bits: int, exact_bits: int):
    def send(key, texts, answers):
        w = _Windows(texts)
        picked = _answers(answers, SKETCH, C.shard_edges(w.keys, bits))
        keys, second, least = w.keys[picked], w.second[picked], w.least[picked]
        rows = list(C.split(C.shard_edges(keys, exact_bits), keys, second, least))
        return pa.table(
            {"shard": pa.array([r[0] for r in rows], pa.int64()), "chunk": pa.array([key[0].as_py()] * len(rows), pa.int64())}
            | {n: pa.array([r[1 + k] for r in rows], pa.binary()) for k, n in enumerate(("keys", "second", "least"))}
        )

    return send


def _smaller(key, table):
    """Groups the windows of a shard exactly; a bit for each that starts in a smaller document elsewhere."""
    keys, sizes = C.joined(table, "keys", np.uint64)
    second, _ = C.joined(table, "second", np.uint32)
    least, _ = C.joined(table, "least", np.int64)
    order = np.lexsort((second, keys))
    k, s = keys[order], second[order]
    new = np.append(True, (k[1:] != k[:-1]) | (s[1:] != s[:-1]))
    smallest = np.minimum.reduceat(least[order], np.flatnonzero(new))
    smaller = np.empty(len(keys), dtype=bool)
    smaller[order] = smallest[np.cumsum(new) - 1] < least[order]
    found = [np.packbits(x).tobytes() for x in C.parts(smaller, sizes)]
    return pa.table({"chunk": table.column("chunk"), "kind": pa.array([EXACT] * len(found), pa.int32()), "shard": pa.array([key[0].as_py()] * len(found), pa.int64()), "bits": pa.array(found, pa.binary())})


def _remove(bits: int, exact_bits: int):
    def kept(key, texts, answers):
        w = _Windows(texts)
        picked = _answers(answers, SKETCH, C.shard_edges(w.keys, bits))
        elsewhere = np.zeros(len(w.keys), dtype=bool)
        elsewhere[picked] = _answers(answers, EXACT, C.shard_edges(w.keys[picked], exact_bits))
        gone = elsewhere[w.which] | (w.least[w.which] < w.ids[w.doc])
        n_words, n_removed, kept_text = [], [], []
        for lo, hi, data, offsets, starts, ends, first, a, b in w.slices:
            cover = np.zeros(len(starts) + 1, dtype=np.int32)
            at = w.at[a:b][gone[a:b]]
            cover[at] += 1
            np.add.at(cover, at + WINDOW, -1)
            removed = np.cumsum(cover[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(removed)])
            lost = total[first[1:]] - total[first[:-1]]
            raw = data.tobytes()
            n_words.append(np.diff(first))
            n_removed.append(lost)
            for i in range(hi - lo):
                if not lost[i]:
                    kept_text.append(b" ".join(raw[offsets[i] : offsets[i + 1]].split()))
                else:
                    keep = np.arange(first[i], first[i + 1])[~removed[first[i] : first[i + 1]]]
                    kept_text.append(b" ".join([raw[p:q] for p, q in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)]))
        number = lambda parts: pa.array(np.concatenate(parts).astype(np.int64) if parts else [], pa.int64())
        return pa.table({"id": w.raw_ids, "n_words": number(n_words), "n_removed": number(n_removed), "kept_text": pa.array(kept_text, pa.binary()).cast(pa.string())})

    return kept


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = C.CHUNK_BYTES) -> DataFrame:
    """id, n_words, n_removed, kept_text of every document; a task holds one chunk of ``chunk_bytes`` at a time."""
    total = C.text_bytes(docs, text_col)
    chunks = C.count_for(total, chunk_bytes)
    windows = max(1, total // 6)
    bits = max(0, (windows * CELLS - 1).bit_length() - BLOCK_BITS - SHARD_BITS)
    exact_bits = max(2, (chunks - 1).bit_length())
    texts = C.chunked(docs, id_col, text_col, chunks)
    answer = "chunk bigint, kind int, shard bigint, bits binary"
    cells = texts.groupBy("chunk").applyInArrow(_sketch(bits), "shard bigint, chunk bigint, sizes binary, cells binary, twice binary")
    estimated = cells.groupBy("shard").applyInArrow(_estimate, answer)
    candidates = texts.groupBy("chunk").cogroup(estimated.groupBy("chunk")).applyInArrow(_candidates(bits, exact_bits), "shard bigint, chunk bigint, keys binary, second binary, least binary")
    exact = candidates.groupBy("shard").applyInArrow(_smaller, answer)
    answers = estimated.unionByName(exact)
    kept = texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_remove(bits, exact_bits), "id bigint, n_words bigint, n_removed bigint, kept_text string")
    return kept.withColumnRenamed("id", id_col)


def op3_count_min_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = deduplicated(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op3_count_min_substrings": op3_count_min_substrings}
ORACLES = {
    "op3_count_min_substrings": rf"""
WITH w AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
x AS (SELECT doc_id, rid, i, array_to_string(list_slice(words, i, i + {WINDOW - 1}), ' ') AS g FROM w, unnest(generate_series(1, len(words) - {WINDOW - 1})) AS u(i)),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY g) AS least FROM x),
gone AS (SELECT DISTINCT rid, i + k AS pos FROM f, generate_series(0, {WINDOW - 1}) AS s(k) WHERE least < doc_id),
each_word AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
k AS (SELECT e.rid, count(g.pos) AS n, string_agg(CASE WHEN g.pos IS NULL THEN word END, ' ' ORDER BY e.pos) AS kept FROM each_word e LEFT JOIN gone g ON e.rid = g.rid AND e.pos = g.pos GROUP BY e.rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (rid)
""",
}
