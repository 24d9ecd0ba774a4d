"""Chunks of documents that ask hash shards about their keys.

A chunk is a set of documents of bounded size, chosen by a hash of id and text,
so that rows without an id or with the same one are spread too. It
sends its distinct 64-bit keys, sorted, in one binary row for each shard (a
shard is a range of keys); a shard merges the rows of all chunks and answers
each row with values in the row's order, so a chunk puts its answers back
together by joining them in shard order. Nothing is gathered but one chunk or
one range of keys at a time, and a key that many documents share is sent once
a chunk.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._shared import bounded_batches

CHUNK_BYTES = 8 << 20
_OPTIONS = pa.ipc.IpcWriteOptions(compression="zstd")


def count_for(total_bytes: int, each: int = CHUNK_BYTES) -> int:
    return max(4, -(-total_bytes // each))


def text_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.select(F.sum(F.octet_length(text_col)).alias("n")).first().n or 0


def _pack(batches):
    for batch in batches:
        chunk = batch.column(0).to_numpy()
        order = np.argsort(chunk, kind="stable")
        edges = np.append(np.flatnonzero(np.diff(chunk[order], prepend=-1)), len(order))
        rows = pa.RecordBatch.from_arrays(batch.columns[1:], names=batch.schema.names[1:])
        found, blobs = [], []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            out = io.BytesIO()
            with pa.ipc.new_stream(out, rows.schema, options=_OPTIONS) as writer:
                writer.write_batch(rows.take(pa.array(order[a:b])))
            found.append(int(chunk[order[a]]))
            blobs.append(out.getvalue())
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(blobs, pa.binary())], names=["chunk", "blob"])


def chunked(docs: DataFrame, id_col: str, text_col: str, chunks: int) -> DataFrame:
    """(chunk, blob): the documents' ids and texts, compressed, ready to be grouped by chunk."""
    rows = docs.select(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(chunks)).alias("chunk"), F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    bounded_batches(docs.sparkSession)
    return rows.mapInArrow(_pack, "chunk bigint, blob binary")


def opened(table: pa.Table) -> tuple[pa.Array, pa.Array]:
    """(ids, texts) of a chunk."""
    tables = [pa.ipc.open_stream(blob.as_buffer()).read_all() for blob in table.column("blob").combine_chunks()] if table.num_rows else []
    if not tables:
        return pa.array([], pa.int64()), pa.array([], pa.large_string())
    whole = pa.concat_tables(tables)
    return pa.concat_arrays(whole.column("id").chunks), pa.concat_arrays(whole.column("text").cast(pa.large_string()).chunks)


def shard_edges(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each of 2^bits ranges of the sorted keys begins, and the end."""
    if not bits:
        return np.array([0, len(keys)])
    bounds = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


def split(edges: np.ndarray, *columns: np.ndarray):
    """For each non-empty range: (range, bytes of each column's part)."""
    for i in np.flatnonzero(np.diff(edges)):
        yield int(i), *[c[edges[i] : edges[i + 1]].tobytes() for c in columns]


def joined(table: pa.Table, column: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column, and how many each row has."""
    parts = [np.frombuffer(x.as_buffer(), dtype=kind) if x.is_valid else np.zeros(0, kind) for x in table.column(column).combine_chunks()] if table.num_rows else []
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, kind)), sizes


def parts(values: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    return np.split(values, np.cumsum(sizes)[:-1]) if len(sizes) else []
