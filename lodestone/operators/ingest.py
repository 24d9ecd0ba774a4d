"""Document ingest and chunk search: digest skip, chunks, an injected embedding, all-or-nothing per document."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lodestone.functions.rules import usable_text
from lodestone.operators import bm25
from lodestone.operators.chunking import paragraph_chunks
from lodestone.operators.vectors import cosine_topk_each
from lodestone.sources.artifacts import written

LEAST_SCORE, MOST_RESULTS = 0.15, 10
#: Words whose digests a worker holds.
WORDS = 250_000


class _Digits(dict):
    """The first digit of the digest of each word met; cleared where it grows large."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS:
            self.clear()
        found = self[word] = hashlib.md5(word.encode()).digest()[0] >> 4
        return found


_DIGITS = _Digits()


def _hashed(texts: pa.Array) -> pa.Array:
    digit, word = _DIGITS.__getitem__, re.compile("[a-z0-9]+").findall
    told = [bytes(map(digit, word(t.lower()))) if t else b"" for t in texts.to_pylist()]
    sizes = np.fromiter(map(len, told), dtype=np.int64, count=len(told))
    cells = np.repeat(np.arange(len(told)) * 16, sizes) + np.frombuffer(b"".join(told), dtype=np.uint8)
    counts = np.bincount(cells, minlength=len(told) * 16).astype(np.float64).reshape(-1, 16)[sizes > 0]
    ends = np.cumsum(np.where(sizes > 0, 16, 0))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(counts.ravel()), mask=pa.array(sizes == 0))


def hashed_words(text: Column) -> Column:
    """A stand-in for an embedding: words counted by the first digit of their digests; null for texts without a word."""
    return F.arrow_udf(_hashed, ArrayType(DoubleType()))(text)


def plan(source: DataFrame, manifest: DataFrame, key: str, text: str) -> DataFrame:
    """key, digest, action of every document: ``skip`` (same digest; null texts have none), ``reject`` (unusable text), ``build`` or ``remove``."""
    now = source.select(key, F.md5(text).alias("digest"), usable_text(F.col(text)).alias("_usable"), F.lit(True).alias("_here"))
    old = manifest.select(key, F.col("digest").alias("_old"))
    action = (
        F.when(F.col("_here").isNull(), "remove").when(F.col("digest") == F.col("_old"), "skip")
        .when(~F.col("_usable"), "reject").otherwise("build")
    )
    return now.join(old, key, "full_outer").select(key, "digest", action.alias("action"))


def embedded_chunks(docs: DataFrame, key: str, text: str, embed: Callable[[Column], Column] = hashed_words) -> DataFrame:
    """key, id, start, end, text, vector of the chunks; a document of which any chunk has no vector has no rows."""
    chunks = written(paragraph_chunks(docs, key, text).withColumn("vector", embed(F.col("text"))), "chunks")
    failed = chunks.groupBy(key).agg(F.count_if(F.col("vector").isNull()).alias("_failed")).where("_failed > 0")
    return chunks.join(failed, key, "left_anti")


def ingested(source: DataFrame, manifest: DataFrame, chunks: DataFrame, key: str, text: str, embed: Callable[[Column], Column] = hashed_words) -> DataFrame:
    """The chunk table after an ingest: rows of removed documents go, those of built ones are replaced, others stay."""
    actions = plan(source, manifest, key, text)
    build = source.join(actions.where("action = 'build'").select(key), key, "left_semi")
    new = embedded_chunks(build, key, text, embed)
    # a document that failed keeps its old rows until it succeeds
    gone = actions.where("action = 'remove'").select(key).unionByName(new.select(key)).distinct()
    return chunks.join(gone, key, "left_anti").unionByName(new.select(*chunks.columns))


def search(chunks: DataFrame, queries: DataFrame, key: str, k: int = 5, least: float = LEAST_SCORE, query_key: str = "query_id") -> DataFrame:
    """query_key, chunk (``key:id``), score and rank of the best chunks for each query; at most ten each."""
    rows = chunks.select(F.concat_ws(":", key, "id").alias("chunk"), "vector")
    return cosine_topk_each(rows, queries, "chunk", "vector", min(k, MOST_RESULTS), least, query_key)


def search_or_words(chunks: DataFrame | None, index: bm25.Index, queries: DataFrame, key: str, k: int = 5, least: float = LEAST_SCORE) -> DataFrame:
    """query_id, hit, score, rank and method of the best chunks for each query (query_id, vector, terms).

    A query without a chunk that is near enough, and every query where there are
    no chunks, is answered by the words of whole texts.
    """
    kind = index.postings.schema[key].dataType.simpleString()
    words = lambda asked: bm25.search_each(index, key, asked, k).select("query_id", F.col(key).cast("string").alias("hit"), "score", "rank", F.lit("words").alias("method"))
    if chunks is None:
        return words(queries)
    near = written(search(chunks.withColumn(key, F.col(key).cast(kind)), queries.select("query_id", "vector"), key, k, least), "near")
    rest = queries.join(near.select("query_id").distinct(), "query_id", "left_anti")
    return near.select("query_id", F.col("chunk").alias("hit"), "score", "rank", F.lit("vectors").alias("method")).unionByName(words(rest))
