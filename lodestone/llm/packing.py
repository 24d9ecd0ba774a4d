"""Best-fit packing of tokenised documents into fixed-length sequences.

Only the number of pieces of each length decides a packing, so it is planned
on a histogram of at most ``capacity`` rows: pieces above a third of the
capacity are matched, largest with the largest that still fits, at most two to
a sequence; smaller pieces, largest first, go into the tightest gap. The plan
is a bounded table of runs ("pieces L number a to b of their length lie in
sequences from s on, at offset o"); pieces are numbered within their length by
prefix sums over hash buckets, so no length is gathered in one task.

Defined edge cases: null and empty texts are one piece holding only the end
id; repeated rows are packed each, equal id and piece in any order; null ids
are packed like others; an empty table gives no rows; a text of any length is
cut into pieces of the capacity; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import _text as T
from lodestone.llm import bpe
from lodestone.llm._shared import bounded_batches, table, written

CAPACITY = 2048
END_ID = 0
BUCKET_ROWS = 100_000
_RUN = "length bigint, rank_lo bigint, rank_hi bigint, sequence bigint, each bigint, place bigint"


@dataclass
class Bins:
    """Sequences first .. first + count - 1, all filled up to ``used``."""

    first: int
    count: int
    used: int


def plan_runs(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, rank from, rank to, first sequence, pieces a sequence, offset of the first) covering every rank."""
    left = dict(histogram)
    taken: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[Bins]] = defaultdict(list)
    sequences = 0

    def put(length: int, pieces: int, first: int, each: int, place: int) -> None:
        runs.append((length, taken[length], taken[length] + pieces, first, each, place))
        taken[length] += pieces
        left[length] -= pieces

    def leave(first: int, count: int, used: int) -> None:
        if count and used < capacity:
            gaps[capacity - used].append(Bins(first, count, used))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((n for n in large if n <= min(a, capacity - a) and left[n] > (n == a)), 0)
            count = min(left[a], left[b]) if 0 < b < a else left[a] // 2 if b else left[a]
            put(a, count, sequences, 1, 0)
            if b:
                put(b, count, sequences, 1, a)
            leave(sequences, count, a + b)
            sequences += count
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            gap = min((g for g, bins in gaps.items() if g >= n and bins), default=0)
            if not gap:
                each = capacity // n
                bins = Bins(sequences, -(-left[n] // each), 0)
                sequences += bins.count
                gap = capacity
            else:
                bins = gaps[gap].pop()
            each = gap // n
            full = min(bins.count, left[n] // each)
            put(n, full * each, bins.first, each, bins.used) if full else None
            leave(bins.first, full, bins.used + each * n)
            rest = Bins(bins.first + full, bins.count - full, bins.used)
            if rest.count and left[n]:
                some = left[n]
                put(n, some, rest.first, some, rest.used)
                leave(rest.first, 1, rest.used + some * n)
                rest = Bins(rest.first + 1, rest.count - 1, rest.used)
            leave(rest.first, rest.count, rest.used)
    return runs


def _pieces(path: str, capacity: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            for lo, hi, counts, ids in bpe.encoded(batch.column(1), path):
                whole = counts + 1
                number = -(-whole // capacity)
                doc = np.repeat(np.arange(hi - lo), number)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
                head = whole - (number - 1) * capacity
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[doc], capacity)
                base = np.cumsum(counts) - counts
                ids = ids.astype("<u4", copy=False)
                crc = np.empty(len(doc), dtype=np.int64)
                last = piece == number[doc] - 1
                a, n = base[doc] + start, length - last
                for i, (p, q, closes) in enumerate(zip(a.tolist(), n.tolist(), last.tolist(), strict=True)):
                    value = zlib.crc32(ids[p : p + q])
                    crc[i] = zlib.crc32(end, value) if closes else value
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(lo + doc)), pa.array(piece.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(length.astype(np.int64)), pa.array(crc)],
                    names=["id", "piece", "start", "length", "ids_crc32"],
                )

    return T.trimmed(cut)


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """id, piece, start, length, ids_crc32: ids of each text and one end id; longer ones are cut, the first piece taking the rest."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _pieces(path, capacity, end_id), f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY, salt: str | None = None) -> DataFrame:
    """``pieces`` (id, piece, length of 1 to capacity, ...) with sequence_id and offset; scanned three times.

    Pieces are numbered in buckets, by ``salt`` if there is a column that tells equal rows apart, else by all columns.
    """
    spark = pieces.sparkSession
    counted = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    runs = spark.createDataFrame(plan_runs(counted, capacity), _RUN)
    buckets = 32 + sum(counted.values()) // BUCKET_ROWS
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64(*([salt] if salt else pieces.columns)), F.lit(buckets)).cast("int"))
    sizes = bucketed.groupBy(F.col("length").alias("l"), F.col("bucket").alias("b")).agg(F.count("*").alias("n"))
    before = sizes.select("l", "b", (F.sum("n").over(Window.partitionBy("l").orderBy("b")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece")) - 1
    ranked = bucketed.withColumn("rank", rank).join(before, (F.col("length") == F.col("l")) & (F.col("bucket") == F.col("b"))).withColumn("rank", F.col("rank") + F.col("before"))
    runs = F.broadcast(runs.withColumnRenamed("length", "run_length"))  # bounded by the capacity, not by the corpus
    placed = ranked.join(runs, (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("rank_lo")) & (F.col("rank") < F.col("rank_hi")))
    nth = F.col("rank") - F.col("rank_lo")
    return placed.select(
        *[c for c in pieces.columns if c != salt],
        (F.col("sequence") + F.floor(nth / F.col("each")).cast("bigint")).alias("sequence_id"),
        (F.col("place") + (nth % F.col("each")) * F.col("length")).alias("offset"),
    )


def packed_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    pieces = token_pieces(docs, path or bpe.default_path(), id_col, text_col, capacity)
    pieces = written(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    return pack(pieces, capacity, "_row").withColumnRenamed("id", id_col)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op2_best_fit_packing": op2_best_fit_packing}
ORACLES: dict[str, str] = {}
