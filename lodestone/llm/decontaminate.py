"""Benchmark decontamination by winnowing.

Both sides keep the smallest k-gram hash of every run of ``window - k + 1``
k-grams, so any shared span of ``window`` words shares at least one kept hash.
Kept hashes are extended to the ``window``-word spans around them; fingerprints
of training and test texts, each a kept hash with the place and the 64-bit hash
of such a span, meet in a Spark join. Items that share a span are one
fingerprint there, and are told apart once a text. Items of fewer words than
``window`` are one span of their whole length, kept under that length.

Defined edge cases: null or empty texts have no words and no hits; repeated
rows and null ids each get their own result row; an item without an id counts
under the name "null"; rows of items that share an id are one item; an empty
benchmark hits nothing; other columns are ignored. A text is cut whole, so a
task needs about 100 bytes of memory a byte of its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import _text as T
from lodestone.llm._shared import bounded_batches, small, table, written

WINDOW, GRAM = 10, 5
#: Name of an item without an id.
NO_ID = "null"
FILTER_BITS = 1 << 22

_PRINT = "array<struct<print:bigint,size:int,pos:int,spans:array<bigint>>>"
_PRINT_PA = pa.list_(pa.struct([("print", pa.int64()), ("size", pa.int32()), ("pos", pa.int32()), ("spans", pa.list_(pa.int64()))]))


def winnow(grams: np.ndarray, at: np.ndarray, run: int) -> np.ndarray:
    """Indexes of the grams that are the smallest (the last of equals) of some run of consecutive grams."""
    n = len(grams) - run + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = grams[:n].copy()
    for j in range(1, run):
        np.minimum(least, grams[j : n + j], out=least)
    whole = at[run - 1 :] - at[:n] == run - 1
    picked = np.zeros(len(grams), dtype=bool)
    open_ = whole
    for j in range(run - 1, -1, -1):
        mine = open_ & (grams[j : n + j] == least)
        picked[j : n + j] |= mine
        open_ = open_ & ~mine
    return np.flatnonzero(picked)


def _prints(data: np.ndarray, offsets: np.ndarray, window: int, k: int, short: list[int], bits: np.ndarray | None, whole: bool):
    """Words per text and, for each kept fingerprint, (text, hash, span size, position in the text, spans around it)."""
    words = T.cut(data, offsets, T.ALNUM)
    hashes = T.word_hashes(data, words, lower=True)
    found = []

    def keep(prints: np.ndarray, at: np.ndarray, size: int, spans: np.ndarray) -> None:
        if bits is not None:
            slot = prints & np.uint64(FILTER_BITS - 1)
            ok = (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
            prints, at, spans = prints[ok], at[ok], spans[ok]
        found.append((words.doc[at], prints, np.full(len(at), size, np.int32), at - words.first[words.doc[at]], spans))

    run = window - k + 1
    at, grams = T.windows(hashes, words, k)
    chosen = winnow(grams, at, run)
    begin, span = T.windows(hashes, words, window, seed=2)
    by_word = np.zeros(len(hashes) + 1, dtype=np.uint64)
    by_word[begin] = span | np.uint64(1)  # 0: no window begins here
    where = at[chosen]
    if bits is not None and len(where):
        slot = grams[chosen] & np.uint64(FILTER_BITS - 1)
        ok = (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
        chosen, where = chosen[ok], where[ok]
    back = where[:, None] - np.arange(run)[None, :]
    inside = back >= words.first[words.doc[where]][:, None]
    keep(grams[chosen], where, window, np.where(inside, by_word[np.maximum(back, 0)], np.uint64(0)))
    for size in short:
        if whole:
            items = np.flatnonzero(words.counts == size)
            at = words.first[items]
            grams = T.ranges_hash(hashes, at, at + size, 3)
        else:
            at, grams = T.windows(hashes, words, size, seed=2)
        keep(grams, at, size, (grams | np.uint64(1))[:, None])
    return words.counts, found


def _rows(found, n: int) -> pa.Array:
    doc = np.concatenate([f[0] for f in found])
    order = np.argsort(doc, kind="stable")
    widths = np.concatenate([np.full(len(f[0]), f[4].shape[1], np.int64) for f in found])
    flat = [row for f in found for row in f[4].view(np.int64)]
    spans = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(widths[order])]).astype(np.int32)),
        pa.array(np.concatenate([flat[i] for i in order]) if len(order) else np.zeros(0, np.int64)),
    )
    parts = [pa.array(np.concatenate([f[i] for f in found])[order].astype(t)) for i, t in ((1, np.uint64), (2, np.int32), (3, np.int32))]
    parts[0] = parts[0].view(pa.int64())
    values = pa.StructArray.from_arrays([*parts, spans], fields=list(_PRINT_PA.value_type))
    offsets = np.searchsorted(doc[order], np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _scanner(window: int, k: int, short: list[int], bits, whole: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_bits = bits.value if bits is not None else None
        for batch in batches:
            for lo, hi, data, offsets in T.slices(batch.column(1)):
                counts, found = _prints(data, offsets, window, k, short, filter_bits, whole)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(counts.astype(np.int64)), _rows(found, hi - lo)],
                    names=["id", "n_words", "prints"],
                )

    return T.trimmed(scan)


def _scan(df: DataFrame, id_col: str, text_col: str, *how) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _scanner(*how), f"id {kind}, n_words bigint, prints {_PRINT}"
    )


def benchmark_hits(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", window: int = WINDOW, k: int = GRAM,
) -> DataFrame:
    """Per row of ``docs``: id, n_words, n_hit, items (sorted ids as text), starts (hit spans as structs of start and size)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    lengths = items.select(
        F.size(F.regexp_extract_all(F.translate(item_text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))).alias("n")
    )
    # at most window - 1 numbers
    short = sorted(r.n for r in lengths.where((F.col("n") > 0) & (F.col("n") < window)).distinct().collect())
    tests = (
        _scan(items, item_col, item_text, window, k, short, None, True)
        .select(F.coalesce(F.col("id").cast("string"), F.lit(NO_ID)).alias("item"), F.explode("prints").alias("p"))
        .select("item", "p.print", "p.size", F.col("p.spans").alias("item_spans"))
        .distinct()
    )
    # the filter has FILTER_BITS bits at most, however many items there are
    slot = F.col("print").bitwiseAND(FILTER_BITS - 1)
    words = tests.groupBy(F.shiftright(slot, 6).alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast((print & {FILTER_BITS - 1}) & 63 as int))")).alias("bits")
    ).collect()
    bits = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    for r in words:
        bits[r.w] = np.uint64(r.bits & 0xFFFFFFFFFFFFFFFF)
    # a window is known by its fingerprint and its place among the windows that share it; items that share one meet a text once
    at_item = tests.select("item", "print", "size", F.posexplode("item_spans").alias("o", "span")).where("span != 0")
    at_item = written(at_item.distinct(), "windows")
    window_key = ["print", "size", "o", "span"]
    known = written(at_item.select(*window_key).distinct(), "known")
    scanned = _scan(docs, id_col, text_col, window, k, short, spark.sparkContext.broadcast(bits), False).withColumn("row", F.monotonically_increasing_id())
    scanned = written(scanned, "prints")
    placed = scanned.select("row", F.explode("prints").alias("p")).select("row", "p.print", "p.size", "p.pos", F.posexplode("p.spans").alias("o", "span")).where("span != 0")
    hits = written(placed.join(small(known), window_key, "left_semi").select("row", *window_key, (F.col("pos") - F.col("o")).alias("start")).distinct(), "hits")
    starts = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("starts"))
    held = hits.select("row", *window_key).distinct().join(small(at_item), window_key).select("row", "item").distinct()
    named = held.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    rows = scanned.select("row", "id", "n_words").join(starts, "row", "left").join(named, "row", "left")
    none = F.expr("cast(array() as array<struct<start:int,size:int>>)")
    grouped = rows.select("id", "n_words", F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"), F.coalesce("starts", none).alias("starts"))
    covered = F.expr(
        "aggregate(starts, struct(0L as upto, 0L as n), (a, s) -> struct("
        "greatest(a.upto, cast(s.start + s.size as bigint)) as upto,"
        "a.n + greatest(0L, cast(s.start + s.size as bigint) - greatest(a.upto, cast(s.start as bigint))) as n)).n"
    )
    return grouped.select(F.col("id").alias(id_col), "n_words", covered.alias("n_hit"), "items", "starts")


def op7_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {"op7_winnowing_decontamination": op7_winnowing_decontamination}
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES = {
    "op7_winnowing_decontamination": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS} AS words FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '{NO_ID}') AS item, {_WORDS} AS words, least({WINDOW}, len(words)) AS size FROM benchmark),
t AS (SELECT DISTINCT item, size, array_to_string(list_slice(words, k, k + size - 1), ' ') AS g FROM b, unnest(generate_series(1, len(words) - size + 1)) AS u(k) WHERE size > 0),
sizes AS (SELECT DISTINCT size FROM t),
x AS (SELECT rid, size, k, array_to_string(list_slice(words, k, k + size - 1), ' ') AS g FROM d, sizes, unnest(generate_series(1, len(words) - size + 1)) AS u(k)),
h AS MATERIALIZED (SELECT rid, k, size, item FROM x JOIN t USING (size, g)),
n AS (SELECT rid, count(DISTINCT k + o) AS n_hit FROM h, unnest(generate_series(0, size - 1)) AS u(o) GROUP BY rid),
i AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (rid) LEFT JOIN i USING (rid)
""",
}
