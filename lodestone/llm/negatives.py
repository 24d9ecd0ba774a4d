"""Hard-negative mining with exact integer scores from Kronecker-packed products.

A tile's candidates are shifted to be non-negative, and the j-th components of
all of them are put into separated fields of one wide integer, wide enough that
no field of a sum can reach its neighbour. An anchor multiplies each of these
integers once by its own (shifted) component and adds them up: every field of
the sum is one candidate's shifted score, and taking away the shifts' share
leaves the exact inner product.

Two passes over (tile of rows) x (block of anchors): the first keeps the best
positives of each anchor in each tile, and from them each anchor's positives;
the second keeps, for each positive's score, the best negatives in its range.
A task returns at most that many rows an anchor, never its scores.

Defined edge cases: rows with a null id or label, a null vector, or null or
non-finite components take no part; only rows whose vectors are as long as the
anchor's are its candidates; a row is never its own positive, but another row
of the same id may be; equal scores are ordered by id, equal ids by an
arbitrary number of their row; anchors without positives, and positives without
negatives in range, have no rows; an empty table gives no rows; other columns
are ignored. A score beyond the range of bigint is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lodestone.llm import _tiles as tiles
from lodestone.llm._shared import bounded_batches, small, table, written

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 5, 80, 100, 256
#: Vector elements of a tile of rows and of a block of anchors at most.
TILE_ELEMENTS, BLOCK_ELEMENTS = 1 << 20, 1 << 18
_LONG = 1 << 63
_POSITIVE = "anchor bigint, row bigint, id bigint, score bigint"
_NEGATIVE = "anchor bigint, place int, row bigint, id bigint, score bigint"


def scores(anchors: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
    """The exact inner products of each anchor with all rows, by one multiplication a component of the anchor."""
    n, dim = rows.shape
    if not dim:
        yield from (np.zeros(n, dtype=np.int64) for _ in anchors)
        return
    low_a, low_r, high_a, high_r = int(anchors.min()), int(rows.min()), int(anchors.max()), int(rows.max())
    if dim * max(-low_a, high_a) * max(-low_r, high_r) >= _LONG:
        yield from _checked(anchors, rows)
        return
    bits = (dim * max(1, high_a - low_a) * max(1, high_r - low_r)).bit_length()
    width = 4 if bits <= 32 else 8
    if bits > 64:  # shifts may double both ranges
        yield from _checked(anchors, rows)
        return
    shifted = (rows - low_r).astype(f"<u{width}")
    packed = [int.from_bytes(np.ascontiguousarray(shifted[:, j]).tobytes(), "little") for j in range(dim)]
    # (a - la)(r - lr) = ar - a lr - la r + la lr, summed over the components
    own = rows.sum(axis=1) * low_a
    for anchor in anchors:
        total = 0
        for factor, wide in zip((anchor - low_a).tolist(), packed, strict=True):
            if factor:
                total += factor * wide
        fields = np.frombuffer(total.to_bytes(n * width, "little"), dtype=f"<u{width}").astype(np.uint64).view(np.int64)
        yield fields + own + (int(anchor.sum()) * low_r - dim * low_a * low_r)


def _checked(anchors: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
    """The same with fields of any width and a check of the range."""
    n, dim = rows.shape
    low_a, low_r = int(anchors.min()), int(rows.min())
    most = dim * max(1, int(anchors.max()) - low_a) * max(1, int(rows.max()) - low_r)
    width = most.bit_length() // 8 + 1
    packed = [int.from_bytes(b"".join((x - low_r).to_bytes(width, "little") for x in column), "little") for column in rows.T.tolist()]
    own = [sum(r) * low_a for r in rows.tolist()]
    for anchor in anchors.tolist():
        total = sum((x - low_a) * wide for x, wide in zip(anchor, packed, strict=True)).to_bytes(n * width, "little")
        rest = sum(anchor) * low_r - dim * low_a * low_r
        exact = [int.from_bytes(total[i * width : (i + 1) * width], "little") + o + rest for i, o in enumerate(own)]
        if any(not -_LONG <= x < _LONG for x in exact):
            raise OverflowError("a score is beyond the range of bigint")
        yield np.array(exact, dtype=np.int64)


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest; of equal ones the first."""
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return at[np.argsort(-score[at], kind="stable")[:k]]
    return np.argsort(-score, kind="stable")


def _opened(side: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """The rows by id, their numbers, labels and components."""
    rows = tiles.opened(side).sort_by([("id", "ascending"), ("row", "ascending")])
    return rows, rows.column("row").to_numpy(), rows.column("label").to_numpy(), tiles.matrix(rows, "vector", rows.num_rows, np.int64)


def _positives(k: int):
    def best(tile: pa.Table, block: pa.Table) -> pa.Table:
        rows, number, label, x = _opened(tile)
        anchors, own, wanted, a = _opened(block)
        alike = {v: np.flatnonzero(label == v) for v in np.unique(wanted)}
        found = []
        for i, score in enumerate(scores(a, x)):
            at = alike[wanted[i]]
            at = at[number[at] != own[i]]
            at = at[_best(score[at], k)]
            found.append((np.full(len(at), own[i]), at, score[at]))
        anchor, at, score = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.Table.from_arrays([pa.array(anchor), pa.array(number[at]), rows.column("id").take(pa.array(at)).combine_chunks(), pa.array(score)], names=["anchor", "row", "id", "score"])

    return best


def _negatives(k: int, low: int, high: int):
    def best(tile: pa.Table, block: pa.Table) -> pa.Table:
        rows, number, label, x = _opened(tile)
        anchors, own, wanted, a = _opened(block)
        asked = anchors.column("asked").to_pylist()
        other = {v: np.flatnonzero(label != v) for v in np.unique(wanted)}
        found = [(np.zeros(0, np.int64),) * 4]
        for i, score in enumerate(scores(a, x)):
            at = other[wanted[i]]
            score = score[at]
            # low p <= 100 n <= high p, in whole numbers
            ranges = [(-(-low * p // 100), high * p // 100) for p in asked[i]]
            some = np.flatnonzero((score >= min(r[0] for r in ranges)) & (score <= max(r[1] for r in ranges)))
            for place, (least, most) in enumerate(ranges):
                fits = some[(score[some] >= least) & (score[some] <= most)]
                fits = fits[_best(score[fits], k)]
                found.append((np.full(len(fits), own[i]), np.full(len(fits), place), at[fits], score[fits]))
        anchor, place, at, score = (np.concatenate(c) for c in zip(*found, strict=True))
        arrays = [pa.array(anchor), pa.array(place.astype(np.int32)), pa.array(number[at]), rows.column("id").take(pa.array(at)).combine_chunks(), pa.array(score)]
        return pa.Table.from_arrays(arrays, names=["anchor", "place", "row", "id", "score"])

    return best


def _met(rows: DataFrame, anchors: DataFrame, elements: int, block_elements: int, best, ddl: str) -> DataFrame:
    """``best`` of every tile of rows with every block of anchors of the same vector length."""
    mine, theirs = tiles.counted(rows, ["dim"], elements), tiles.counted(anchors, ["dim"], block_elements)
    left = tiles.packed(tiles.dealt(rows, mine, ["dim"], "row").drop("tiles"), ["dim", "tile"])
    right = tiles.packed(tiles.dealt(anchors, theirs, ["dim"], "row").select(*anchors.columns, F.col("tile").alias("block")), ["dim", "block"])
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.join(small(theirs), "dim").select("dim", "tile", each("tiles").alias("block"), "blob")
    right = right.join(small(mine), "dim").select("dim", each("tiles").alias("tile"), "block", "blob")
    meeting = ["dim", "tile", "block"]
    return left.groupBy(*meeting).cogroup(right.groupBy(*meeting)).applyInArrow(best, ddl)


def mined_negatives(
    rows: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, tile_elements: int = TILE_ELEMENTS, block_elements: int = BLOCK_ELEMENTS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``anchors`` (on columns id and label) picks the anchors. Components become
    floor(scale * x); a positive is one of the ``positives`` best rows of the
    anchor's label, its negatives the ``negatives`` best rows of other labels
    with ``low`` to ``high`` hundredths of its score.
    """
    bounded_batches(rows.sparkSession)
    label = F.col(label_col).cast("bigint") if isinstance(rows.schema[label_col].dataType, IntegralType) else F.xxhash64(label_col)
    vector = F.transform(vector_col, lambda x: F.floor(scale * x.cast("double")).cast("bigint"))
    part = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & tiles.finite(F.col(vector_col)))
    part = part.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), label.alias("label"), vector.alias("vector"), F.size(vector_col).alias("dim"))
    part = written(part, "whole-numbers")
    asking = part.where(anchors)
    order = [F.desc("score"), "id", "row"]
    first = _met(part, asking, tile_elements, block_elements, _positives(positives), _POSITIVE)
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(*order))
    near = written(first.withColumn("place", place - 1).where(F.col("place") < positives), "positives")
    asked = near.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda p: p["score"]).alias("asked"))  # at most ``positives`` each
    again = asking.join(asked, F.col("row") == F.col("anchor")).drop("anchor")
    second = _met(part, again, tile_elements, block_elements, _negatives(negatives, low, high), _NEGATIVE)
    rank = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(*order))
    hard = second.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    told = near.select("anchor", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = told.join(asking.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return hard.join(named, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_kronecker_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth label moved on where 7 divides the id; anchors are the rows whose id 100 divides."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined_negatives(rows.withColumn("label", moved), F.col("id") % 100 == 0)


QUERIES = {"op12_kronecker_negatives": op12_kronecker_negatives}
ORACLES = {
    "op12_kronecker_negatives": f"""
WITH e AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS alike, list_sum(list_transform(list_zip(a.v, e.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM e a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
""",
}
