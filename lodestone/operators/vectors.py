"""Exact vector search: cosine scores, thresholds and top-k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestone.sources.artifacts import few, written

EPSILON = 1e-10
#: Rows and queries that meet in one task, the elements (of 8 bytes) that either may have, and how many are multiplied at a time.
ROW_BLOCK, QUERY_BLOCK, ELEMENTS, ROW_CELL, QUERY_CELL = 1 << 17, 1 << 16, 1 << 21, 2048, 256


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """a.b / ((|a| + e)(|b| + e)), computed in double."""
    return dot(a, b) / ((F.sqrt(dot(a, a)) + EPSILON) * (F.sqrt(dot(b, b)) + EPSILON))


def cosine_topk(
    rows: DataFrame, query: DataFrame, key: str, vector: str, k: int, min_score: float | None = None
) -> DataFrame:
    """The k rows nearest to the one vector in ``query`` (one row, so it is broadcast).

    Rows without a vector are left out; scores are rounded to 6 places so that
    ties break by key on any machine. ``min_score`` filters before the limit.
    """
    q = query.select(F.col(vector).alias("_query")).limit(1)
    scored = (
        rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0))
        .crossJoin(F.broadcast(q))
        .select(key, F.round(cosine(F.col(vector), F.col("_query")), 6).alias("score"))
    )
    if min_score is not None:
        scored = scored.where(F.col("score") >= min_score)
    return scored.orderBy(F.desc("score"), key).limit(k)


def _normalised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths plus EPSILON; the vectors over them, in single precision)."""
    with np.errstate(invalid="ignore", over="ignore"):
        sizes = np.linalg.norm(vectors, axis=1) + EPSILON
        return sizes, (vectors / sizes[:, None]).astype(np.float32)


def _nearest(x: np.ndarray, q: np.ndarray, k: int, min_score: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k best rows of ``x`` for each row of ``q``; of equal scores the earlier rows.

    Products in single precision tell which pairs can still be among the k best
    of their query; only these are computed in double precision. The margin is
    above the error of such a product and of the rounding.
    """
    (x_size, x_unit), (q_size, q_unit) = _normalised(x), _normalised(q)
    margin = 1e-6 + (x.shape[1] + 8) * 2.0**-23
    least = -np.inf if min_score is None else min_score
    found = []
    for q0 in range(0, len(q), QUERY_CELL):
        asked = q_unit[q0 : q0 + QUERY_CELL]
        # the best so far by query, best first; a later row has to be better than the last of k
        best_q, best_x, best = (np.empty(0, dtype=t) for t in (np.int64, np.int64, np.float64))
        floor = np.full(len(asked), least - margin)
        for x0 in range(0, len(x), ROW_CELL):
            score = asked @ x_unit[x0 : x0 + ROW_CELL].T
            if x0 == 0 and score.shape[1] > k:
                with np.errstate(invalid="ignore"):
                    kth = np.partition(np.where(np.isnan(score), -np.inf, score), -k, axis=1)[:, -k]
                floor = np.maximum(floor, kth - 2 * margin)
            i, j = np.nonzero(score >= floor[:, None].astype(np.float32))
            if not len(i):
                continue
            j += x0
            with np.errstate(invalid="ignore", over="ignore"):
                exact = np.round(np.einsum("ij,ij->i", q[q0 + i], x[j]) / (q_size[q0 + i] * x_size[j]), 6)
            held = exact >= least  # not for NaN
            best_q, best_x, best = (np.concatenate(pair) for pair in ((best_q, i[held]), (best_x, j[held]), (best, exact[held])))
            order = np.lexsort((best_x, -best, best_q))
            best_q, best_x, best = best_q[order], best_x[order], best[order]
            counts = np.bincount(best_q, minlength=len(asked))
            starts = np.cumsum(counts) - counts
            kept = np.arange(len(best_q)) - starts[best_q] < k
            best_q, best_x, best = best_q[kept], best_x[kept], best[kept]
            full = np.flatnonzero(counts >= k)
            lasts = np.cumsum(np.minimum(counts, k))[full] - 1
            floor[full] = np.where(best[lasts] < 1, np.maximum(floor[full], best[lasts] - margin), np.inf)  # nothing is above 1
        found.append((best_q + q0, best_x, best))
    return tuple(np.concatenate(parts) for parts in zip(*found, strict=True))


def _best_of_blocks(k: int, min_score: float | None, schema: pa.Schema):
    """The k best rows of a block of rows for each query of a block of queries."""

    def matrix(t: pa.Table, at: np.ndarray, size: int) -> np.ndarray:
        flat = t.column("vector").take(pa.array(at)).combine_chunks().flatten()
        return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)

    def best(rows: pa.Table, queries: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")  # ties go to the smaller key
        sizes, wanted = (t.column("vector").combine_chunks().value_lengths().to_numpy() for t in (rows, queries))
        found = [schema.empty_table()]
        for size in np.intersect1d(sizes, wanted):
            own, asked = np.flatnonzero(sizes == size), np.flatnonzero(wanted == size)
            i, j, score = _nearest(matrix(rows, own, size), matrix(queries, asked, size), k, min_score)
            found.append(pa.Table.from_arrays([queries.column("query").take(pa.array(asked[i])), rows.column("id").take(pa.array(own[j])), pa.array(score)], schema=schema))
        return pa.concat_tables(found)

    return best


def _blocks(vectors: DataFrame, most: int, least: int) -> int:
    """Blocks of at most ``most`` rows and ELEMENTS elements; as many as there are cores if they still have ``least`` rows."""
    rows, elements = vectors.agg(F.count("*"), F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-rows // most), -(-elements // ELEMENTS), min(2 * cores, rows // least))


def cosine_topk_each(
    rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, min_score: float | None = None, query_key: str = "query_id"
) -> DataFrame:
    """query_key, key, score and rank (from 1) of the k rows nearest to each row of ``queries``, which have ``query_key`` and a vector.

    Every block of rows meets every block of queries and keeps k rows a query;
    the k best of those are the result. Vectors are compared with those of their
    own length; rows and queries without a vector, or with null or NaN elements,
    are left out. Scores, ties and ``min_score`` are as in ``cosine_topk``.
    Every pair is compared, so time grows with rows times queries; what is sent
    grows with them over the size of a block.
    """
    held = F.col(vector).isNotNull() & (F.size(vector) > 0)
    # written: both are counted first, and their vectors may be dear
    rows = written(rows.where(held).select(F.col(key).alias("id"), F.col(vector).alias("vector")), "rows")
    queries = written(queries.where(held).select(F.col(query_key).alias("query"), F.col(vector).alias("vector")), "asked")
    n_rows, n_queries = _blocks(rows, ROW_BLOCK, ROW_CELL), _blocks(queries, QUERY_BLOCK, QUERY_BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    left = rows.withColumn("rb", mine("id", n_rows)).withColumn("qb", every(n_queries))
    right = queries.withColumn("qb", mine("query", n_queries)).withColumn("rb", every(n_rows))
    kinds = {"query": queries.schema["query"].dataType, "id": rows.schema["id"].dataType}
    schema = to_arrow_schema(StructType([*(StructField(n, t) for n, t in kinds.items()), StructField("score", DoubleType())]))
    ddl = ", ".join([*(f"`{n}` {t.simpleString()}" for n, t in kinds.items()), "score double"])
    partial = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(_best_of_blocks(k, min_score, schema), ddl)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    best = partial.withColumn("_place", place).where(F.col("_place") <= k)
    return best.select(F.col("query").alias(query_key), F.col("id").alias(key), F.round("score", 6).alias("score"), F.col("_place").alias("rank"))


def centroids(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """The mean vector of each group, element by element with partial aggregation."""
    each = rows.select(by, F.posexplode(vector).alias("i", "x"))
    means = each.groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("centroid"))


def nearest_to_centroids(rows: DataFrame, by: str, key: str, vector: str) -> DataFrame:
    """The row of each group with the highest cosine to the group's centroid; ties go to the smaller key."""
    means = written(centroids(rows, by, vector), "centroids")
    elements = means.agg(F.coalesce(F.sum(F.size("centroid")), F.lit(0))).first()[0]
    scored = rows.join(few(means, elements), by).select(by, key, F.round(cosine(F.col(vector), F.col("centroid")), 6).alias("score"))
    best = scored.groupBy(by).agg(F.max(F.struct("score", (-F.col(key)).alias("k"))).alias("m"))
    return best.select(by, (-F.col("m.k")).alias(key), F.col("m.score").alias("score"))
