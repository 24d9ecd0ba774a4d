"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._shared import BROADCAST_ROWS, discard, written


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = F.broadcast(least) if few else least
    return both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    least = down.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    moved = down.join(F.broadcast(least) if few else least, F.col("a") == F.col("u")).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least).where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every end of an edge (a, b) of bigint; the component is its smallest id.

    Each round is written to the shared folder, so lineage stays short; rounds
    grow with the logarithm of the longest path, and every step is a grouping
    with partial aggregation or a join with one row a vertex. Few vertices are
    broadcast, so a hub's edges stay spread; of more, adaptive skew joins split it.
    """

    def state(df: DataFrame) -> tuple:
        # edges are distinct; two independent 64-bit sums tell one round from the next
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64(F.lit(1), "b", "a"))).first())

    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = state(now)
    while True:
        few = 2 * seen[0] <= BROADCAST_ROWS  # at most so many vertices
        before, now = now, written(_small_star(_large_star(now, few), few), "stars")
        then = state(now)
        discard(before)
        if then == seen:
            break
        seen = then
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
