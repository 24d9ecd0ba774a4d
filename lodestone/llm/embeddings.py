"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

A unit vector u is stored as int8 codes q and a scale s, u = s q + e with the
error's length |e| kept beside it, so that for any two vectors
|u.v - s q . t r| <= |s q||f| + |e||t r| + |e||f|. Tiles of one label meet in
tasks: the codes' products are exact integers, and only pairs whose product
plus bound reaches the threshold are computed again, in double precision from
the vectors themselves. A task returns a row for each vector that it linked
(the number of links, and the root of the vector in the tile pair's forest),
never pairs, so dense clusters stay small.

Equal vectors of one label are joined once, as a class with a weight. Classes
are told by 128 hash bits of label and vector, which are taken as exact.

Defined edge cases: null labels, and vectors that are null, empty, zero or hold
null or non-finite components link with nothing; vectors of different length
do not link; a repeated id is a vector each time; vectors with a null id count
and connect, but name no component unless all of it have null ids; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import _tiles as tiles
from lodestone.llm._shared import bounded_batches, discard, small, table, written
from lodestone.llm.components import components

THRESHOLD = 0.93
#: Slack for the rounding of bounds in double precision; products and pairs of a strip held at a time.
SLACK, STRIP, PAIRS = 1e-9, 1 << 22, 1 << 14
_FOUND = "cid bigint, links bigint, root bigint"


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """codes, scale, length of scale * codes and length of the error of each row of ``x``, as a unit vector."""
    u = x / np.abs(x).max(axis=1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    scale = np.abs(u).max(axis=1) / 127
    codes = np.rint(u / scale[:, None])
    back = codes * scale[:, None]
    return codes.astype(np.int8), scale, np.linalg.norm(back, axis=1), np.linalg.norm(u - back, axis=1)


def _quantised(rows: pa.Table) -> pa.Table:
    codes, scale, length, error = quantised(tiles.matrix(rows, "vector", rows.num_rows))
    kept = pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), codes.shape[1])
    return pa.Table.from_arrays([rows.column("cid"), rows.column("n"), rows.column("vector"), kept, pa.array(scale), pa.array(length), pa.array(error)], names=["cid", "n", "vector", "codes", "scale", "length", "error"])


class Tile:
    """The columns of a packed tile as arrays; vectors are scaled by their largest component, which a cosine does not see."""

    def __init__(self, rows: pa.Table):
        n = rows.num_rows
        self.cid, self.n, self.scale, self.length, self.error = (rows.column(c).to_numpy() for c in ("cid", "n", "scale", "length", "error"))
        codes = tiles.matrix(rows, "codes", n, np.int8)
        # sums of products of codes are whole numbers below 2^24 in single precision, below 2^53 in double
        self.codes = codes.astype(np.float32 if codes.shape[1] * 127**2 < 1 << 24 else np.float64)
        x = tiles.matrix(rows, "vector", n)
        self.vector = x / np.abs(x).max(axis=1, keepdims=True)
        self.norm = np.linalg.norm(self.vector, axis=1)


def links(a: Tile, b: Tile, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of a, rows of b) of all pairs with a cosine of the threshold or more; of one tile with itself each pair once."""
    widest, longest, worst = b.scale.max(), b.length.max(), b.error.max()
    least = (threshold - SLACK - a.length * worst - a.error * longest - a.error * worst) / (a.scale * widest)
    least[least <= 0] = -np.inf  # a bound on positive products says nothing about others
    each = max(1, STRIP // len(b.cid))
    for lo in range(0, len(a.cid), each):
        product = a.codes[lo : lo + each] @ b.codes.T
        i, j = np.nonzero(product >= least[lo : lo + each, None])
        dot = product[i, j].astype(np.float64)
        i += lo
        bound = a.scale[i] * b.scale[j] * dot + a.length[i] * b.error[j] + a.error[i] * (b.length[j] + b.error[j])
        near = bound >= threshold - SLACK
        near &= (i < j) if same else True
        i, j = i[near], j[near]
        for p in range(0, len(i), PAIRS):
            x, y = i[p : p + PAIRS], j[p : p + PAIRS]
            cosine = np.einsum("ij,ij->i", a.vector[x], b.vector[y]) / (a.norm[x] * b.norm[y])
            yes = cosine >= threshold
            yield x[yes], y[yes]


def joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The roots, the smallest of each component, with links between i and j added."""
    while True:
        x, y = root[i], root[j]
        if (x == y).all():
            return root
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while ((up := root[root]) != root).any():
            root = up


def _products(threshold: float):
    def meet(pair: pa.Table) -> pa.Table:
        a = Tile(tiles.opened(pair))
        same = pair.num_rows == 1
        b = a if same else Tile(tiles.opened(pair, 1))
        shift = 0 if same else len(a.cid)
        cid = a.cid if same else np.concatenate([a.cid, b.cid])
        root, count = np.arange(len(cid)), np.zeros(len(cid), dtype=np.int64)
        for i, j in links(a, b, threshold, same):
            np.add.at(count, i, b.n[j])
            np.add.at(count, j + shift, a.n[i])
            root = joined(root, i, j + shift)
        at = np.flatnonzero(count)
        return pa.Table.from_arrays([pa.array(cid[at]), pa.array(count[at]), pa.array(cid[root[at]])], names=["cid", "links", "root"])

    return meet


def linked_vectors(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, elements: int = tiles.TILE_ELEMENTS
) -> DataFrame:
    """id, n_links (other vectors with a cosine of ``threshold`` or more and an equal label), component_id and kept of every row.

    ``elements`` bounds a tile; it changes the tasks, not the result.
    """
    bounded_batches(rows.sparkSession)
    rows = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"), tiles.floats(rows, vector_col).alias("vector"))
    joins = F.col("label").isNotNull() & tiles.finite(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    key = [F.when(joins, F.xxhash64("label", "vector")).alias("ka"), F.when(joins, F.xxhash64(F.lit(1), "vector", "label")).alias("kb")]
    keyed = rows.select("*", *key)
    grouped = keyed.where("ka is not null").groupBy("ka", "kb").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = written(grouped.select(F.monotonically_increasing_id().alias("cid"), "*", F.size("vector").alias("dim")), "classes")
    group = ["label", "dim"]
    sizes = tiles.counted(classes, group, elements)
    parts = tiles.packed(tiles.dealt(classes.select("cid", "n", "vector", *group), sizes, group, "cid"), [*group, "tiles", "tile"], _quantised)
    every = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pairs = every.select(*group, F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "blob")
    found = written(pairs.groupBy(*group, "low", "high").applyInArrow(_products(threshold), _FOUND), "found")
    part = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "cid")
    told = classes.select("cid", "ka", "kb", "n", "id").join(found.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left").where("n > 1 or links > 0")
    told = written(told.join(part, "cid", "left").withColumn("component", F.coalesce("component", "cid")), "told")
    least = written(told.groupBy("component").agg(F.min("id").alias("component_id")), "least")
    final = written(told.join(small(least), "component").select("ka", "kb", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id", F.lit(True).alias("linked")), "linked")
    discard(found, told, least)
    result = keyed.select("id", "ka", "kb").join(small(final), ["ka", "kb"], "left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("id"))
    return result.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op11_int8_tile_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(table(spark, sf_dir, "embeddings"))


_UNIT = "sqrt(list_sum(list_transform({0}.v, lambda x: x * x)))"
QUERIES = {"op11_int8_tile_links": op11_int8_tile_links}
ORACLES = {
    "op11_int8_tile_links": f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_sum(list_transform(list_zip(x.v, y.v), lambda p: p[1] * p[2])) / ({_UNIT.format('x')} * {_UNIT.format('y')}) >= {THRESHOLD}),
r(id, at_) AS (SELECT DISTINCT a, a FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.at_)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.least, e.vec_id) AS component_id, coalesce(c.least, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = e.vec_id LEFT JOIN (SELECT id, min(at_) AS least FROM r GROUP BY id) c ON c.id = e.vec_id
""",
}
