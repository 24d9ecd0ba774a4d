"""Vector search queries over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import vectors
from lodestone.sources.tables import table


def _each(spark: SparkSession, sf_dir: str, k: int, min_score: float | None = None) -> DataFrame:
    """Every vector whose id 50 divides, as a query against all vectors."""
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.where(F.col("vec_id") % 50 == 0).withColumnRenamed("vec_id", "query_id")
    return vectors.cosine_topk_each(rows, queries, "vec_id", "embedding", k, min_score)


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, 5)


def cosine_topk_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, 10, 0.15)


def label_centroid_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector nearest to each label's mean vector."""
    rows = table(spark, sf_dir, "embeddings")
    return vectors.nearest_to_centroids(rows, "label", "vec_id", "embedding")


QUERIES = {f.__name__: f for f in (cosine_topk, cosine_topk_min_score, label_centroid_nearest)}
_COSINE = """round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: p[1]::double * p[2]::double))
  / ((sqrt(list_sum(list_transform(e.embedding, lambda x: x::double * x::double))) + 1e-10)
   * (sqrt(list_sum(list_transform(q.embedding, lambda x: x::double * x::double))) + 1e-10)), 6)"""
ORACLES = {
    "label_centroid_nearest": f"""
WITH m AS (SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i),
c AS (SELECT label, list(x ORDER BY i) AS embedding FROM m GROUP BY label),
s AS (SELECT e.label, e.vec_id, {_COSINE} AS score FROM embeddings e JOIN c q ON e.label = q.label)
SELECT label, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) = 1""",
    **{name: f"""
SELECT q.vec_id AS query_id, e.vec_id, {_COSINE} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, e.vec_id)::INT AS rank
FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0) q
WHERE score >= {least} QUALIFY rank <= {k}""" for name, k, least in (("cosine_topk", 5, -1), ("cosine_topk_min_score", 10, 0.15))},
}
# the same searches by the names that they had beside searches with one vector
for _name in ("cosine_topk", "cosine_topk_min_score"):
    _each_name = _name.replace("topk", "topk_each")
    QUERIES[_each_name], ORACLES[_each_name] = QUERIES[_name], ORACLES[_name]
