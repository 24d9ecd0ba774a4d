"""A saved table of embedded chunks that tells which model made its vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.commits import Log


def save(chunks: DataFrame, root: str, model: str, dim: int, vector: str = "vector") -> int:
    """Publishes the chunks as the next version; a vector of another length is an error."""
    log = Log(chunks.sparkSession, root)
    version, _ = log.last()
    fits = F.when(F.col(vector).isNull() | (F.size(vector) == dim), F.col(vector)).otherwise(F.raise_error(F.lit(f"a vector has not {dim} elements")))
    return log.commit(version, {"chunks": log.put(chunks.withColumn(vector, fits.cast(chunks.schema[vector].dataType)), "chunks"), "model": model, "dim": dim})


def load(spark: SparkSession, root: str, model: str, dim: int) -> DataFrame | None:
    """The last version's chunks; none where there is none, it was invalidated, or another model or length made it: then all is built anew."""
    log = Log(spark, root)
    _, commit = log.last()
    return log.table(commit["chunks"]) if commit.get("chunks") and (commit["model"], commit["dim"]) == (model, dim) else None


def invalidate(spark: SparkSession, root: str) -> int:
    """Publishes a version without chunks, so the next build starts from nothing; earlier versions stay readable."""
    log = Log(spark, root)
    version, _ = log.last()
    return log.commit(version, {})
