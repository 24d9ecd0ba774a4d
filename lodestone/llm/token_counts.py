"""Exact length histogram of encoded documents, with suffix sums.

One row for each length that occurs. For any context limit L the row of the
greatest length <= L answers: ``docs_over`` documents are cut, and the corpus
keeps ``tokens_upto + L * docs_over`` tokens (``kept_at_limit`` where L is the
row's own length); with no such row every document is cut. The first row whose
``docs_upto`` reaches q times all documents has the q-quantile.

Defined edge cases: null and empty texts have length 0; repeated rows and rows
without an id count each; an empty table gives no rows; other columns are
ignored; a text of any length is encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import _text as T
from lodestone.llm import bpe
from lodestone.llm._shared import bounded_batches, table


def _lengths(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, counts, _ in bpe.encoded(batch.column(0), path, want_ids=False):
                lengths, n = np.unique(counts, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(lengths.astype(np.int64)), pa.array(n.astype(np.int64))], names=["n_tokens", "n_docs"])

    return T.trimmed(count)


def length_histogram(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """n_tokens, n_docs; counted within tasks before the shuffle."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(_lengths(path or bpe.default_path()), "n_tokens bigint, n_docs bigint")
    return rows.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """Adds docs_upto, tokens_upto (this length and shorter), docs_over, tokens_over (longer ones), kept_at_limit and quantile.

    The histogram has as many rows as there are lengths, at most the longest
    text's length, whatever the number of documents; one window orders it.
    """
    upto = Window.orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tokens = F.col("n_tokens") * F.col("n_docs")
    sums = histogram.select(
        "n_tokens", "n_docs",
        F.sum("n_docs").over(upto).alias("docs_upto"), F.sum(tokens).over(upto).alias("tokens_upto"),
        F.sum("n_docs").over(whole).alias("docs"), F.sum(tokens).over(whole).alias("tokens"),
    )
    over = F.col("docs") - F.col("docs_upto")
    return sums.select(
        "n_tokens", "n_docs", "docs_upto", "tokens_upto",
        over.alias("docs_over"), (F.col("tokens") - F.col("tokens_upto")).alias("tokens_over"),
        (F.col("tokens_upto") + over * F.col("n_tokens")).alias("kept_at_limit"),
        (F.col("docs_upto") / F.col("docs")).alias("quantile"),
    )


def totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """One row for each limit: docs and tokens in all, docs cut, tokens kept when every text is cut to the limit.

    The row of the greatest length up to each limit, picked by one aggregation over the suffix sums.
    """
    spark = sums.sparkSession
    if not limits:
        return spark.createDataFrame([], "context_limit bigint, docs bigint, tokens bigint, docs_cut bigint, tokens_kept bigint")
    at = [F.max_by(F.struct("docs_over", "tokens_upto"), F.when(F.col("n_tokens") <= x, F.col("n_tokens"))).alias(f"at_{i}") for i, x in enumerate(limits)]
    whole = sums.agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("tokens"), *at)
    answers = [
        F.struct(
            F.lit(x).cast("bigint").alias("context_limit"), F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce(f"at_{i}.docs_over", "docs", F.lit(0)).alias("docs_cut"),
            (F.coalesce(f"at_{i}.tokens_upto", F.lit(0)) + x * F.coalesce(f"at_{i}.docs_over", "docs", F.lit(0))).cast("bigint").alias("tokens_kept"),
        )
        for i, x in enumerate(limits)
    ]
    return whole.select(F.inline(F.array(*answers)))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the least length that so large a share of the documents does not exceed."""
    found = sums.agg(*[F.min(F.when(F.col("quantile") >= q, F.col("n_tokens"))).alias(f"q_{i}") for i, q in enumerate(shares)])
    return found.select(F.inline(F.array(*[F.struct(F.lit(float(q)).alias("share"), F.col(f"q_{i}").alias("n_tokens")) for i, q in enumerate(shares)])))


def op5_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_suffix_sums(length_histogram(table(spark, sf_dir, "documents")))


QUERIES = {"op5_length_histogram": op5_length_histogram}
ORACLES: dict[str, str] = {}
