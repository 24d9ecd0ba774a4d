"""Line search, windows of lines, and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 1), line."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("p", "line")).select(key, (F.col("p") + 1).alias("line_no"), "line")


def grep(df: DataFrame, key: str, text: str, needle: str) -> DataFrame:
    """Lines that contain the literal, either case; stripped and cut to 200 characters."""
    # the whole text is tested first, so most texts are never split
    hits = lines(df.where(F.contains(F.lower(text), F.lit(needle.lower()))), key, text)
    return hits.where(F.contains(F.lower("line"), F.lit(needle.lower()))).withColumn("line", F.substring(F.trim("line"), 1, 200))


def grep_regex(df: DataFrame, key: str, text: str, pattern: str, max_results: int) -> DataFrame:
    """The first ``max_results`` matching lines of each text; an invalid pattern is a case-sensitive literal."""
    spark = df.sparkSession
    try:
        spark.range(1).select(F.lit("").rlike(pattern)).collect()
        test = F.col("line").rlike(pattern)
    except Exception:  # noqa: BLE001 - the engine's own regex parser decides
        test = F.contains("line", F.lit(pattern))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("line_no"))
    return lines(df, key, text).where(test).withColumn("_rank", rank).where(F.col("_rank") <= max_results).drop("_rank")


def with_context(df: DataFrame, key: str, text: str, needle: str, around: int) -> DataFrame:
    """Each matching line with ``around`` lines before and after."""
    cut = df.where(F.contains(F.lower(text), F.lit(needle.lower()))).select(key, F.split(text, "\n").alias("all"))
    hit = cut.select(key, "all", F.posexplode("all").alias("p", "line")).where(F.contains(F.lower("line"), F.lit(needle.lower())))
    first = F.greatest(F.lit(0), F.col("p") - around)
    return hit.select(key, (F.col("p") + 1).alias("line_no"), F.array_join(F.slice("all", first + 1, F.col("p") + around - first + 1), "\n").alias("context"))


def view_window(text: Column, start: int, end: int | None, context: int) -> Column:
    """Lines start..end and ``context`` more on either side."""
    cut = F.split(text, "\n")
    first = max(0, max(1, start) - 1 - context)
    last = F.least(F.size(cut), (F.lit(end) if end else F.size(cut)) + context)
    return F.array_join(F.slice(cut, F.lit(first + 1), F.greatest(last - first, F.lit(0))), "\n")


def split_lines(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """key, part (from 1), start_line, end_line, text of every ``size`` lines."""
    cut = df.select(key, F.split(text, "\n").alias("all"))
    starts = F.sequence(F.lit(0), F.size("all") - 1, F.lit(size))
    at = cut.select(key, "all", F.posexplode(starts).alias("i", "s"))
    return at.select(key, (F.col("i") + 1).alias("part"), (F.col("s") + 1).alias("start_line"), F.least(F.col("s") + size, F.size("all")).alias("end_line"), F.array_join(F.slice("all", F.col("s") + 1, F.lit(size)), "\n").alias("text"))


def first_of_each(df: DataFrame, by: Column, order: str, columns: list[str]) -> DataFrame:
    """The row with the smallest ``order`` of each group, by partial aggregation rather than a window."""
    return df.groupBy(by.alias("_by")).agg(F.min_by(F.struct(*columns), order).alias("_row")).select("_row.*")
