"""Conversation turns: pairing, line ranges, tails and two-stage search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import keyword_score


def pairs(messages: DataFrame, session: str, order: str) -> DataFrame:
    """An assistant message and the user message just before it (other roles aside), numbered from 1.

    Of consecutive user messages the last one wins; an assistant without a user is left out.
    """
    by = Window.partitionBy(session).orderBy(order)
    said = messages.where(F.col("role").isin("user", "assistant"))
    before = said.withColumn("prev_role", F.lag("role").over(by)).withColumn("user_text", F.lag("text").over(by)).withColumn("start_line", F.lag(order).over(by) + 1)
    found = before.where((F.col("role") == "assistant") & (F.col("prev_role") == "user"))
    return found.select(session, F.row_number().over(by).alias("turn_no"), "user_text", F.col("text").alias("assistant_text"), "start_line", (F.col(order) + 1).alias("end_line"))


def tail(messages: DataFrame, session: str, order: str, n: int) -> DataFrame:
    """The last n user and assistant messages of each session, without assistant messages at the head."""
    said = messages.where(F.col("role").isin("user", "assistant"))
    last = said.withColumn("_r", F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))).where(F.col("_r") <= n).drop("_r")
    opened = F.max((F.col("role") == "user").cast("int")).over(Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return last.withColumn("_open", opened).where(F.col("_open") == 1).drop("_open")


def keyword_rank(turns: DataFrame, query: str, pool: int, k: int, keys: list[str]) -> DataFrame:
    """The ``pool`` best by keywords, reranked by the share of the query in a passage of 800 characters of each of ``halves``, then k."""
    both = F.concat_ws(" ", "user_text", "assistant_text")
    passage = F.concat_ws("\n", *[F.substring(half, 1, 800) for half in ("user_text", "assistant_text")])
    scored = turns.select(*keys, F.round(keyword_score(both, query), 6).alias("score"), F.round(keyword_score(passage, query), 6).alias("rerank"))
    best = scored.where("score > 0").orderBy(F.desc("score"), *keys).limit(pool)
    return best.orderBy(F.desc("rerank"), F.desc("score"), *keys).limit(k)


def valid_prefix(index: DataFrame, turns: DataFrame, session: str) -> DataFrame:
    """Index entries before the first that differs from the turns."""
    t = turns.select(session, F.col("turn_no"), F.col("user_text").alias("u"), F.col("assistant_text").alias("a"))
    joined = index.join(t, [session, "turn_no"], "left").withColumn("same", F.col("user_text").eqNullSafe(F.col("u")) & F.col("assistant_text").eqNullSafe(F.col("a")))
    cut = joined.groupBy(session).agg(F.min(F.when(~F.col("same"), F.col("turn_no"))).alias("cut"))
    return joined.join(cut, session).where(F.col("cut").isNull() | (F.col("turn_no") < F.col("cut"))).select(*index.columns)


def line_ranges(found: DataFrame, turns: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with start_line and end_line of their turn; lines 1 and 2 where there is no such turn."""
    told = found.join(turns.select(*keys, "start_line", "end_line"), keys, "left")
    return told.withColumns({"start_line": F.coalesce("start_line", F.lit(1)), "end_line": F.coalesce("end_line", F.lit(2))})
