"""Event logs: counts, signatures, TTL and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def signature(events: DataFrame, by: str, ts: str) -> DataFrame:
    """Latest time and number of rows of each group."""
    return events.groupBy(by).agg(F.max(ts).alias("latest"), F.count("*").alias("n"))


def alive(events: DataFrame, ts: str, now: str, ttl_days: int) -> DataFrame:
    return events.where(F.col(ts) > F.timestamp_seconds(F.unix_timestamp(F.lit(now).cast("timestamp")) - ttl_days * 86400))


def sessions(events: DataFrame, user: str, ts: str, gap: str) -> DataFrame:
    """Gap-separated sessions of each user."""
    found = events.groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"))
    return found.select(user, "first_ts", "last_ts", "n")
