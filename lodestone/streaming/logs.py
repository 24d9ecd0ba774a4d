"""Streams: sessions with late data, and pairing of turns whose halves arrive in different batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def session_stream(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Closed sessions in append mode; rows later than the watermark are left out."""
    return events.withWatermark(ts, late).groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(user, "w.start", "w.end", "n")


def pair_stream(messages: DataFrame) -> DataFrame:
    """(session, user_text, assistant_text) from rows (session, pos, role, content); a later user message replaces a pending one."""

    def pair(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending = state.get[0] if state.exists else None
        out = []
        for row in pd.concat(list(frames)).sort_values("pos").itertuples():
            if row.role == "user":
                pending = row.content
            elif row.role == "assistant" and pending is not None:
                out.append((key[0], pending, row.content))
                pending = None
        state.update((pending,))
        yield pd.DataFrame(out, columns=["session", "user_text", "assistant_text"])

    return messages.groupBy("session").applyInPandasWithState(
        pair, "session string, user_text string, assistant_text string", "pending string", "append", GroupStateTimeout.NoTimeout
    )


def append_index(batch: DataFrame, number: int, path: str) -> None:
    """foreachBatch sink of an append-only index: a batch that is run again replaces what it wrote before."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def first_seen(events: DataFrame, keys: list[str], ts: str, ttl: str) -> DataFrame:
    """The stream without rows whose keys came before within ``ttl``; rows later than that may be left out. State older than it is dropped."""
    return events.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(keys)
