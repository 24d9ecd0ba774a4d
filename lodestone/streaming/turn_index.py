"""An index of conversation turns that follows a stream of messages, edits and cuts."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.sources.artifacts import written
from lodestone.sources.commits import Log

CUT = "cut"
#: Parts of the tables; one more merges them.
PARTS = 16
_TURN = ("session", "turn_no", "user_text", "assistant_text", "user_pos", "assistant_pos")


def _union(log: Log, names: list[str]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, [log.table(n).withColumn("part", F.lit(i)) for i, n in enumerate(names)])


def _standing(rows: DataFrame, cuts: DataFrame, place: str) -> DataFrame:
    """Rows that no later part has cut off: none with a cut at or before their place."""
    first = cuts.groupBy("session", F.col("part").alias("cut_part")).agg(F.min("at").alias("at"))
    marked = rows.withColumn("_row", F.struct("session", place, "part"))
    off = marked.join(first, "session").where((F.col("cut_part") > F.col("part")) & (F.col("at") <= F.col(place)))
    return marked.join(off.select("_row").distinct(), "_row", "left_anti").drop("_row")


def _messages(log: Log, names: list[str], sessions: DataFrame | None = None) -> DataFrame:
    """session, pos, role, content, part: the last message of each place that is not cut off."""
    rows = _union(log, names)
    rows = rows if sessions is None else rows.join(sessions, "session", "left_semi")
    newest = rows.where(F.col("role") != CUT).groupBy("session", "pos").agg(F.max_by(F.struct("role", "content", "part"), "part").alias("m")).select("session", "pos", "m.*")
    return _standing(newest, rows.where(F.col("role") == CUT).select("session", F.col("pos").alias("at"), "part"), "pos")


def turns(log: Log, commit: dict) -> DataFrame:
    """session, turn_no, user_text, assistant_text and their places, with what the embedding added."""
    return _standing(_union(log, commit["index"]), _union(log, commit["cuts"]), "turn_no").drop("part")


def _pairs(messages: DataFrame, start: Column) -> DataFrame:
    """Turns as ``operators.turns.pairs`` tells them, numbered from ``start``; ``fresh`` tells messages from the one before them."""
    by = Window.partitionBy("session").orderBy("pos")
    seen = messages.withColumns({"_role": F.lag("role").over(by), "user_text": F.lag("content").over(by), "user_pos": F.lag("pos").over(by)})
    found = seen.where((F.col("role") == "assistant") & (F.col("_role") == "user") & F.col("fresh"))
    return found.select("session", (start + F.row_number().over(by)).cast("int").alias("turn_no"), "user_text", F.col("content").alias("assistant_text"), "user_pos", F.col("pos").alias("assistant_pos"))


def index_batch(batch: DataFrame, number: int, root: str, embed: Callable[[DataFrame], DataFrame] | None = None) -> bool:
    """Takes a batch of messages (session, pos, role, content) into the index under ``root``; False if it was taken before.

    A message of a place that has one replaces it; a row with the role ``cut``
    ends a session before its place, and messages of the same batch come after
    it. Of each session the turns before the first message that is new or
    differs stay as they are; only later ones are paired, embedded (``embed``
    adds columns) and written. Tables and the number of the batch become visible
    in one commit, so a batch that is run again changes nothing.
    """
    spark = batch.sparkSession
    log = Log(spark, root)
    version, was = log.last()
    if was and was["batch"] >= number:
        return False
    rows = batch.select("session", "pos", "role", "content").where("session is not null and pos is not null")
    name = log.put(rows.groupBy("session", "pos", (F.col("role") == CUT).alias("_cut")).agg(F.max(F.struct("role", "content")).alias("m")).select("session", "pos", "m.*"), "messages")
    new = log.table(name)
    touched = written(new.select("session").distinct(), "sessions")
    said = F.col("role").isin("user", "assistant")
    if was:
        had = _messages(log, was["messages"], touched)
        old = written(had.where(said), "old")
        kept = written(turns(log, was).join(touched, "session", "left_semi"), "kept")
    else:
        old, kept = None, None
    news = new.where(F.col("role") != CUT)
    cuts = new.where(F.col("role") == CUT).select("session", F.col("pos").alias("at"))
    if old is not None:
        same = news.join(old.select("session", "pos", "role", "content"), ["session", "pos", "role", "content"], "left_semi")
        # a message that is cut off and said again is new
        same = same.join(cuts, "session", "left").where("at is null or pos < at").select("session", "pos")
        differs = news.join(same, ["session", "pos"], "left_anti")
    else:
        differs = news
    first = differs.select("session", "pos").unionByName(cuts.withColumnRenamed("at", "pos")).groupBy("session").agg(F.min("pos").alias("first"))
    first = written(first, "first")
    names = [*was.get("messages", []), name]
    live = _messages(log, names, touched).where(said).join(first, "session").withColumn("fresh", F.col("pos") >= F.col("first"))
    back = live.where(~F.col("fresh")).groupBy("session").agg(F.max("pos").alias("_last"))
    near = live.join(back, "session", "left").where("fresh or pos = _last")
    if kept is not None:
        count = kept.join(first, "session").where("assistant_pos < first").groupBy("session").agg(F.max("turn_no").alias("done"))
        near = near.join(count, "session", "left")
    else:
        near = near.withColumn("done", F.lit(0))
    found = written(_pairs(near, F.coalesce("done", F.lit(0))), "turns")
    told = embed(found) if embed else found
    ends = near.groupBy("session").agg(F.max("done").alias("done"))
    off = first.join(ends, "session", "left").select("session", (F.coalesce("done", F.lit(0)) + 1).cast("int").alias("at"))
    if kept is not None:  # a session may have lost all its messages
        off = off.join(count.withColumnRenamed("done", "_done"), "session", "left").select("session", F.greatest("at", F.coalesce("_done", F.lit(0)) + 1).cast("int").alias("at"))
    commit = {"batch": number, "messages": names, "index": [*was.get("index", []), log.put(told, "index")], "cuts": [*was.get("cuts", []), log.put(off, "cuts")], "added": found.count()}
    log.commit(version, _merged(log, commit) if len(names) > PARTS else commit)
    return True


def _merged(log: Log, commit: dict) -> dict:
    """The same index in one part."""
    messages = log.put(_messages(log, commit["messages"]).drop("part"), "messages")
    none = _union(log, commit["cuts"]).where(F.lit(False)).drop("part")
    return commit | {"messages": [messages], "index": [log.put(turns(log, commit), "index")], "cuts": [log.put(none, "cuts")]}


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The turns of the last commit."""
    log = Log(spark, root)
    _, commit = log.last()
    return turns(log, commit) if commit else None


def turn_index_stream(messages: DataFrame, root: str, checkpoint: str, embed: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Keeps the index under ``root`` up with a stream of messages; takes what is there, then ends."""
    return messages.writeStream.foreachBatch(lambda batch, number: index_batch(batch, number, root, embed) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
