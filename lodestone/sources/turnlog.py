"""Turns of a session with their files and messages: committed, pruned and restored in one step each."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.commits import Log

#: Parts of a table; one more merges them.
PARTS = 8
_FILE = "turn int, path string, digest string, size bigint, content binary, gone boolean"


def _parts(log: Log, names: list[str]) -> DataFrame:
    rows = [log.table(n).withColumn("_part", F.lit(i)) for i, n in enumerate(names)]
    return functools.reduce(DataFrame.unionByName, rows)


def ledger(log: Log, commit: dict) -> DataFrame:
    """The last entry of each turn."""
    rows = _parts(log, commit["ledger"])
    return rows.join(rows.groupBy("turn").agg(F.max("_part").alias("_part")), ["turn", "_part"], "left_semi").drop("_part")


def history(log: Log, commit: dict) -> DataFrame:
    """pos, role, content of the messages, the last one of each place."""
    rows = _parts(log, commit["history"])
    return rows.join(rows.groupBy("pos").agg(F.max("_part").alias("_part")), ["pos", "_part"], "left_semi").drop("_part")


def _versions_at(log: Log, commit: dict, turn: int | None) -> DataFrame:
    """The last version of each path at or before the turn, removals included."""
    rows = _parts(log, commit["files"])
    rows = rows if turn is None else rows.where(F.col("turn") <= turn)
    # contents stay out of the grouping
    last = rows.groupBy("path").agg(F.max(F.struct("turn", "_part")).alias("l")).select("path", "l.*")
    return rows.join(last, ["path", "turn", "_part"], "left_semi").drop("_part")


def files_at(log: Log, commit: dict, turn: int | None = None) -> DataFrame:
    """path, digest, size, content of the files as they were at the end of the turn, or of the last one."""
    return _versions_at(log, commit, turn).where(~F.col("gone")).select("path", "digest", "size", "content")


def _pruned(log: Log, commit: dict) -> dict:
    """The commit with its parts merged, and versions that no restorable turn shows left out."""
    oldest = commit["oldest"]
    base = _versions_at(log, commit, oldest).where(~F.col("gone")).withColumn("turn", F.lit(oldest))
    later = _parts(log, commit["files"]).where(F.col("turn") > oldest).drop("_part")
    merged = {"files": [log.put(base.unionByName(later), "files")], "ledger": [log.put(ledger(log, commit), "ledger")], "history": [log.put(history(log, commit), "history")]}
    return commit | merged


def commit_turn(spark: SparkSession, root: str, turn: int, entry: DataFrame, files: DataFrame, messages: DataFrame, keep: int) -> int:
    """Publishes a turn: its ledger entry, what changed in the files (path, content) and its messages (pos, role, content).

    All become visible together, with the pruning of turns ``keep`` or more
    behind, which stay in the ledger but cannot be restored. A turn that is
    committed again replaces its entry and messages. ``Conflict`` if another
    writer has published meanwhile; nothing is changed then.
    """
    log = Log(spark, root)
    version, was = log.last()
    now = files.select("path", F.sha2("content", 256).alias("digest"), F.length("content").cast("bigint").alias("size"), "content")
    if was:
        had = files_at(log, was).select("path", "digest")
        changed = now.join(had, ["path", "digest"], "left_anti")
        gone = had.join(now.select("path"), "path", "left_anti")
    else:
        changed, gone = now, now.where(F.lit(False))
    row = lambda df, is_gone, *rest: df.select(F.lit(turn).cast("int").alias("turn"), "path", *rest, F.lit(is_gone).alias("gone"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("size", "bigint"), ("content", "binary"))]
    versions = row(changed, False, "digest", "size", "content").unionByName(row(gone, True, F.lit(None).cast("string").alias("digest"), *none))
    commit = {
        "files": [*was.get("files", []), log.put(versions, "files")],
        "ledger": [*was.get("ledger", []), log.put(entry.withColumn("turn", F.lit(turn).cast("int")), "ledger")],
        "history": [*was.get("history", []), log.put(messages.select("pos", "role", "content"), "history")],
        "turn": turn, "oldest": max(was.get("oldest", turn), turn - keep + 1),
    }
    return log.commit(version, _pruned(log, commit) if len(commit["files"]) > PARTS else commit)


def replace_turn(spark: SparkSession, root: str, turn: int, entry: DataFrame, messages: DataFrame, keep_tail: bool = False) -> int:
    """Publishes another answer to a turn, or another text of it, in the place of its messages.

    A rerun drops the turns after it and their files, as they answer what is no
    longer said; an edit in place (``keep_tail``) leaves them attached. The old
    state is the version before, so nothing is lost if the caller fails.
    """
    log = Log(spark, root)
    version, was = log.last()
    if not was or not ledger(log, was).where(F.col("turn") == turn).count():
        raise ValueError(f"there is no turn {turn}")
    if not keep_tail and turn < was["oldest"]:
        raise ValueError(f"turn {turn} cannot be run again: the files of turns before {was['oldest']} are gone")
    kept = was if keep_tail else _cut(log, was, turn)
    said = log.put(messages.select("pos", "role", "content"), "history")
    told = log.put(entry.withColumn("turn", F.lit(turn).cast("int")), "ledger")
    return log.commit(version, kept | {"ledger": [*kept["ledger"], told], "history": [*kept["history"], said]})


def restore_turn(spark: SparkSession, root: str, turn: int) -> int:
    """Publishes the state at the end of the turn: its files, the ledger up to it and the first two messages a turn."""
    log = Log(spark, root)
    version, was = log.last()
    known = was and ledger(log, was).where(F.col("turn") == turn).count()
    if not known or turn < was["oldest"]:
        held = f"turns {was['oldest']} to {was['turn']} can be restored" if was else "there is none"
        raise ValueError(f"turn {turn} cannot be restored: {held}")
    return log.commit(version, _cut(log, was, turn))


def _cut(log: Log, was: dict, turn: int) -> dict:
    """What ``was`` holds up to the end of the turn."""
    files = _parts(log, was["files"]).where(F.col("turn") <= turn).join(_last_parts(log, was, turn), ["path", "turn", "_part"], "left_semi").drop("_part")
    tables = {"files": files, "ledger": ledger(log, was).where(F.col("turn") <= turn), "history": history(log, was).where(F.col("pos") < 2 * turn)}
    return {name: [log.put(df, name)] for name, df in tables.items()} | {"turn": turn, "oldest": was["oldest"]}


def _last_parts(log: Log, commit: dict, turn: int) -> DataFrame:
    """path, turn and part of the versions up to the turn that count, one for each path and turn."""
    return _parts(log, commit["files"]).where(F.col("turn") <= turn).groupBy("path", "turn").agg(F.max("_part").alias("_part"))
