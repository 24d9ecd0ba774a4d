"""Turn states: a ledger of turns, snapshots of files per turn, and archives that later turns leave behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.rules import archivable, size_text
from lodestone.operators.manifests import renumbered, retained, upsert


def committed(ledger: DataFrame, rows: DataFrame, key: list[str] | str) -> DataFrame:
    """The ledger with the rows in the place of those of the same turn."""
    keys = [key] if isinstance(key, str) else key
    if len(keys) == 1:
        return upsert(ledger, rows, keys[0])
    return ledger.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def pruned(archives: DataFrame, turn: str, session: str, keep: int) -> DataFrame:
    """Archives of the last ``keep`` turns of a session."""
    return retained(archives, turn, session, keep)


def timeline(ledger: DataFrame, archives: DataFrame, keys: list[str]) -> DataFrame:
    """The ledger with ``archived``: a snapshot of the turn exists."""
    held = archives.select(*keys).distinct().withColumn("_held", F.lit(True))
    return ledger.join(held, keys, "left").withColumn("archived", F.coalesce("_held", F.lit(False))).drop("_held")


def orphans(archives: DataFrame, ledger: DataFrame, session: str, turn: str) -> DataFrame:
    """Archives of turns after the last one that the session's ledger knows; all where it knows none."""
    last = ledger.groupBy(session).agg(F.max(turn).alias("_last"))
    return archives.join(last, session, "left").where(F.col("_last").isNull() | (F.col(turn) > F.col("_last"))).drop("_last")


def without_turn(ledger: DataFrame, archives: DataFrame, turn: str, reference: str, deleted: int) -> tuple[DataFrame, DataFrame]:
    """Ledger and archives after a turn is deleted: its rows and archives go, later ones move up by one."""
    left = archives.where(F.col(turn) != deleted).withColumn(turn, F.col(turn) - (F.col(turn) > deleted).cast("int"))
    return renumbered(ledger, turn, reference, deleted), left


def back_to(ledger: DataFrame, archives: DataFrame, turn: str, wanted: int) -> DataFrame:
    """The ledger up to the turn; unchanged where no snapshot of that turn exists."""
    exists = archives.agg(F.coalesce(F.bool_or(F.col(turn) == wanted), F.lit(False)).alias("_exists"))
    return ledger.crossJoin(F.broadcast(exists)).where(~F.col("_exists") | (F.col(turn) <= wanted)).drop("_exists")


def archive_sizes(files: DataFrame, by: str, path: str = "path", size: str = "size") -> DataFrame:
    """Files and megabytes that go into each archive."""
    return (
        files.where(archivable(F.col(path), F.col(size))).groupBy(by)
        .agg(F.count("*").alias("files"), F.round(F.sum(size) / (1024 * 1024), 6).alias("mb"))
    )


def flattened(ledger: DataFrame, *names: str) -> DataFrame:
    """One row for each file that a turn's lists name, with the list's name; turns without files have none."""
    keys = [c for c in ledger.columns if c not in names]

    def tagged(name: str) -> Column:
        return F.transform(F.coalesce(F.col(name), F.expr("cast(array() as array<string>)")), lambda f: F.struct(F.lit(name).alias("list"), f.alias("file")))

    return ledger.select(*keys, F.inline(F.flatten(F.array(*map(tagged, names)))))


def gathered(rows: DataFrame, ranks: DataFrame, on: str, rank: str) -> DataFrame:
    """Rows in the order of their ranks, joined by index and never by position in the frame."""
    return ranks.join(rows, on).orderBy(rank, on)


def recent(files: DataFrame, changed: Column, key: str, n: int = 5) -> DataFrame:
    return files.orderBy(changed.desc(), key).limit(n)


def listing(files: DataFrame, artifacts: DataFrame, key: str, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """Files with whole kilobytes, their size as text, and ``ingested``: artifacts of the file exist. With ``extensions``, only files of these."""
    held = artifacts.select(key).distinct().withColumn("_held", F.lit(True))
    kb = F.floor(F.col("size") / 1024).alias("kb")
    if extensions is not None:
        files = files.where(F.lower(F.regexp_extract(key, r"(\.[^./]+)$", 1)).isin(*extensions))
    return files.join(held, key, "left").select(key, kb, size_text(F.col("size")).alias("size_text"), F.coalesce("_held", F.lit(False)).alias("ingested"))
