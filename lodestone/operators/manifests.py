"""Registries and ledgers: differences, upserts, retention and renumbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def registry_diff(registry: DataFrame, disk: DataFrame, key: str) -> DataFrame:
    """key, status. A file is modified when its mtime grew by more than 0.5 s or else its size differs."""
    r = registry.select(key, F.col("mtime").alias("r_mtime"), F.col("size").alias("r_size"))
    d = disk.select(key, F.col("mtime").alias("d_mtime"), F.col("size").alias("d_size"))
    status = (
        F.when(F.col("r_mtime").isNull(), "added").when(F.col("d_mtime").isNull(), "removed")
        .when(F.col("d_mtime") > F.col("r_mtime") + 0.5, "modified").when(F.col("d_size") != F.col("r_size"), "modified").otherwise("unchanged")
    )
    return r.join(d, key, "full_outer").select(key, status.alias("status"))


def manifest_diff(manifest: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """key, action: delete what is gone, build what is new or has another digest."""
    gone = manifest.join(current, key, "left_anti").select(key, F.lit("delete").alias("action"))
    old = manifest.select(key, F.col(digest).alias("_old"))
    build = current.join(old, key, "left").where(~F.col(digest).eqNullSafe(F.col("_old"))).select(key, F.lit("build").alias("action"))
    return gone.unionByName(build)


def upsert(ledger: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows replace ledger rows of the same key."""
    return ledger.join(rows.select(key), key, "left_anti").unionByName(rows)


def retained(ledger: DataFrame, key: str, session: str, keep: int) -> DataFrame:
    """Rows whose number lies within ``keep`` of the session's current one: a range of values, not a count of rows."""
    now = ledger.groupBy(session).agg(F.max(key).alias("_now"))
    return ledger.join(now, session).where(F.col(key) > F.col("_now") - keep).drop("_now")


def renumbered(ledger: DataFrame, key: str, reference: str, deleted: int) -> DataFrame:
    """The ledger without turn ``deleted``; later turns and references to them move up, references to it go."""
    ref = F.col(reference)
    moved = F.when(ref == deleted, None).when(ref > deleted, ref - 1).otherwise(ref)
    return ledger.where(F.col(key) != deleted).withColumn(reference, moved).withColumn(key, F.col(key) - (F.col(key) > deleted).cast("int"))


def restored(ledger: DataFrame, key: str, turn: int) -> DataFrame:
    return ledger.where(F.col(key) <= turn)


def index_commit(old: DataFrame, changed: DataFrame, file: str) -> DataFrame:
    """Chunks of an incremental build: a changed file's rows are replaced, all or nothing.

    A file with a failed chunk that is not oversize keeps no rows, so it is built again.
    """
    bad = changed.groupBy(file).agg(F.bool_or(F.col("vector").isNull() & ~F.col("oversize")).alias("_failed"))
    kept = changed.join(bad.where(~F.col("_failed")), file, "left_semi").where(F.col("vector").isNotNull())
    return old.join(bad, file, "left_anti").unionByName(kept.select(*old.columns))


def nearest(rows: DataFrame, key: str, wanted: int) -> DataFrame:
    """The row whose key is nearest; the smaller of two."""
    return rows.orderBy(F.abs(F.col(key) - wanted), key).limit(1)


def greedy_budget(parts: DataFrame, group: str, order: list, size: str, budget: int | Column, least: int) -> DataFrame:
    """Parts in order until the budget is full; the one that overflows is cut if over ``least`` is left, then stop.

    For groups that one task can sort; others come with ``ordered.running_total`` and go to ``within_budget``.
    """
    upto = F.sum(size).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return within_budget(parts.withColumn("upto", upto), size, budget, least)


def within_budget(totals: DataFrame, size: str, budget: int | Column, least: int) -> DataFrame:
    """The part of ``greedy_budget`` after running totals (``upto``)."""
    taken = totals.withColumn("room", F.lit(budget) - (F.col("upto") - F.col(size)))
    kept = F.when(F.col("upto") <= budget, F.col(size)).when(F.col("room") > least, F.col("room"))
    return taken.withColumn("taken", kept).where(F.col("taken").isNotNull()).drop("upto", "room")


def sidecars(files: DataFrame, sources: DataFrame, suffix: str, path: str = "path", source: str = "source") -> DataFrame:
    """path, source and state of sidecar files: ``found``, ``orphan`` (its source is gone) or ``unknown``.

    ``sources`` tells the source that a sidecar names; where it names none, that
    is a text file of the sidecar's stem, whose absence proves nothing.
    """
    side = files.where(F.col(path).endswith(suffix)).select(path, F.expr(f"left(`{path}`, length(`{path}`) - {len(suffix)})").alias("_stem"))
    named = side.join(sources.select(path, source), path, "left").withColumn("_at", F.coalesce(source, F.concat("_stem", F.lit(".txt"))))
    held = files.select(F.col(path).alias("_at")).distinct().withColumn("_held", F.lit(True))
    state = F.when(F.col("_held"), "found").when(F.col(source).isNull(), "unknown").otherwise("orphan")
    return named.join(held, "_at", "left").select(path, source, state.alias("state"))
