"""State of files and folders from a log of their changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WRITE, REMOVE, MAKE, CLEAR = "write", "remove", "make_folder", "remove_folder"


def folders_of(path: Column) -> Column:
    """The folders that hold the path, outermost first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def _inside(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), folders_of(path)).otherwise(F.expr("cast(array() as array<string>)"))


def state(log: DataFrame, seq: str = "seq", op: str = "op", path: str = "path") -> DataFrame:
    """kind (file or folder), path and since: what exists after the log, and the entry that made it last.

    A write makes the file and the folders that hold it, ``make_folder`` the
    folder and those above; ``remove`` takes a file, ``remove_folder`` a folder
    and all that lies under it then. Sequence numbers are distinct, the log may
    come in any order. A removal of a folder is kept once, as a tombstone of the
    prefix, and meets the paths below by their prefixes.
    """
    log = log.select(F.col(seq).alias("seq"), F.col(op).alias("op"), F.col(path).alias("path")).where("path is not null and path != ''")
    makes = log.where(F.col("op").isin(WRITE, MAKE))
    kind = F.when(F.col("op") == WRITE, "file").otherwise("folder")
    above = makes.select("seq", F.lit("folder").alias("kind"), F.explode(_inside(F.col("path"))).alias("path"))
    made = makes.select("seq", kind.alias("kind"), "path").unionByName(above).groupBy("kind", "path").agg(F.max("seq").alias("since"))
    removed = log.where(F.col("op") == REMOVE).groupBy("path").agg(F.max("seq").alias("gone")).withColumn("kind", F.lit("file"))
    cleared = log.where(F.col("op") == CLEAR).groupBy(F.col("path").alias("folder")).agg(F.max("seq").alias("cleared"))
    reach = F.when(F.col("kind") == "folder", F.concat(_inside(F.col("path")), F.array("path"))).otherwise(_inside(F.col("path")))
    under = made.select("kind", "path", F.explode(reach).alias("folder")).join(cleared, "folder").groupBy("kind", "path").agg(F.max("cleared").alias("cleared"))
    told = made.join(removed, ["kind", "path"], "left").join(under, ["kind", "path"], "left")
    return told.where((F.col("gone").isNull() | (F.col("since") > F.col("gone"))) & (F.col("cleared").isNull() | (F.col("since") > F.col("cleared")))).select("kind", "path", "since")
