"""File scans and sinks through Spark's readers and writers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.rules import inside

MESSAGE = "role string, content string"


def walk(spark: SparkSession, roots: list[str], glob: str = "*", excluded: tuple[str, ...] = ("node_modules", "__pycache__", ".git")) -> DataFrame:
    """path, digest, size, mtime of files under the roots; of equal contents the first by root, then path."""
    parts = [spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(r).withColumn("root", F.lit(i)) for i, r in enumerate(roots)]
    files = parts[0]
    for p in parts[1:]:
        files = files.unionByName(p)
    for name in excluded:
        files = files.where(~F.col("path").contains(f"/{name}/"))
    listed = files.select("root", "path", F.md5("content").alias("digest"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    first = listed.groupBy("digest").agg(F.min_by(F.struct("path", "size", "mtime"), F.struct("root", "path")).alias("f"))
    return first.select("f.path", "digest", "f.size", "f.mtime")


def text_lines(spark: SparkSession, path: str, roots: list[str] | None = None) -> DataFrame:
    """path, line_no, line of whole text files; with ``roots``, of files that lie under one of them, and of no others."""
    whole = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    if roots is not None:
        bare = lambda p: F.regexp_replace(p, "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")
        held = F.lit(False)
        for root in roots:
            held |= inside(bare(F.col("path")), re.sub("^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", root))
        whole = whole.where(held)
    return whole.select("path", F.posexplode(F.split("value", "\n")).alias("p", "line")).select("path", (F.col("p") + 1).alias("line_no"), "line")


def chat_lines(spark: SparkSession, path: str) -> DataFrame:
    """session, pos, role, content of JSONL chats; blank and malformed lines are skipped, content blocks joined by line breaks."""
    raw = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("session"), F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    plain = F.get_json_object("line", "$.content")
    blocks = F.from_json(plain, "array<struct<type:string,text:string>>")
    flat = F.when(plain.startswith("["), F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")).otherwise(plain)
    told = raw.withColumn("role", F.get_json_object("line", "$.role")).withColumn("content", flat)
    return told.where(F.col("role").isNotNull() & F.col("content").isNotNull()).select("session", "pos", "role", "content")


def append_turns(turns: DataFrame, path: str) -> None:
    turns.write.mode("append").json(path)


def commit_version(df: DataFrame, root: str, version: int) -> DataFrame:
    """Writes a version directory; a version exists once its files do (readers list versions, so a failed write is never read)."""
    df.write.mode("errorifexists").parquet(f"{root}/version={version}")
    return df.sparkSession.read.parquet(f"{root}/version={version}")


def read_version(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{root}/version={version}")


def write_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replaces only the partitions that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


# Files that are never indexed, directories that are pruned, and suffixes of index sidecars.
NEVER = (".env", ".gitignore")
PRUNED = (
    ".git", "__pycache__", "node_modules", ".venv", "venv",
    "target", "build", "dist", "env", ".mypy_cache", ".pytest_cache",
    ".ruff_cache", ".tox", ".eggs",
)
PRUNED_SUFFIX = ".egg-info"
SIDECARS = (".chunks.json", ".embed.json")


def eligible(files: DataFrame, extensions: tuple[str, ...], path: str = "path") -> DataFrame:
    """Rows whose file may be indexed: no secrets, keys, sidecars or pruned directories, a known extension,
    and no text file that has a sidecar of its own."""
    name = F.element_at(F.split(path, "/"), -1)
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    bad = name.isin(*NEVER) | name.endswith(".key")
    for suffix in SIDECARS:
        bad |= name.endswith(suffix)
    known = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).isin(*extensions)
    pruned = F.exists(folders, lambda d: d.isin(*PRUNED) | d.endswith(PRUNED_SUFFIX))
    kept = files.where(~bad & known & ~pruned)
    stems = files.where(F.col(path).endswith(SIDECARS[0])).select(F.expr(f"left(`{path}`, length(`{path}`) - {len(SIDECARS[0])})").alias("_stem"))
    text_stem = F.when(F.lower(name).endswith(".txt"), F.regexp_replace(path, r"\.[^./]*$", ""))
    return kept.join(stems.distinct(), text_stem == F.col("_stem"), "left_anti")
