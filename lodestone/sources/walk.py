"""Walks of folders level by level, spread over tasks, that never enter an excluded folder."""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.rules import TEMPORARY, any_glob
from lodestone.sources.artifacts import written
from lodestone.sources.files import PRUNED, PRUNED_SUFFIX, SIDECARS

_ENTRY = "folder string, path string, name string, is_folder boolean, size bigint, mtime double"
#: Bytes of a file that are read at a time.
BLOCK = 1 << 20


def _local(uri: str) -> str | None:
    parts = urlsplit(uri)
    return uri if not parts.scheme else unquote(parts.path) if parts.scheme == "file" else None


def _entries(folder: str) -> Iterator[tuple]:
    """Entries of a folder; one that cannot be read has none, links to folders are not followed."""
    at = _local(folder)
    try:
        if at is not None:
            with os.scandir(at) as found:
                for e in found:
                    if e.is_symlink() and e.is_dir():
                        continue
                    state = e.stat()
                    yield folder, f"{folder.rstrip('/')}/{e.name}", e.name, e.is_dir(), state.st_size, state.st_mtime
        else:
            fs, inner = pafs.FileSystem.from_uri(folder)
            for e in fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True)):
                yield folder, f"{folder.rstrip('/')}/{e.base_name}", e.base_name, e.type == pafs.FileType.Directory, e.size, e.mtime_ns / 1e9 if e.mtime_ns else None
    except OSError:
        return


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            rows = list(_entries(folder))
            columns = zip(*rows, strict=True) if rows else [()] * 6
            kinds = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["folder", "path", "name", "is_folder", "size", "mtime"])


def walk(spark: SparkSession, roots: list[str], enters: Callable[[Column], Column], on_level: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """folder, path, name, is_folder, size and mtime of what lies under the roots; a folder whose name ``enters`` denies is not listed, nor in the result.

    A level is one job over the folders of the level before; each level is
    written, so the next one's lineage is short. ``on_level`` gets the folders
    that a level lists.
    """
    at = spark.createDataFrame([(r.rstrip("/") or "/",) for r in dict.fromkeys(roots)], "folder string")
    levels = []
    while not at.isEmpty():
        if on_level:
            on_level(at)
        spread = at.repartition(max(1, min(4 * spark.sparkContext.defaultParallelism, at.count())))
        found = written(spread.mapInArrow(_listed, _ENTRY).where(~F.col("is_folder") | enters(F.col("name"))), "level")
        levels.append(found)
        at = found.where("is_folder").select(F.col("path").alias("folder")).distinct()
    none = spark.createDataFrame([], _ENTRY)
    return functools.reduce(DataFrame.unionByName, levels, none)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """md5 of each file, read in blocks; null for one that cannot be read."""
    for batch in batches:
        digests = []
        for path in batch.column(0).to_pylist():
            at, digest = _local(path), hashlib.md5()
            try:
                if at is not None:
                    source = open(at, "rb")  # noqa: SIM115
                else:
                    fs, inner = pafs.FileSystem.from_uri(path)
                    source = fs.open_input_stream(inner)
                with source:
                    while block := source.read(BLOCK):
                        digest.update(block)
                digests.append(digest.hexdigest())
            except OSError:
                digests.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string())], names=["path", "digest"])


def digests(files: DataFrame) -> DataFrame:
    """path and md5 of the files, spread over tasks."""
    paths = files.select("path")
    return paths.repartition(max(1, min(4 * files.sparkSession.sparkContext.defaultParallelism, paths.count()))).mapInArrow(_hashed, "path string, digest string")


def source_files(spark: SparkSession, roots: list[str], extensions: tuple[str, ...]) -> DataFrame:
    """path, digest, size and mtime of files that may be indexed; of equal contents the first by root, then path."""
    from lodestone.sources.files import eligible

    enters = lambda name: ~(name.isin(*PRUNED) | name.endswith(PRUNED_SUFFIX))
    files = walk(spark, roots, enters).where(~F.col("is_folder"))
    kept = written(eligible(files, extensions), "eligible")
    order = F.coalesce(*[F.when(F.col("path").startswith(r.rstrip("/") + "/"), F.lit(i)) for i, r in enumerate(roots)])
    told = kept.join(digests(kept), "path").where("digest is not null").select("path", "digest", "size", "mtime", order.alias("_root"))
    first = told.groupBy("digest").agg(F.min_by(F.struct("path", "size", "mtime"), F.struct("_root", "path")).alias("f"))
    return first.select("f.path", "digest", "f.size", "f.mtime")


def registry(spark: SparkSession, root: str, extensions: tuple[str, ...], excluded: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(path, size, mtime of tracked files; path of folders), relative to the root.

    Hidden folders and those of the ``excluded`` globs are not entered; temporary
    scripts, sidecars and files of other extensions are not tracked.
    """
    base = root.rstrip("/") + "/"
    found = written(walk(spark, [root], lambda name: ~(name.startswith(".") | any_glob(name, excluded))).withColumn("path", F.expr(f"substring(path, {len(base) + 1})")), "walked")
    side = F.lit(False)
    for suffix in SIDECARS:
        side |= F.col("name").endswith(suffix)
    extension = F.lower(F.regexp_extract("name", r"[^.](\.[^.]*)$", 1))
    files = found.where(~F.col("is_folder") & extension.isin(*extensions) & ~F.col("name").rlike(TEMPORARY) & ~side)
    return files.select("path", "size", "mtime"), found.where("is_folder").select("path")
