"""Chat sessions and settings on disk: listings, histories, imports, turn indexes, versions and the log of a pending cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions.rules import WHITE, archivable, enters_archive, file_name
from lodestone.operators.manifests import upsert
from lodestone.sources.artifacts import complete, folder
from lodestone.sources.files import append_turns, write_partitions
from lodestone.sources.walk import walk


def session_files(spark: SparkSession, root: str) -> DataFrame:
    """session, path, size, mtime of ``*.jsonl`` files, last name first; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(root)
    listed = files.select(file_name(F.col("path")).alias("session"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return listed.orderBy(F.desc("session"), F.desc("path"))


def turn_index(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """session, pos and the fields of ``schema`` of the entries of ``*.idx.json``; what is no object is dropped, and a file that is no list has no rows."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.idx.json").text(root)
    entries = F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>")
    rows = files.select(F.regexp_replace("_metadata.file_name", r"\.idx\.json$", "").alias("session"), F.posexplode(entries).alias("pos", "entry"))
    objects = rows.where(F.schema_of_variant("entry").startswith("OBJECT"))
    return objects.select("session", "pos", F.from_json(F.to_json("entry"), schema).alias("e")).select("session", "pos", "e.*")


def json_or(spark: SparkSession, path: str, schema: str, default: DataFrame) -> DataFrame:
    """Rows of a JSON document, ``default`` where there is none or it is malformed. For settings: Spark reads such a file in one task."""
    if not folder(spark, path).exists():
        return default
    read = spark.read.schema(f"{schema}, _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path).cache()
    ok = not read.isEmpty() and read.where("_bad is not null").isEmpty()
    return read.drop("_bad") if ok else default


def labelled_lines(spark: SparkSession, path: str) -> DataFrame:
    """text and label of JSON lines; a malformed line is an error, blank ones are skipped."""
    return spark.read.schema("text string, label int").option("mode", "FAILFAST").json(path)


def imported_chats(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """(session, pos, role, content) of whole ``.txt`` and ``.md`` files, each a turn of its own.

    A session is named by the file and eight digits of its digest, so files of
    equal names stay apart and sessions in ``known`` are skipped. Blank files
    have no rows; malformed bytes are left out.
    """
    name = file_name(F.col("path"))
    text = F.col("content").cast("string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.lower(name).rlike(r"\.(txt|md)$"))
    clean = F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit("")))
    session = F.concat(F.regexp_replace(name, r"\.[^.]+$", ""), F.lit("_"), F.substring(F.md5("content"), 1, 8), F.lit("_imported"))
    told = files.select(session.alias("session"), name.alias("name"), clean.alias("text")).where(F.btrim("text", F.lit(WHITE)) != "").dropDuplicates(["session"])
    if known is not None:
        told = told.join(known.select("session").distinct(), "session", "left_anti")
    said = F.concat(F.lit("[SYSTEM: imported chat — "), "name", F.lit("]"))
    two = F.array(
        F.struct(F.lit(0).alias("pos"), F.lit("user").alias("role"), said.alias("content")),
        F.struct(F.lit(1).alias("pos"), F.lit("assistant").alias("role"), F.col("text").alias("content")),
    )
    return told.select("session", F.inline(two))


def save_history(messages: DataFrame, root: str, mirror: str) -> None:
    """Replaces the sessions of the messages (session, pos, role, content) under ``root`` and appends their last two messages to ``mirror``."""
    write_partitions(messages, root, "session")
    back = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("pos")))
    append_turns(messages.withColumn("_back", back).where("_back <= 2").drop("_back"), mirror)


def history(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("pos int, role string, content string, session string").parquet(root)


def cut(ledger: DataFrame, log: str, turn: str, last: int) -> DataFrame:
    """The ledger up to the turn. What is cut off is written to ``log`` before, so a crash before the new ledger is saved loses nothing."""
    after = F.coalesce(F.col(turn) > last, F.lit(False))
    ledger.where(after).write.mode("overwrite").parquet(log)
    return ledger.where(~after)


def recovered(ledger: DataFrame, log: str, keys: list[str]) -> DataFrame:
    """The ledger with the rows of a complete log that it lacks."""
    spark = ledger.sparkSession
    if not complete(spark, log):
        return ledger
    return ledger.unionByName(spark.read.schema(ledger.schema).parquet(log).join(ledger, keys, "left_anti"))


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the versions whose write has ended."""
    at = folder(spark, root)
    names = [n for n in at.names() if n.startswith("version=")] if at.exists() else []
    return sorted(int(n.split("=")[1]) for n in names if complete(spark, f"{root}/{n}"))


def latest(spark: SparkSession, root: str) -> DataFrame | None:
    found = versions(spark, root)
    return spark.read.parquet(f"{root}/version={found[-1]}") if found else None


def _state(df: DataFrame) -> tuple:
    # sums, so that equal rows do not cancel out
    columns = sorted(df.columns)
    sums = [F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)")) for seed in (0, 1)]
    return tuple(df.agg(F.count("*"), *sums).first())


def save(df: DataFrame, root: str) -> bool:
    """Writes the next version unless the last one holds the same rows; readers see a version once it is whole. True if written."""
    spark = df.sparkSession
    last = latest(spark, root)
    if last is not None and sorted(last.dtypes) == sorted(df.dtypes) and _state(last) == _state(df):
        return False
    # a write that failed leaves a folder without its mark: replaced, never read
    df.write.mode("overwrite").parquet(f"{root}/version={max(versions(spark, root), default=0) + 1}")
    return True


def snapshot(spark: SparkSession, source: str, root: str) -> bool:
    """Saves the files under ``source`` that belong in an archive (path, size, content) as the next version.

    A folder in which there is nothing is a row whose path ends in a slash, without size and content.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source)
    kept = files.where(archivable(F.col("path"), F.col("length"))).select("path", F.col("length").alias("size"), "content")
    found = walk(spark, [source], enters_archive)
    empty = found.where("is_folder").select("path").join(found.select(F.col("folder").alias("path")).distinct(), "path", "left_anti")
    rows = empty.select(F.concat("path", F.lit("/")).alias("path"), F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("binary").alias("content"))
    return save(kept.unionByName(rows), root)


def cache_stream(updates: DataFrame, root: str, key: str, at: str, checkpoint: str, every: str | None = "300 seconds") -> StreamingQuery:
    """Keeps the newest row of each key (by ``at``) as versions numbered by batch, one each ``every``.

    A batch that is run again writes the same version again. Without ``every``
    what is there is saved and the query ends, as at a program's exit.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = F.max_by(F.struct(*batch.columns), F.struct(F.col(at).isNotNull(), at))
        rows = batch.groupBy(F.col(key).alias("_key")).agg(newest.alias("_row")).select("_row.*")
        earlier = [v for v in versions(spark, root) if v < number]
        if earlier:
            rows = upsert(spark.read.schema(rows.schema).parquet(f"{root}/version={earlier[-1]}"), rows, key)
        rows.write.mode("overwrite").parquet(f"{root}/version={number}")

    writer = updates.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
