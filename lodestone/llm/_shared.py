"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN: dict[str, str] = {}


#: Arrow batches of Python workers, where the session leaves them open: long texts would make batches of any size.
BATCH_BYTES = "4m"
#: Tables of up to this many narrow rows (about 40 bytes each) are broadcast.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a folder of our own in local mode and an error on a cluster."""
    for conf in (spark.conf, spark.sparkContext.getConf()):
        found = conf.get("spark.checkpoint.dir", None)
        if found:
            return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-shared-")
    return _OWN[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(rows: DataFrame, size: str = "count(*)") -> DataFrame:
    """The rows of a written table, to be broadcast if they are few; ``size`` counts those of wider rows."""
    return F.broadcast(rows) if (rows.agg(F.expr(size)).first()[0] or 0) <= BROADCAST_ROWS else rows


def discard(*frames: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    for frame in frames:
        spark = frame.sparkSession
        for file in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the bytes of Arrow batches unless the session does."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


def row_key(*columns: str) -> Column:
    """128 hash bits of a row's columns: other rows have the same key with odds of 2^-128 a pair."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *reversed(columns)).alias("b"))


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held(doc_id: str, folds: int) -> Column:
    """crc32(doc_id as text) mod folds is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 1, F.lit(False))
