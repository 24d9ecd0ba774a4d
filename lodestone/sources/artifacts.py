"""Derived tables in the folder that driver and executors share, told by the state of the files they were made from."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_OWN: dict[str, str] = {}


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


class folder:
    """A path of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self.fs.exists(self.at)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.at)]

    def text(self) -> str:
        source = self.fs.open(self.at)
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def write(self, text: str) -> None:
        out = self.fs.create(self.at, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def renamed(self, path: str) -> bool:
        """Renames the file unless there is one of that name; then it is deleted and the answer is False."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        modes = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            hadoop.FileContext.getFileContext(self.at.toUri(), self.fs.getConf()).rename(self.at, hadoop.Path(path), modes)
        except Py4JJavaError as error:
            self.delete()
            if "FileAlreadyExistsException" in str(error.java_exception):
                return False
            raise
        return True

    def delete(self) -> None:
        self.fs.delete(self.at, True)


#: Arrow batches of Python workers, where the session leaves them open: long texts would make batches of any size.
BATCH_BYTES = "4m"


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the bytes of Arrow batches unless the session does."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


@contextlib.contextmanager
def few_rows_a_batch(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """Meanwhile the jobs of the session read tables so many rows at a time: rows of 30 KB make batches of 100 MB else."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    had = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, had)


def complete(spark: SparkSession, path: str) -> bool:
    """A write to the path has ended."""
    return folder(spark, f"{path}/_SUCCESS").exists()


#: Tables of up to this many narrow rows (about 40 bytes each) are broadcast.
FEW = 500_000


def few(df: DataFrame, rows: int) -> DataFrame:
    """The frame, to be broadcast if its counted rows are few."""
    return F.broadcast(df) if rows <= FEW else df


def written(df: DataFrame, name: str, schema: StructType | None = None) -> DataFrame:
    """The rows, written once to the shared folder and read back, as ``schema`` if their types are stored in the same way."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)
