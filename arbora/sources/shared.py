"""The folder that driver and executors share, tables written there, and files that a single writer may create."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Bytes of an Arrow batch between the JVM and Python. A Python worker holds a batch, its rows as objects and what becomes of them.
BATCH = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder under a local master, as in tests, else an error."""
    context = spark.sparkContext
    given = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="arbora-")
    return _OWN[context.applicationId]


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on Arrow batches to BATCH, so that long rows go to Python workers a few at a time."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, "64m"))
    if size > BATCH or size <= 0:
        spark.conf.set(key, str(BATCH))


def place(spark: SparkSession, path: str) -> tuple:
    """A path as the JVM knows it, and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes as the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    where, files = place(spark, path)
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


def written(df: DataFrame, path: str) -> DataFrame:
    """df, written once and read again: what follows is cut off from its lineage and survives lost executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def children(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names and modification times (ms) of what a folder holds; none if there is no such folder."""
    where, files = place(spark, path)
    return [(x.getPath().getName(), x.getModificationTime()) for x in files.listStatus(where)] if files.exists(where) else []


def created(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file that must not exist yet; False if another writer was first."""
    where, files = place(spark, path)
    files.mkdirs(where.getParent())
    try:
        out = files.create(where, False)
    except Exception as failed:
        if files.exists(where):
            return False
        raise failed
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def text_of(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    where, files = place(spark, path)
    size = files.getFileStatus(where).getLen()
    stream = files.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)).decode()
    finally:
        stream.close()


def removed(spark: SparkSession, path: str) -> None:
    where, files = place(spark, path)
    files.delete(where, True)
