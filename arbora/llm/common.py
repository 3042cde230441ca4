"""Shared plumbing: tables in the cluster's shared folder and running totals over sorted tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's own checkpoint folder.

    Where neither is set, a temporary one under a local master (tests); on a cluster executors couldn't share that, so it fails.
    """
    context = spark.sparkContext
    given = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not given and (own := context._jsc.sc().getCheckpointDir()).isDefined():
        given = own.get()
    if given:
        return given.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = context.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="arbora-")
    return _OWN[app]


_HELD: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """What a Python worker remembers over its tasks for one operator; it lets go of what it held for another."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


#: Bytes of an Arrow batch between the JVM and Python: texts and sets are long, and tasks of an executor run side by side.
BATCH = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on Arrow batches to BATCH."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m").lower().rstrip("b")
    size = int(now[:-1]) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}[now[-1]] if now[-1:] in ("k", "m", "g") else int(now or 0)
    if size > BATCH or size <= 0:
        spark.conf.set(key, str(BATCH))


class Scratch:
    """Written tables that cut lineage; they survive lost executors because they lie in the shared folder.

    Results read them, so they go as the driver ends; drop() deletes those that nothing will read again before.
    """

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        where, files = self.place(self.root)
        files.mkdirs(where)
        files.deleteOnExit(where)

    def place(self, path: str) -> tuple:
        """A path as the JVM knows it, and its file system."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def table(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """df, written once and read again."""
        path = self.path(name)
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._arbora_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Deletes a table that nothing will read again."""
        if path := getattr(df, "_arbora_path", None):
            where, files = self.place(path)
            files.delete(where, True)


def give_back() -> None:
    """Returns freed memory of this Python worker to the system; workers stay for the tasks to come, of other operators too."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow whose tasks give freed memory back at their end."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(lean, schema)


def renamed(df: DataFrame, *keep: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df whose columns but `keep` are called _own_0, _own_1, ..., and a function that gives a result df's columns back.

    So no column of the caller has the name of one that an operator adds.
    """
    names = {x: f"_own_{i}" for i, x in enumerate(df.columns) if x not in keep}
    quoted = lambda x: F.col("`" + x.replace("`", "``") + "`")
    own = df.select(*[quoted(x).alias(names.get(x, x)) for x in df.columns])
    return own, lambda done: done.select(*[F.col(names.get(x, x)).alias(x) for x in df.columns])


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)


def per_batch(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType) -> DataFrame:
    """f over each Arrow batch; memory is bounded by the batch size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None and out.num_rows:
                yield out

    return mapped(df, run, schema)


def text_bytes(column: pa.Array) -> tuple[memoryview, np.ndarray, np.ndarray]:
    """A string or binary column's bytes, its n + 1 offsets, and which rows are null."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return memoryview(data) if data is not None else memoryview(b""), at, column.is_null().to_numpy(zero_copy_only=False)


def running_totals(df: DataFrame, key: str, order: list[str], weight: str, scratch: Scratch) -> DataFrame:
    """Adds rows_before and weight_before: count and sum of weight over the rows of the same key that sort earlier.

    One key may hold most rows: rows are dealt by range over (key, order), each partition is summed by streaming over it,
    and only one row for each (partition, key) is added up by a window. key must not be null. Ties in order get some order.
    """
    schema = T.StructType([*df.schema.fields, field("_pid", T.IntegerType()), field("_n", T.LongType()), field("_w", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, last, n0, w0 = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            k, w = batch.column(key), batch.column(weight).to_numpy(zero_copy_only=False).astype(np.int64)
            new = np.ones(rows, dtype=bool)
            new[1:] = pc.not_equal(k.slice(1), k.slice(0, rows - 1)).to_numpy(zero_copy_only=False)
            first = k[0].as_py()
            if last is None or first != last:
                n0 = w0 = 0
            start = np.maximum.accumulate(np.where(new, np.arange(rows), 0))
            before = np.cumsum(w) - w
            n, s = np.arange(rows) - start, before - before[start]
            n, s = n + np.where(start == 0, n0, 0), s + np.where(start == 0, w0, 0)
            last, n0, w0 = k[rows - 1].as_py(), int(n[-1]) + 1, int(s[-1] + w[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(rows, pid, np.int32)), pa.array(n.astype(np.int64)), pa.array(s.astype(np.int64))], names=schema.names)

    ranged = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    local = scratch.table(mapped(ranged, run, schema), "ranged")
    each = local.groupBy("_pid", key).agg(F.count(F.lit(1)).alias("_rows"), F.sum(weight).alias("_sum"))
    earlier = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select("_pid", key, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_w0"))
    return local.join(offsets, ["_pid", key]).select(*df.columns, (F.col("_n") + F.col("_n0")).alias("rows_before"), (F.col("_w") + F.col("_w0")).alias("weight_before"))


#: DuckDB's SQL has no crc32: a table expression crc(bytes) with the 256 remainders, to be joined by crc32_sql's users.
CRC_SQL = """crc(bytes) as (
  select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) from (select unnest(range(256))::bigint i))"""


def crc32_sql(text: str) -> str:
    """SQL for the unsigned crc32 of a text's UTF-8; crc must be among the tables."""
    byte = f"list_transform(range(1, strlen(hex(encode({text}))) // 2 + 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::bigint)"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {byte}), lambda c, b: xor(c >> 8, bytes[xor(c, b) % 256 + 1])), 4294967295)"
