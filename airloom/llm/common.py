"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 4 << 20
GROUP_BYTES = 32 << 20
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000
HEAP_SHARE = 0.5  # of the driver's heap: a table written while it takes more is followed by `release`


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def reread(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors.

    A writer holds one row group and a Python worker's pipe one batch, in the JVM and in Python: both are kept small
    while writing, because tables here carry whole texts. The driver's heap is emptied of what the job left once it
    fills.
    """
    from airloom.session import scratch_path

    path = scratch_path(spark, name)
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    finally:
        spark.conf.set(BATCH, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    if crowded(spark):
        release(spark)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what `reread` wrote for these tables; nothing may read them afterwards."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._scratch)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def crowded(spark: SparkSession) -> bool:
    """Whether the driver's heap takes more than `HEAP_SHARE` of what it may."""
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    return heap.totalMemory() > HEAP_SHARE * heap.maxMemory()


def release(spark: SparkSession) -> None:
    """Collect the driver's garbage: Spark drops the shuffles and broadcasts of finished jobs only then, and the heap that their plans took is given back.

    So is what was freed outside the heap, where the JVM knows how: the C library keeps it for each thread otherwise,
    and every exchange has a thread.
    """
    spark._jvm.System.gc()
    java, gateway = spark._jvm.java, spark.sparkContext._gateway
    server = java.lang.Class.forName("javax.management.MBeanServer")  # its implementation can't be called from outside
    invoke = next(m for m in server.getMethods() if m.getName() == "invoke")
    command = gateway.new_array(java.lang.Object, 4)  # name, operation, and no arguments
    command[0], command[1] = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    with suppress(Py4JJavaError):  # JVMs without the command
        invoke.invoke(java.lang.management.ManagementFactory.getPlatformMBeanServer(), command)


def give_back() -> None:
    """Return freed memory to the system: the C library keeps it otherwise, and a worker between tasks holds what its last one needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` over a task's batches, then `give_back`."""

    @wraps(run)
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


def sliced(batches: Iterable[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice's texts stay near `limit` bytes; a longer text is a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def encoded(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]
