"""Helpers shared by the corpus operators: scratch tables and Arrow text blocks."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sparkloom.operators.graphs import scratch_dir

#: Rows in one Arrow batch. Texts are long, so Spark's default of 10,000 rows could make batches of a gigabyte.
ROWS_PER_BATCH = "1000"
#: Bytes of text handled at once in numpy; the working arrays take about 80 bytes for each of them. A longer text is
#: handled piece by piece where its pieces can be told apart.
BLOCK_BYTES = 1 << 20


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes `df` as Parquet into the shared scratch folder and reads it back.

    This cuts the lineage: any executor can read the files again, so losing one repeats at most the tasks under way.
    The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).deleteOnExit(target)
    return spark.read.schema(schema).parquet(path)


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that workers import it and keep its caches."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="sparkloom-")  # on the driver, whose file server hands it out
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = f"{folder}/{package.name}-code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    context.addPyFile(target)


def prepare(spark: SparkSession) -> None:
    """Ships the code, and lowers the rows of an Arrow batch if the session still has Spark's default."""
    ship_code(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)


def free_memory() -> None:
    """Gives freed memory back to the system at a task's end, as workers wait for later tasks with what they hold."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column into runs of rows with at most `limit` bytes (a longer single row makes a run of its own).

    Yields (first row, row after the last, UTF-8 bytes, offsets of the rows in them); a null counts as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, last, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last
