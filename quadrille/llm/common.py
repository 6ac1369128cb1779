"""Helpers that the corpus operators share: tables in the shared folder and Arrow maps."""

from __future__ import annotations

import ctypes
import gc
import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows of the Arrow batches in which tables are made; texts are long, and batches are held twice by each side.
BATCH_ROWS = 1500
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Bytes of text that one slice of an Arrow batch holds at most, unless a single row is longer.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset and all runs in one process, as in tests, a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="quadrille-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Written:
    """Tables written to the shared folder, which cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_dir(spark)}/quadrille-{uuid.uuid4().hex}"
        self.count = 0

    def table(self, df: DataFrame) -> tuple[DataFrame, str]:
        self.count += 1
        path = f"{self.base}/{self.count}"
        before = self.spark.conf.get(_ROWS)
        self.spark.conf.set(_ROWS, min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS)
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_ROWS, before)
        return self.spark.read.schema(df.schema).parquet(path), path

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.table(df)[0]

    def release(self) -> None:
        """Lets Spark's cleaner take the shuffle files that only dropped plans refer to."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces whose text column holds at most that many bytes, or a single row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def give_back() -> None:
    """Returns what this worker has freed to the system; workers outlive their tasks and would hold it through the next ones."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def map_slices(df: DataFrame, text_at: int, schema: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow by slices of bounded bytes; fn returns a batch of the schema, or None for no rows."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch, text_at, slice_bytes):
                out = fn(piece)
                if out is not None and out.num_rows:
                    yield out
                del piece, out
                give_back()

    return df.mapInArrow(run, schema)


def on_worker(spark: SparkSession, fn: Callable):
    """fn's result, worked out in a task: Spark gives its Python workers one numeric thread, which a driver that has forked cannot count on."""

    def run(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fn())], pa.binary())], names=["result"])

    return pickle.loads(spark.range(0, 1, 1, 1).mapInArrow(run, "result binary").first().result)


def id_type(df: DataFrame, column: str) -> str:
    return dict(df.dtypes)[column]
