"""Shared storage for intermediate tables and files of the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or on one machine a temporary one where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='stratus-')}"
        spark.conf.set("spark.checkpoint.dir", where) if spark.conf.isModifiable("spark.checkpoint.dir") else None
        spark.sparkContext.setCheckpointDir(where)
        _fallback[id(spark.sparkContext)] = where
    return where.rstrip("/")


_fallback: dict[int, str] = {}


def fresh_path(spark: SparkSession, name: str) -> str:
    where = _fallback.get(id(spark.sparkContext)) or shared_dir(spark)
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends here and no executor holds the only copy."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    _note(path)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Tables:
    """Intermediate tables of one job in the shared folder. When the job's last table is written the others are deleted."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        _note(path)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = out
        return out

    def drop(self, *tables: DataFrame, keep: tuple[DataFrame, ...] = ()) -> None:
        """Delete ``tables``, or all but ``keep``; nothing may read them later."""
        for path, df in list(self.paths.items()):
            if any(df is x for x in tables) if tables else not any(df is x for x in keep):
                delete(self.spark, path)
                del self.paths[path]


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_noted: list[list[str]] = []


def _note(path: str) -> None:
    for paths in _noted:
        paths.append(path)


class StageTables:
    """Deletes the intermediate tables of a stage when the next one begins, but for those that the next one's input still
    reads: as a rule the result has been written, and it reads none."""

    def __init__(self):
        self.before: list[str] = []

    @contextlib.contextmanager
    def stage(self, spark: SparkSession, docs: DataFrame):
        folders = {part for f in docs.inputFiles() for part in f.split("/")} if self.before else set()
        kept = [path for path in self.before if path.rsplit("/", 1)[-1] in folders]
        for path in self.before:
            if path not in kept:
                delete(spark, path)
        self.before = own = kept
        _noted.append(own)
        try:
            yield
        finally:
            _noted[:] = [x for x in _noted if x is not own]


def file_system(uri: str):
    """(pyarrow file system, path) of a URI or of a plain local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int):
    """What is planned inside hands Python at most so many rows at once: for rows of megabytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release() -> None:
    """Hand freed memory back: Python workers live on after a task and share their executor's memory."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def map_slices(df: DataFrame, f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, rows: int = 512) -> DataFrame:
    """``df.mapInPandas(f, schema)`` that hands ``f`` a few rows at a time and frees what a task held. Whole numbers stay
    whole beside nulls."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slices():
            for batch in batches:
                for i in range(0, batch.num_rows, rows):
                    yield batch.slice(i, rows).to_pandas(integer_object_nulls=True)

        try:
            for out in f(slices()):
                yield pa.RecordBatch.from_pandas(out, schema=arrow, preserve_index=False)
        finally:
            release()

    return df.mapInArrow(run, schema)


def freed(f: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """``f`` of a group, after which memory is handed back, though not more often than once a second."""

    def run(group):
        try:
            return f(group)
        finally:
            if time.monotonic() - _released[0] > 1:
                release()
                _released[0] = time.monotonic()

    return run


_released = [0.0]


def local_dir() -> str:
    """A folder of Spark's own on the executor's disk, cleared when the executor ends; for what one task alone needs."""
    where = next((d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if d), tempfile.gettempdir())
    os.makedirs(where, exist_ok=True)
    return where


def partitions_for(df: DataFrame, bytes_each: int, most: int = 100_000) -> int:
    """How many partitions of so many bytes ``df`` fills by Spark's own estimate, where it has one; not fewer than it
    shuffles into."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size < 1 << 60
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(most, -(-size // bytes_each)) if known else 0)
