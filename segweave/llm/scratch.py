"""Intermediate tables in the folder that all executors share.

A written table cuts lineage like checkpoint() does, is computed once, and survives the loss of any executor.
"""

from __future__ import annotations

import ctypes
import inspect
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from segweave.shared import shared_folder

class Scratch:
    """Writes intermediate tables below spark.checkpoint.dir and drops those that are no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/segweave-{uuid.uuid4().hex}"
        self.made = 0

    def write(self, df: DataFrame, compression: str | None = None) -> DataFrame:
        """df's rows, read back from a table of their own; compression: other than the session's."""
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.parquet(path, compression=compression)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes the table that write() returned as df; nothing may read it any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession, most: str = "8m") -> None:
    """Bounds the bytes of each batch that Arrow hands to Python, so that very long texts don't add up.

    The session keeps the bound: the frames that need it are executed later, by whoever reads them.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def give_back() -> None:
    """Hands memory that nothing holds any more back to the machine: workers live on for other stages and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable) -> Callable:
    """run, a function of mapInArrow or applyInPandas, that gives unused memory back: at a task's end, or after a large group."""
    if inspect.isgeneratorfunction(run):

        def tidied(batches):
            yield from run(batches)
            give_back()

        return tidied

    def tidied_group(key, rows):
        out = run(key, rows)
        if rows.memory_usage(deep=True).sum() > 8_000_000:
            give_back()
        return out

    return tidied_group
