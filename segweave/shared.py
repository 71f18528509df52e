"""Written intermediate tables for loops whose plans would grow."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only on one machine, as in tests, where spark.checkpoint.dir is unset.
LOCAL_FALLBACK = "/tmp/checkpoints/segweave"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; without one a cluster gets an error, a local session a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: intermediate tables need a folder that all executors share")
        root = LOCAL_FALLBACK
    return root.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df's rows, read back from a table of their own in the folder that all executors share; cuts lineage."""
    path = f"{shared_folder(df.sparkSession)}/engine-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def unbounded(df: DataFrame) -> DataFrame:
    """df as the side of a join that isn't broadcast, however small the engine takes it to be.

    Its guesses come from file sizes, where repeated values pack, and from the widths of types, where a variant counts for
    kilobytes; a few columns that are taken from such rows seem to be next to nothing.
    """
    return df.hint("merge")


def discard(df: DataFrame) -> None:
    """Deletes the table that written() returned as df; nothing may read it any more."""
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._written_path)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
