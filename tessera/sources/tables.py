"""Reading Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPREAD_BYTES = 4 << 20


def read_table(spark: SparkSession, folder: str, name: str, spread: bool = False, task_bytes: int | None = None) -> DataFrame:
    """A table of a folder.

    ``spread`` is for work that costs far more than its reading: a table of
    under ``SPREAD_BYTES`` for each core, which may lie in a single row group and
    so in a single task, is dealt out to all cores. A larger table is read as
    it lies, so no more than that is ever shuffled, unless ``task_bytes`` tells
    of how many bytes of the table a task may be: then it is dealt out by its
    first column, which should be a key. As it lies, Spark makes tasks of up to
    128 MB, and of whole row groups.
    """
    path = f"{folder}/{name}.parquet"
    rows = spark.read.parquet(path)
    if not spread:
        return rows
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(context._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    cores = context.defaultParallelism
    if size < cores * SPREAD_BYTES:
        return rows.repartition(cores) if cores > 1 else rows
    return rows.repartition(-(-size // task_bytes), rows.columns[0]) if task_bytes else rows
