"""Tables in the cluster's shared checkpoint folder, which cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names; on one machine, and only there, a folder of our own where it names none."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return checkpoint_folder(spark)


def _own(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/tessera-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, which goes with ``drop_scratch`` or the end of the application."""
    files, own = _files(spark)
    files.mkdirs(own)
    files.deleteOnExit(own)  # what drop_scratch has not deleted by then
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared checkpoint folder and read it back.

    This cuts the lineage with replicated or shared storage instead of
    executor-local blocks, so a lost executor costs a re-read and no more. It
    stays until ``drop_scratch`` or the end of the application.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    # small row groups, as a task holds one of each column in memory while it writes
    df.write.option("parquet.block.size", 32 << 20).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession):
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own(spark))
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), own


def drop_scratch(spark: SparkSession) -> None:
    """Delete what ``materialise`` has written for this application so far."""
    files, own = _files(spark)
    files.delete(own, True)
