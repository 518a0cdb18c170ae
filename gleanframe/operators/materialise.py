"""Cutting lineage so that a layout is computed once and survives the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a usual file split.
SPLIT = 128 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    The folder named in ``spark.checkpoint.dir`` is used. Only a local-mode session without one
    gets a temporary folder; on a cluster that would be a folder other machines cannot see.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="gleanframe-checkpoint-")
    sc.setCheckpointDir(folder)
    # Goes when the driver ends; the checkpoints themselves go with the tables if spark.cleaner.referenceTracking.cleanCheckpoints is on.
    path = sc._jvm.org.apache.hadoop.fs.Path(sc.getCheckpointDir())
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Write the rows out once, keeping partition numbers and the order inside each partition."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, suffix: str = "") -> str:
    """A new path in the checkpoint folder; what is written there goes when the driver ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/gleanframe-{uuid.uuid4().hex}{suffix}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(hadoop)  # what does not exist cannot be marked
    files.deleteOnExit(hadoop)
    return path


def staged(df: DataFrame) -> DataFrame:
    """Written to the checkpoint folder as a table and read again."""
    spark = df.sparkSession
    path = fresh_path(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_out(df: DataFrame) -> DataFrame:
    """Repartition an input that the planner expects to be small; others have splits enough. Runs nothing."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    expected = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(expected)) <= cores * SPLIT else df
