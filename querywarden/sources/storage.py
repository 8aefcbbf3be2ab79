"""Where intermediate tables go: the folder the cluster names, shared by all executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``.

    Where the setting is missing the session is a local one, as in tests, and a local folder serves.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="querywarden-")
    return f"{root.rstrip('/')}/querywarden/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write once as parquet and read back: cuts the lineage and survives the loss of executors.

    Returns the frame and its path; who asked for it deletes the path when the frame is no longer read.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path that ``materialize`` returned, in whichever file system it lies."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder; Spark removes the files with the frame if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or shared_dir(df.sparkSession, "checkpoint"))
    return df.checkpoint(eager=True)
