"""Helpers that all operators of this subpackage share."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The words of every contract: runs of anything but ASCII white space.
WORD = "[^\x20\x09-\x0d]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet (names are compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_SHIPPED: set[str] = set()


def ship(df: DataFrame) -> DataFrame:
    """Give the executors this package, once for each application, so that Arrow functions find it there."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent.parent
        target = Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for source in sorted(root.rglob("*.py")):
                archive.write(source, source.relative_to(root.parent))
        context.addPyFile(str(target))
        _SHIPPED.add(context.applicationId)
    return df


def arrow_column(function: Callable[[pa.Array], pa.Array], schema: T.DataType) -> Callable[[Column], Column]:
    """An Arrow function of one column. Marked non-deterministic so that Spark evaluates it once per row
    and does not repeat it below a filter."""
    kind = schema

    @F.arrow_udf(kind)
    def run(column: pa.Array) -> pa.Array:
        return function(column)

    return run.asNondeterministic()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. A local session without that
    setting gets a temporary folder; a cluster session without it fails."""
    context = spark.sparkContext
    shared = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared)
    return shared


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder; Spark removes the files by its own setting
    (spark.cleaner.referenceTracking.cleanCheckpoints)."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
