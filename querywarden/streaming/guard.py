"""Guard for a stream of generated queries: the batch columns on a streaming frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.verdict import DEFAULT, VerdictConfig, score

#: Files that a task writes at the same time: more than there are actions.
WRITERS = 8


def guard(stream: DataFrame, sql_col: str = "sql", config: VerdictConfig = DEFAULT) -> DataFrame:
    """Score a stream; stateless, so it runs in append mode with no watermark."""
    return score(stream, sql_col, config=config)


def once(stream: DataFrame, keys: Sequence[str], event_time: str, delay: str) -> DataFrame:
    """Drop rows whose keys were seen before, so that a source that sends rows again has each scored once.

    A key is remembered for ``delay`` after the latest event time, and then forgotten: the state holds the
    keys of that span only.  The state is part of the query's checkpoint, so a restart remembers too.
    """
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def start_guard(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    sql_col: str = "sql",
    config: VerdictConfig = DEFAULT,
    available_now: bool = False,
    interval: str | None = None,
    once_by: Sequence[str] = (),
    event_time: str = "ts",
    delay: str = "1 hour",
) -> StreamingQuery:
    """Write scored rows to parquet, one folder per action, so readers prune to what they need.

    Every batch writes a set of files: ``interval`` ("5 minutes") makes batches larger and files fewer.

    With ``once_by``, rows that a source repeats within ``delay`` are dropped before they are scored (``once``).

    A task keeps a file open for each action (``WRITERS`` at most), so that scored rows are not sorted by action in
    memory before they are written; the session's ``spark.sql.maxConcurrentOutputFileWriters`` is raised for it.

    The file sink's log makes each batch count once even when it is written again after a failure.
    """
    if once_by:
        stream = once(stream, once_by, event_time, delay)
    writer = (
        guard(stream, sql_col, config)
        .writeStream.format("parquet")
        .partitionBy("action")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif interval:
        writer = writer.trigger(processingTime=interval)
    # The file sink reads the setting of its session at each batch, so it has to stay.
    spark, setting = stream.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
    spark.conf.set(setting, max(int(spark.conf.get(setting)), WRITERS))
    return writer.start()
