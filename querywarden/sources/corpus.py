"""Readers for labelled corpora of query text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Every field is read as text: an INT field would turn the accepted "1" into NULL.
CORPUS_FIELDS = ("query", "question", "toxic", "db_id")
UNREADABLE_LABEL = -1


def read_corpus(spark: SparkSession, path: str, fmt: str = "json", extra: str | None = None) -> DataFrame:
    """Read a labelled corpus and apply the defaults.  Fields of any other name are kept.

    ``extra`` names and types the other fields of a JSON corpus (``"id LONG, attack STRING"``); without it
    Spark infers them in a pass of its own.

    ``json`` is one JSON array per file; such a file cannot be split, so use many files or
    ``jsonl`` (one object per line, splittable) or ``parquet`` for large corpora.
    """
    if fmt in ("json", "jsonl"):
        lines = fmt == "jsonl"
        if extra is None:
            found = spark.read.json(path, multiLine=not lines).schema
            own = [f"`{f.name}` {f.dataType.simpleString()}" for f in found if f.name not in (*CORPUS_FIELDS, "_corrupt_record")]
        else:
            own = [extra] if extra else []
        schema = ", ".join([*(f"{name} STRING" for name in CORPUS_FIELDS), *own])
        raw = spark.read.schema(schema).json(path, multiLine=not lines)
    elif fmt == "parquet":
        raw = spark.read.parquet(path)
    else:
        raise ValueError(f"unknown corpus format {fmt!r}")
    return normalise_corpus(raw)


def normalise_corpus(raw: DataFrame) -> DataFrame:
    """Bring a frame to the corpus layout; missing columns and fields get their defaults.

    ``query`` stays NULL when missing (see the NULL policy); ``toxic`` is an integer, 0 when missing
    and -1 when it is not a number, which keeps the row in the totals and out of every split.
    """
    for name in ("query", "question", "toxic", "db_id"):
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast("string"))
    text = F.trim(F.col("toxic").cast("string"))
    label = (
        F.when(text.isNull(), F.lit(0))
        .when(F.lower(text) == "true", F.lit(1))
        .when(F.lower(text) == "false", F.lit(0))
        .otherwise(F.coalesce(F.expr("try_cast(try_cast(trim(cast(toxic AS STRING)) AS DOUBLE) AS INT)"), F.lit(UNREADABLE_LABEL)))
    )
    return raw.withColumns(
        {
            "question": F.coalesce("question", F.lit("")),
            "db_id": F.coalesce("db_id", F.lit("")),
            "toxic": label,
        }
    )
