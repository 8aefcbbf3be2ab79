"""Statistics of a growing corpus that are taken part by part (a day, say), stored, and merged later.

A sketch is a table with the part's columns and

    column, kind, bucket, value

- kind ``distinct``: HyperLogLog registers of the MD5 of the value as text.  ``bucket`` is one of 4,096 registers,
  ``value`` its highest rank; merged by the maximum.  Standard error of the estimate: 1.04 / sqrt(4096) = 1.6 %.
- kind ``quantile``: counts of whole numbers on a grid of 32 steps for each power of two, exact below 64; merged by
  the sum.  An estimate is off by at most 1/64 of the value.

Whatever a part's size, it has at most 4,096 rows for a ``distinct`` column and about 3,800 for a ``quantile`` column,
combined before the shuffle.  Merged parts equal the sketch of all their rows exactly.  NULL is not counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REGISTERS = 4096
_HASH_BITS = 52
_STEP_BITS = 6


def _bits(number: Column) -> Column:
    """The length of a number that is not negative, in binary; 1 for 0."""
    return F.length(F.bin(number)).cast("long")


def _register(value: Column) -> tuple[Column, Column]:
    digest = F.md5(value.cast("string").cast("binary"))
    rest = F.conv(F.substring(digest, 4, 13), 16, 10).cast("long")
    rank = F.when(rest == 0, _HASH_BITS + 1).otherwise(_HASH_BITS + 1 - _bits(rest))
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("long"), rank.cast("long")


def _grid(value: Column) -> Column:
    number = F.abs(value.cast("long"))
    shift = F.greatest(_bits(number) - _STEP_BITS, F.lit(0))
    step = shift * (1 << _STEP_BITS) + F.call_function("shiftright", number, shift.cast("int"))
    return F.when(value < 0, -step).otherwise(step)


def sketch(df: DataFrame, part: Sequence[str] = (), distinct: Sequence[str] = (), quantiles: Sequence[str] = ()) -> DataFrame:
    """The sketches of all columns named, in one pass over df.  quantiles: columns of whole numbers."""
    if not distinct and not quantiles:
        raise ValueError("name a column")

    def entry(column: str, kind: str, bucket: Column, value: Column) -> Column:
        held = F.struct(F.lit(column).alias("column"), F.lit(kind).alias("kind"), bucket.alias("bucket"), value.alias("value"))
        return F.when(F.col(f"`{column}`").isNotNull(), held)

    entries = [entry(c, "distinct", *_register(F.col(f"`{c}`"))) for c in distinct]
    entries += [entry(c, "quantile", _grid(F.col(f"`{c}`")), F.lit(1).cast("long")) for c in quantiles]
    listed = df.select(*part, F.explode(F.array(*entries)).alias("_e")).where("_e IS NOT NULL")
    return merge(listed.select(*part, "_e.*"), part)


def merge(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One sketch for each value of ``by`` from those of many parts."""
    cells = sketches.groupBy(*by, "column", "kind", "bucket").agg(F.max("value").alias("_high"), F.sum("value").alias("_sum"))
    value = F.when(F.col("kind") == "distinct", F.col("_high")).otherwise(F.col("_sum"))
    return cells.select(*by, "column", "kind", "bucket", value.alias("value"))


def store(sketches: DataFrame, path: str, part: Sequence[str]) -> None:
    """Add parts to a folder.  A part that is there already is replaced, so a repeated run counts nothing twice."""
    compact = sketches.repartition(*part)
    compact.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*part).parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def distinct_counts(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, column and ``distinct``, the estimated number of different values; linear counting while registers are empty
    and the estimate is below 2.5 times their number."""
    cells = merge(sketches.where("kind = 'distinct'"), by).groupBy(*by, "column")
    filled = cells.agg(F.count(F.lit(1)).alias("_filled"), F.sum(F.pow(F.lit(2.0), -F.col("value"))).alias("_sum"))
    empty = REGISTERS - F.col("_filled")
    raw = F.lit(0.7213 / (1 + 1.079 / REGISTERS) * REGISTERS * REGISTERS) / (empty + F.col("_sum"))
    few = (empty > 0) & (raw <= 2.5 * REGISTERS)
    return filled.select(*by, "column", F.when(few, REGISTERS * F.log(REGISTERS / F.greatest(empty, F.lit(1)))).otherwise(raw).alias("distinct"))


def quantile_values(sketches: DataFrame, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by, column, share, ``value`` and ``n``: the value with the rank ceil(share * n) of n, as the middle of its step."""
    cells = merge(sketches.where("kind = 'quantile'"), by)
    rows = Window.partitionBy(*by, "column")  # a grid's steps, whatever the number of rows behind them
    upto = F.sum("value").over(rows.orderBy("bucket"))
    ranked = cells.select(*by, "column", "bucket", F.col("value").alias("_n"), upto.alias("_upto"), F.sum("value").over(rows).alias("n"))
    wanted = F.explode(F.array(*[F.lit(float(s)) for s in shares]))
    ranked = ranked.withColumn("share", wanted).withColumn("_rank", F.greatest(F.ceil(F.col("share") * F.col("n")), F.lit(1)))
    hit = ranked.where((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_n")))
    step = F.abs("bucket")
    shift = F.greatest(F.call_function("shiftright", step, F.lit(_STEP_BITS)), F.lit(0)).cast("int")
    mantissa = step - shift.cast("long") * (1 << _STEP_BITS)
    width = F.call_function("shiftleft", F.lit(1).cast("long"), shift)
    middle = mantissa * width + F.call_function("shiftright", width, F.lit(1))
    return hit.select(*by, "column", "share", F.when(F.col("bucket") < 0, -middle).otherwise(middle).alias("value"), "n")
