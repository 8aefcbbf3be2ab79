"""Joins on keys that may hold a large part of one side's rows, and running sums without one large window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.storage import checkpointed

#: A hot key's rows are dealt in pieces of a task's mean share divided by this.
PIECES = 16


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark's own estimate of a frame lies within its broadcast threshold."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def hot_keys(df: DataFrame, keys: Sequence[str], salts: str) -> DataFrame:
    """The keys with more rows than a piece, and into how many pieces their rows go.

    There are fewer such keys than ``PIECES`` times the number of tasks, whatever the data.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    pieces = F.ceil(F.col("_n") * F.lit(PIECES * tasks) / total).cast("int")
    return counts.select(*keys, pieces.alias(salts)).where(F.col(salts) > 1)


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", spread: bool | None = None, parts: int | None = None) -> DataFrame:
    """Join on ``keys`` (without NULLs; named alike on both sides), ``left`` being the side with hot keys.

    A right side that Spark would broadcast is joined as it is (``spread`` overrules).  Otherwise the rows of a hot key are dealt
    by a hash of the whole row over as many salts as its count calls for, and its rows of the right side are
    repeated for each of them; all other keys have one salt.  Every row meets the same partners as in a plain
    join.  ``parts`` is the number of tasks, where Spark's setting would leave too much to each.  The salt depends on the row alone, so that a task that runs again deals alike; rows equal in every
    column stay together.
    """
    keys = list(keys)
    if not (spread if spread is not None else not fits_broadcast(right)):
        return left.join(right, keys, how)
    salt, salts = "_salt", "_salts"
    hot = F.broadcast(checkpointed(hot_keys(left, keys, salts)))
    whole = F.xxhash64(*[F.col(f"`{f.name}`") for f in left.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()])
    dealt = left.join(hot, keys, "left").withColumn(salt, F.pmod(whole, F.coalesce(salts, F.lit(1))).cast("int")).drop(salts)
    every = F.explode(F.sequence(F.lit(0), F.coalesce(salts, F.lit(1)) - 1))
    repeated = right.join(hot, keys, "left").withColumn(salt, every).drop(salts)
    if parts:
        dealt, repeated = (side.repartition(parts, *keys, salt) for side in (dealt, repeated))
    return dealt.join(repeated, [*keys, salt], how).drop(salt)


def running_sums(df: DataFrame, order: Sequence[str], values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Add ``sum_<value>``, the sum over the rows of the same ``by`` up to and including this one, and
    ``all_<value>``, that over all of them.

    Two passes: rows are range-partitioned and stored with the number of their partition; each partition
    sums its own rows, and the totals of the partitions before it (as many as there are partitions) are added.
    ``by`` and ``order`` together must be distinct.
    """
    by, part, one = list(by), "_part", "_one"
    if not by:
        return running_sums(df.withColumn(one, F.lit(1)), order, values, [one]).drop(one)
    ranged = checkpointed(df.repartitionByRange(*by, *order).withColumn(part, F.spark_partition_id()))
    totals = ranged.groupBy(*by, part).agg(*[F.sum(v).alias(v) for v in values])
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = [F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_before_{v}") for v in values]
    own = {c: f"_of_{c}" for c in (*by, part)}
    offsets = totals.select(*[F.col(c).alias(n) for c, n in own.items()], *offsets, *[F.sum(v).over(whole).alias(f"all_{v}") for v in values])
    inside = Window.partitionBy(*by, part).orderBy(*order)
    summed = ranged.withColumns({f"sum_{v}": F.sum(v).over(inside) for v in values})
    # NULL is a value of ``by`` like any other.
    summed = summed.join(offsets, [F.col(c).eqNullSafe(F.col(n)) for c, n in own.items()]).drop(*own.values())
    return summed.withColumns({f"sum_{v}": F.col(f"sum_{v}") + F.col(f"_before_{v}") for v in values}).drop(part, *[f"_before_{v}" for v in values])
