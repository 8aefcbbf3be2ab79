"""The gold query nearest in structure, for generated queries whose question has none.

Nearness is the share of the nine tree features that are equal.  At least m of 9 features are equal exactly if
some choice of 9 - m features, left out of both, makes the rest equal as a whole.  Every distinct tree
therefore gets one key for each choice of at most 9 - m left-out features; of all gold queries with the same key
only the smallest is kept.  An equi-join on the keys then finds the nearest one: a generated tree meets at most
one gold row per key, so no pair of trees is ever formed only to be thrown away, however common a feature is.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.structure import TREE_FEATURES, with_structure
from ..sources.storage import checkpointed
from .skew import spread_join

#: Answers of trees that are broadcast, and bytes of one without its text, about.
BROADCAST_BYTES = 8 << 20
ROW_BYTES = 500


def _keys(tree: str, most: int) -> Column:
    """Array of (missed, key): the features as one text, with those left out replaced by a star."""
    shown = {f: F.coalesce(F.col(f"{tree}.{f}").cast("string"), F.lit("")) for f in TREE_FEATURES}
    out = []
    for missed in range(most + 1):
        for without in combinations(TREE_FEATURES, missed):
            key = F.concat_ws("|", *[F.lit("*") if f in without else shown[f] for f in TREE_FEATURES])
            out.append(F.struct(F.lit(missed).alias("missed"), key.alias("key")))
    return F.array(*out)


def nearest_gold(
    generated: DataFrame,
    gold: DataFrame,
    sql_col: str = "sql",
    gold_col: str = "gold_sql",
    within: Sequence[str] = ("db_id",),
    least_equal: int = 7,
) -> DataFrame:
    """Add ``nearest_sql`` and ``nearest_similarity``: of the gold queries of the same ``within`` that share at
    least ``least_equal`` features, the one that shares most, the smallest text among equals; else NULL.

    Malformed text on either side, and blank gold, has no neighbour.  NULL counts as the empty text in ``within``.
    """
    within = list(within)
    if not 1 <= least_equal <= len(TREE_FEATURES):
        raise ValueError(f"least_equal is the number of equal features, 1 to {len(TREE_FEATURES)}")
    most = len(TREE_FEATURES) - least_equal
    names = [f"_near_{k}" for k in within]

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumns({n: F.coalesce(F.col(k).cast("string"), F.lit("")) for n, k in zip(names, within, strict=True)})

    own = keyed(with_structure(generated, sql_col, "_own_")).drop("_own_skeleton", "_own_well_formed")
    ident = "_near_tree"
    own = own.withColumn(ident, F.coalesce(_keys("_own_tree", 0)[0]["key"], F.lit("")))
    sides = keyed(gold.select(*within, F.col(gold_col).alias("_gold")))
    sides = with_structure(sides.where("_gold IS NOT NULL AND trim(_gold) <> ''"), "_gold", "_gold_").where("_gold_well_formed")
    # Equal trees have equal keys: the smallest text of each tree is all that its keys need.
    sides = sides.groupBy(*names, "_gold_tree").agg(F.min("_gold").alias("_gold"))
    listed = sides.select(*names, "_gold", F.explode(_keys("_gold_tree", most)).alias("k"))
    index = listed.groupBy(*names, F.col("k.key").alias("key")).agg(F.min("_gold").alias("_gold"))

    # Distinct values without a further column are counted in a hash table as small as the number of trees.
    features = [F.col(f"_own_tree.{f}").alias(f"_own_{f}") for f in TREE_FEATURES]
    trees = own.where(F.col("_own_tree").isNotNull()).select(*names, ident, *features).distinct()
    trees = trees.select(*names, ident, F.struct(*[F.col(f"_own_{f}").alias(f) for f in TREE_FEATURES]).alias("_own_tree"))
    asked = trees.select(*names, ident, F.explode(_keys("_own_tree", most)).alias("k")).select(*names, ident, "k.missed", "k.key")
    best = asked.join(index, [*names, "key"]).groupBy(*names, ident).agg(F.min(F.struct("missed", "_gold")).alias("_best"))
    equal = F.lit(len(TREE_FEATURES)) - F.col("_best.missed")
    best = best.select(*names, ident, F.col("_best._gold").alias("nearest_sql"), (equal / F.lit(float(len(TREE_FEATURES)))).alias("nearest_similarity"))
    # One row for each distinct tree: far fewer than queries, mostly, which Spark cannot know beforehand.
    best = checkpointed(best)
    size = best.agg(F.sum(F.octet_length("nearest_sql") + ROW_BYTES).alias("n")).first().n or 0
    if size <= BROADCAST_BYTES:
        best = F.broadcast(best)
    kept = [F.col(f"`{c}`") for c in generated.columns]
    return spread_join(own.drop("_own_tree"), best, [*names, ident], spread=size > BROADCAST_BYTES).select(*kept, "nearest_sql", "nearest_similarity")
