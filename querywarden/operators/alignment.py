"""Structural comparison of generated SQL with the gold SQL of the same question."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalogue import INCONSISTENCIES, PARSE_FAILED, PATTERN_LABELS
from ..functions.patterns import with_suspicious_patterns
from ..functions.structure import tree_similarity, with_structure
from .skew import spread_join

PATTERN_PENALTY = 0.15
EXPECTED = "expected_"
#: What ``join_gold`` adds when it is asked for the structure of the gold texts.
EXPECTED_COLUMNS = tuple(f"{EXPECTED}{c}" for c in ("well_formed", "tree", "skeleton"))


def join_gold(
    generated: DataFrame,
    gold: DataFrame,
    keys: Sequence[str] = ("db_id", "question"),
    gold_col: str = "gold_sql",
    out: str = "expected_sql",
    spread: bool | None = None,
    structure: bool = False,
) -> DataFrame:
    """Left join every generated query with its gold query; rows without one get NULL.

    With ``structure`` the structure of the gold text is joined too, as ``EXPECTED_COLUMNS``: it is taken once
    for each key, before the join, however many queries hold that key.

    A key may hold a large part of the generated rows: unless the gold side is small enough to be broadcast,
    the rows of such a key are dealt over several tasks (``spread_join``).  Different gold texts for one
    key are an error, since a query would be held against only one of them; equal ones count once.
    """
    keys = list(keys)
    fill = {k: F.coalesce(F.col(k), F.lit("")) for k in keys}
    names = {k: f"_gold_{k}" for k in keys}
    on = list(names.values())
    left = generated.withColumns({names[k]: c for k, c in fill.items()})
    right = gold.select(*[c.alias(names[k]) for k, c in fill.items()], F.col(gold_col).alias(out))
    lowest, highest = F.min(out), F.max(out)
    conflict = F.raise_error(F.concat(F.lit("several gold texts for "), F.concat_ws(", ", *on)))
    right = right.groupBy(*on).agg(F.when(lowest < highest, conflict.cast("string")).otherwise(lowest).alias(out))
    if structure:
        right = with_structure(right, out, EXPECTED)
    # Spark would merge these tasks by their bytes; the work that follows is in the texts.
    parts = int(generated.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spread_join(left, right, on, spread=spread, parts=parts).drop(*on)


def expected_similarity(df: DataFrame, expected_col: str, structured: bool = False) -> tuple[DataFrame, Column]:
    """The frame with ``EXPECTED_COLUMNS``, unless ``structured`` says that it has them, and the similarity of
    ``tree`` to the expected one; missing, blank or malformed expected text compares as equal."""
    if not structured:
        df = with_structure(df, expected_col, EXPECTED)
    similarity = tree_similarity(F.col("tree"), F.col(f"{EXPECTED}tree"))
    # Blank text is not well formed.
    return df, F.when(F.col(f"{EXPECTED}well_formed"), similarity).otherwise(F.lit(1.0))


def with_alignment(df: DataFrame, sql_col: str = "sql", expected_col: str | None = None, structured: bool = False) -> DataFrame:
    """Add ``well_formed``, ``skeleton``, ``tree``, the pattern flags, ``tree_similarity``,
    ``expected_skeleton``, ``alignment_score``, ``anomaly_indicators`` and ``consistency``.

    Missing, blank or malformed expected text compares as equal.  ``structured``: the frame comes from
    ``join_gold`` with the structure of the expected text.
    """
    df = with_structure(df, sql_col)
    df = with_suspicious_patterns(df, sql_col)
    if expected_col is None:
        nothing = F.lit(None).cast(df.schema["skeleton"].dataType)
        df = df.withColumns({"tree_similarity": _if_formed(F.lit(1.0)), "expected_skeleton": nothing})
    else:
        df, similarity = expected_similarity(df, expected_col, structured)
        df = df.withColumn("tree_similarity", _if_formed(similarity))
        df = df.withColumn("expected_skeleton", F.when(F.col("well_formed"), F.col("expected_skeleton")))
        df = df.drop("expected_tree", "expected_well_formed")
    penalty = F.size("patterns_found") * F.lit(PATTERN_PENALTY)
    df = df.withColumn("alignment_score", _if_formed(F.greatest(F.lit(0.0), F.col("tree_similarity") - penalty)))
    df = df.withColumn(
        "anomaly_indicators",
        F.when(F.col("well_formed"), F.col("patterns_found")).otherwise(F.array(F.lit(PARSE_FAILED))),
    )
    return df.withColumn("consistency", skeleton_consistency(F.col("skeleton"), F.col("expected_skeleton")))


def check_alignment(df: DataFrame, sql_col: str = "sql", expected_col: str | None = None, structured: bool = False) -> DataFrame:
    """The alignment result as one struct column ``alignment``; empty parts are NULL for malformed text."""
    kept = [c for c in df.columns if not (structured and c in EXPECTED_COLUMNS)]
    full = with_alignment(df, sql_col, expected_col, structured)
    formed = F.col("well_formed")
    flags = F.struct(*[F.col(f) for f in PATTERN_LABELS], F.col("patterns_found"))
    return full.select(
        *kept,
        F.struct(
            "alignment_score",
            "tree_similarity",
            F.when(formed, flags).alias("suspicious_patterns"),
            F.struct(F.col("skeleton").alias("generated"), F.col("expected_skeleton").alias("expected")).alias(
                "skeleton_analysis"
            ),
            "anomaly_indicators",
            F.struct(F.col("consistency").alias("skeleton_consistency")).alias("details"),
        ).alias("alignment"),
    )


def _if_formed(value: Column) -> Column:
    return F.when(F.col("well_formed"), value).otherwise(F.lit(0.0))


def skeleton_consistency(generated: Column, expected: Column) -> Column:
    """Five equality checks between two skeletons, their mean, and messages for the first three."""
    checks = {
        "query_type_match": "query_type",
        "where_clause_match": "has_where",
        "join_match": "has_join",
        "aggregate_match": "has_aggregate",
        "table_count_match": "table_count",
    }
    same = {name: generated[field].eqNullSafe(expected[field]) for name, field in checks.items()}
    score = sum((c.cast("int") for c in list(same.values())[1:]), same["query_type_match"].cast("int")) / F.lit(5.0)
    both = generated.isNotNull() & expected.isNotNull()
    return F.when(
        both,
        F.struct(
            *[c.alias(n) for n, c in same.items()],
            F.array_compact(F.array(*[F.when(~same[n], F.lit(m)) for n, m in INCONSISTENCIES.items()])).alias("inconsistencies"),
            score.alias("consistency_score"),
        ),
    )
