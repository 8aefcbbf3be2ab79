"""Projection barriers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pinned(df: DataFrame, name: str, expression: str) -> DataFrame:
    """Add a column that is computed once per row, whatever is done with it later.

    A filter on a derived column is normally pushed through the projections below it, which copies
    their expressions into the filter: regexes run twice, and chains of reused columns grow
    exponentially.  Exploding a one-element array keeps exactly one row per row, and filters on its
    output stay above it, while filters on other columns still reach the scan.
    """
    return df.select("*", F.explode(F.array(F.expr(expression))).alias(name))
