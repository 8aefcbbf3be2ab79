"""Suspicious-pattern flags: plain substring tests on the raw, lower-cased text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue import PATTERN_LABELS
from .dialect import listed, occurrences, text_literal


def pattern_flags(lower: str) -> dict[str, str]:
    """Condition per flag, as SQL text over the lower-cased column."""

    def has(*parts: str) -> str:
        return "(" + " OR ".join(f"contains({lower}, {text_literal(p)})" for p in parts) + ")"

    return {
        "has_comment_injection": has("--", "/*"),
        "has_tautology": has("1=1", "'1'='1'", "true"),
        "has_time_delay": has("sleep", "delay", "pg_sleep", "waitfor"),
        "has_piggy_back": f"{occurrences(lower, ';')} > 1",
        "has_union_select": f"{has('union')} AND {has('select')} AND {has('null', '--', 'information_schema')}",
    }


def with_suspicious_patterns(df: DataFrame, sql_col: str = "sql") -> DataFrame:
    """Add the five ``has_*`` flags and ``patterns_found``, their labels in fixed order."""
    df = df.withColumn("_lower", F.lower(F.coalesce(F.col(sql_col), F.lit(""))))
    df = df.withColumns({n: F.expr(c) for n, c in pattern_flags("_lower").items()}).drop("_lower")
    return df.withColumn("patterns_found", F.expr(listed([(f, text_literal(t)) for f, t in PATTERN_LABELS.items()])))
