"""Policy boundary: a second scorer with its own rule book and enforcement ladder."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalogue import (
    ANOMALIES,
    DANGEROUS_FUNCTIONS,
    FORBIDDEN_KEYWORDS,
    POLICY_PATTERNS,
    RECOMMENDATIONS,
    VIOLATION_KINDS,
)
from ..functions.dialect import listed, matches, occurrences, regex_literal, squeeze, text_literal
from ..functions.staging import pinned

FAMILIES = ("forbidden_keywords", "dangerous_functions", "suspicious_patterns", "structural_anomalies")
# Risk added by each non-empty family, in the order of FAMILIES.
FAMILY_RISK = (0.25, 0.25, 0.30, 0.20)
# Finds the same texts, but looks for a comment's end only from the first opener of a line; from every
# opener, a long line of them would take quadratic time.
LINEAR_FORM = {"comment_injection": r"--|#|(?m:^)(?:(?!/\*).)*+/\*.*\*/"}

WB, OPEN, QUOTE = r"\b", r"\s*\(", "'"
WHERE_SLICE = r"WHERE\s+(.+?)(?:GROUP BY|ORDER BY|LIMIT|HAVING|$)"


TEXT, UPPER, LOWER, FOLDED = "_pb_text", "_pb_upper", "_pb_lower", "_pb_folded"


def _violations(mode: str, extra_patterns: Mapping[str, str]) -> dict[str, str]:
    def found(kind: str, name: str) -> str:
        return text_literal(f"{kind} detected: {name}")

    keyword, function, pattern = VIOLATION_KINDS
    keywords = [
        (f"contains({UPPER}, '{k}') AND {UPPER} RLIKE {regex_literal(rf'{WB}{k}{WB}')}", found(keyword, k))
        for k in FORBIDDEN_KEYWORDS[mode]
    ]
    functions = [
        (f"contains({LOWER}, '{f}') AND {LOWER} RLIKE {regex_literal(rf'{WB}{f}{OPEN}')}", found(function, f))
        for f in DANGEROUS_FUNCTIONS[mode]
    ]
    book = [*POLICY_PATTERNS, *((name, regex, "") for name, regex in extra_patterns.items())]
    patterns = [
        (matches(LOWER, FOLDED, LINEAR_FORM.get(name, regex), "i", needles), found(pattern, name)) for name, regex, needles in book
    ]
    where = f"regexp_extract({TEXT}, {regex_literal(WHERE_SLICE, 'is')}, 1)"
    structure = [
        (f"{occurrences(TEXT, ';')} > 1", text_literal(ANOMALIES["statements"])),
        (f"{occurrences(TEXT, '(')} > 10", text_literal(ANOMALIES["nesting"])),
        # The slice cannot be long where the whole text is not.
        (f"length({TEXT}) > 2000 AND length({where}) > 2000", text_literal(ANOMALIES["where"])),
        (f"{occurrences(TEXT, QUOTE)} % 2 != 0", text_literal(ANOMALIES["quotes"])),
    ]
    return dict(zip(FAMILIES, map(listed, (keywords, functions, patterns, structure)), strict=True))


def check_boundaries(
    df: DataFrame,
    sql_col: str = "sql",
    strict: bool = True,
    extra_patterns: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add ``violation_detected``, ``violations``, ``risk_score`` and ``policy_checks``.

    A NULL text cannot be checked and fails closed: violation, risk 1.0, nothing listed.
    """
    checks = _violations("strict" if strict else "lenient", extra_patterns or {})
    df = df.withColumn(TEXT, F.coalesce(F.col(sql_col), F.lit("")))
    df = df.withColumns({UPPER: F.upper(TEXT), LOWER: F.lower(TEXT)})
    df = df.withColumn(FOLDED, F.expr(squeeze(LOWER)))
    df = pinned(df, "policy_checks", "named_struct(" + ", ".join(f"'{n}', {c}" for n, c in checks.items()) + ")")
    family = [F.col("policy_checks")[n] for n in FAMILIES]
    risk = reduce(
        lambda acc, nr: acc + F.when(F.size(nr[0]) > 0, F.lit(nr[1])).otherwise(F.lit(0.0)),
        zip(family, FAMILY_RISK, strict=True),
        F.lit(0.0),
    )
    missing = F.col(sql_col).isNull()
    df = df.withColumn("violations", F.concat(*family))
    df = df.withColumn("risk_score", F.when(missing, F.lit(1.0)).otherwise(F.least(F.lit(1.0), risk)))
    df = df.withColumn("violation_detected", missing | (F.size("violations") > 0))
    return df.drop(TEXT, UPPER, LOWER, FOLDED)


def risk_level(score: Column) -> Column:
    return (
        F.when(score < 0.2, F.lit("LOW"))
        .when(score < 0.5, F.lit("MEDIUM"))
        .when(score < 0.8, F.lit("HIGH"))
        .otherwise(F.lit("CRITICAL"))
    )


def recommendations(violations: Column, score: Column) -> Column:
    n = F.size(violations)
    text = F.array_join(violations, "\n")
    found = F.array_compact(
        F.array(
            F.when(n > 5, F.lit(RECOMMENDATIONS["many"])).when(
                n > 0, F.lit(RECOMMENDATIONS["some"])
            ),
            F.when(score > 0.7, F.lit(RECOMMENDATIONS["risk"])),
            F.when(
                text.contains("DELETE") | text.contains("DROP"),
                F.lit(RECOMMENDATIONS["destructive"]),
            ),
            F.when(F.lower(text).contains("time_delay"), F.lit(RECOMMENDATIONS["time"])),
        )
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(RECOMMENDATIONS["none"])))


def policy_report(checked: DataFrame, sql_col: str = "sql", *keys: str) -> DataFrame:
    """Flat report of checked rows: ``sql_query`` is the whole text, ``sql_shown`` its first 100 characters."""
    sql = F.col(sql_col)
    score = F.col("risk_score")
    return checked.select(
        *keys,
        sql.alias("sql_query"),
        F.when(F.length(sql) > 100, F.concat(F.substring(sql, 1, 100), F.lit("..."))).otherwise(sql).alias("sql_shown"),
        F.size("violations").alias("violations_count"),
        "risk_score",
        risk_level(score).alias("risk_level"),
        "violations",
        recommendations(F.col("violations"), score).alias("recommendations"),
        F.current_timestamp().alias("timestamp"),
    )


def enforcement_action(violated: Column, score: Column) -> Column:
    return (
        F.when(~violated, F.lit("ALLOW"))
        .when(score < 0.3, F.lit("ALLOW_WITH_LOGGING"))
        .when(score < 0.6, F.lit("SANDBOX"))
        .otherwise(F.lit("REJECT"))
    )


def enforce_policy(
    df: DataFrame,
    sql_col: str = "sql",
    level: str = "medium",
    extra_patterns: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add ``allowed``, ``policy_level``, ``violations``, ``risk_score`` and ``action``.

    Only ``strict`` reads the strict lists; any other level reads the lenient ones.
    """
    checked = check_boundaries(df, sql_col, level == "strict", extra_patterns)
    return checked.withColumns(
        {
            "allowed": ~F.col("violation_detected"),
            "policy_level": F.lit(level),
            "action": enforcement_action(F.col("violation_detected"), F.col("risk_score")),
        }
    ).drop("violation_detected", "policy_checks")


def write_quarantine(enforced: DataFrame, path: str) -> None:
    """All rows in one pass, in one folder for the rows that may run (``allowed=true``) and one for the others."""
    enforced.write.partitionBy("allowed").parquet(path)


def split_allowed(enforced: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that may run and the rows to quarantine; together they are all rows.

    Using both frames checks every row twice; ``write_quarantine`` does it once.
    """
    return enforced.filter("allowed"), enforced.filter("NOT allowed")
