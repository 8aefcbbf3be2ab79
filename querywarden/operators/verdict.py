"""Fused verdict: keyword risk and structural risk combined into one action per query."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalogue import (
    REASON_ALIGNMENT,
    REASON_KEYWORD,
    REASON_STRUCTURE,
    REASON_UNPARSED,
    Rule,
)
from ..functions.numbers import fixed, python_list
from ..functions.patterns import with_suspicious_patterns
from ..functions.structure import with_structure
from .alignment import EXPECTED_COLUMNS, expected_similarity
from .keyword import keyword_scan

# How the two signals are weighed.
KEYWORD_WEIGHT = 0.40
STRUCTURE_WEIGHT = 0.60


@dataclass(frozen=True)
class VerdictConfig:
    """Thresholds of the fused filter."""

    ast_alignment_threshold: float = 0.6
    ast_suspicious_weight: float = 0.20
    flag_threshold: float = 0.35
    reject_threshold: float = 0.60


DEFAULT = VerdictConfig()
EVALUATION = VerdictConfig(0.6, 0.35, 0.20, 0.40)


def score(
    df: DataFrame,
    sql_col: str = "sql",
    expected_col: str | None = None,
    config: VerdictConfig = DEFAULT,
    extra_rules: Sequence[Rule] = (),
    structured: bool = False,
) -> DataFrame:
    """Add the verdict columns to any frame of query text; map-only, no shuffle.  ``structured``: the frame comes
    from ``join_gold`` with the structure of the expected text.

    Added: ``action``, ``is_toxic``, ``overall_risk_score``, ``keyword_*`` (5), ``ast_parsed``,
    ``ast_risk_score``, ``ast_alignment_score``, ``ast_suspicious_patterns``, ``ast_skeleton`` and
    ``reasons``.  A NULL text is an error row: risk 1.0 and REJECT, with nothing matched.
    """
    kept = [c for c in df.columns if not (structured and c in EXPECTED_COLUMNS)]
    df = keyword_scan(df, sql_col, extra_rules, strict=False, prefix="_k_")
    df = with_suspicious_patterns(df, sql_col)
    df = with_structure(df, sql_col)
    if expected_col is None:
        similarity = F.lit(1.0)
    else:
        df, similarity = expected_similarity(df, expected_col, structured)

    parsed = F.col("well_formed")
    n_patterns = F.size("patterns_found")
    df = df.withColumn("_align", F.when(parsed, similarity).otherwise(F.lit(0.0)))
    df = df.withColumn(
        "_ast",
        F.when(~parsed, F.lit(1.0)).otherwise(F.least(F.lit(1.0), n_patterns * F.lit(config.ast_suspicious_weight))),
    )
    fused = F.least(
        F.lit(1.0), F.lit(KEYWORD_WEIGHT) * F.col("_k_keyword_risk_score") + F.lit(STRUCTURE_WEIGHT) * F.col("_ast")
    )
    df = df.withColumn("_risk", F.when(F.col(sql_col).isNull(), F.lit(1.0)).otherwise(fused))
    confirmed = (
        F.col("_k_flagged") | ~parsed | (n_patterns > 0) | (F.col("_align") < F.lit(config.ast_alignment_threshold))
    )
    df = df.withColumn(
        "_action",
        F.when(F.col(sql_col).isNull(), F.lit("REJECT"))
        .when((F.col("_risk") >= F.lit(config.reject_threshold)) & confirmed, F.lit("REJECT"))
        .when(F.col("_risk") >= F.lit(config.flag_threshold), F.lit("FLAG_FOR_REVIEW"))
        .otherwise(F.lit("ALLOW")),
    )
    return df.select(
        *kept,
        F.col("_action").alias("action"),
        (F.col("_action") != "ALLOW").alias("is_toxic"),
        F.col("_risk").alias("overall_risk_score"),
        F.col("_k_flagged").alias("keyword_flagged"),
        F.col("_k_keyword_risk_score").alias("keyword_risk_score"),
        F.col("_k_matched_rules").alias("keyword_matched_rules"),
        F.col("_k_attack_types_found").alias("keyword_attack_types"),
        F.col("_k_recommendation").alias("keyword_recommendation"),
        F.col("well_formed").alias("ast_parsed"),
        F.col("_ast").alias("ast_risk_score"),
        F.col("_align").alias("ast_alignment_score"),
        F.col("patterns_found").alias("ast_suspicious_patterns"),
        F.col("skeleton").alias("ast_skeleton"),
        _reasons(config).alias("reasons"),
    )


def _reasons(config: VerdictConfig) -> Column:
    threshold = F.lit(f"{config.ast_alignment_threshold:.2f}")
    return F.array_compact(
        F.array(
            F.when(~F.col("well_formed"), F.lit(REASON_UNPARSED)).when(
                F.col("_align") < F.lit(config.ast_alignment_threshold),
                F.concat(F.lit(REASON_ALIGNMENT[0]), fixed(F.col("_align"), 2), F.lit(REASON_ALIGNMENT[1]), threshold),
            ),
            F.when(
                F.col("_k_flagged"),
                F.concat(
                    F.lit(REASON_KEYWORD[0]),
                    F.array_join("_k_matched_rules", ", "),
                    F.lit(REASON_KEYWORD[1]),
                    F.col("_k_recommendation"),
                ),
            ),
            F.when(
                F.size("patterns_found") > 0,
                F.concat(F.lit(REASON_STRUCTURE), python_list(F.col("patterns_found"))),
            ),
        )
    )


def batch_score(
    df: DataFrame, sql_key: str = "sql", nlq_key: str = "nlq", config: VerdictConfig = DEFAULT
) -> DataFrame:
    """Score a frame with configurable column names; a missing column reads as empty text."""
    for key in (sql_key, nlq_key):
        if key not in df.columns:
            df = df.withColumn(key, F.lit(""))
    return score(df, sql_key, config=config)


def verdict_explain(scored: DataFrame, out: str = "explanation") -> DataFrame:
    """Add a readable report of each verdict."""
    icon = (
        F.when(F.col("action") == "ALLOW", F.lit("✅"))
        .when(F.col("action") == "FLAG_FOR_REVIEW", F.lit("⚠️"))
        .otherwise(F.lit("🚨"))
    )
    head = F.concat(
        icon, F.lit(" Action: "), F.col("action"), F.lit("  (risk="), fixed(F.col("overall_risk_score"), 2), F.lit(")\n")
    )
    reasons = F.when(
        F.size("reasons") > 0,
        F.concat(F.lit("  Reasons:\n    • "), F.array_join("reasons", "\n    • "), F.lit("\n")),
    )
    keyword = F.when(
        F.col("keyword_flagged"),
        F.concat(
            F.lit("  [Stage 1 – Keyword] risk="),
            fixed(F.col("keyword_risk_score"), 2),
            F.lit(", rules="),
            python_list(F.col("keyword_matched_rules")),
            F.lit(", attack_types="),
            python_list(F.col("keyword_attack_types")),
        ),
    )
    structure = F.when(
        F.col("ast_parsed"),
        F.concat(
            F.lit("  [Stage 2 – AST] alignment="),
            fixed(F.col("ast_alignment_score"), 2),
            F.lit(", suspicious="),
            python_list(F.col("ast_suspicious_patterns")),
        ),
    ).otherwise(F.lit("  [Stage 2 – AST] parse FAILED (query not valid SQL)"))
    return scored.withColumn(out, F.concat_ws("\n", head, reasons, keyword, structure))


def evaluation_rows(scored: DataFrame, sql_col: str = "query", nlq_col: str = "question", label_col: str = "toxic", id_col: str = "id") -> DataFrame:
    """Flatten scored rows to the evaluation layout, with the lists comma-joined."""
    optional = [c for c in (id_col, "split", "attack") if c in scored.columns]
    return scored.select(
        *optional,
        F.coalesce("db_id", F.lit("")).alias("db_id"),
        F.col(label_col).alias("label"),
        F.col("overall_risk_score").alias("score"),
        "is_toxic",
        "action",
        F.array_join("keyword_matched_rules", ",").alias("kw_rules"),
        F.array_join("keyword_attack_types", ",").alias("kw_types"),
        F.array_join("ast_suspicious_patterns", ",").alias("ast_patt"),
        F.col(sql_col).alias("sql"),
        F.coalesce(F.col(nlq_col), F.lit("")).alias("nlq"),
        F.col("is_toxic").cast("int").alias("pred_hard"),
        "keyword_risk_score",
        "ast_risk_score",
    )


def with_detectors(df: DataFrame, detectors: Mapping[str, Callable[[Column], Column]], sql_col: str = "sql") -> DataFrame:
    """Add one column per custom detector; a detector is any function from the text column to a column."""
    return df.withColumns({name: fn(F.col(sql_col)) for name, fn in detectors.items()})
