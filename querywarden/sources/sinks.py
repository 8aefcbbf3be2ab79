"""Sinks for evaluation results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import fixed

# Field order of the two row layouts and the text limits of the tabular one.
SLIM_FIELDS = (
    "split", "db_id", "label", "score", "action", "kw_rules", "kw_types", "ast_patt", "pred_sweep", "pred_hard",
)
CSV_FIELDS = (
    "split", "db_id", "label", "score", "action", "pred_sweep", "pred_hard",
    "kw_rules", "kw_types", "ast_patt", "sql", "nlq",
)
CSV_LIMITS = {"kw_rules": 200, "kw_types": 100, "ast_patt": 200, "sql": 500, "nlq": 200}


def slim_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """The ten result fields without the texts."""
    return rows.select(*keys, *SLIM_FIELDS)


def csv_rows(rows: DataFrame, *keys: str, shorten: bool = False) -> DataFrame:
    """The tabular layout: score with four decimals, whole texts unless they are to be shortened."""
    shaped = {name: F.coalesce(name, F.lit("")) for name in CSV_LIMITS}
    if shorten:
        shaped = {name: F.substring(shaped[name], 1, limit) for name, limit in CSV_LIMITS.items()}
    shaped["score"] = fixed(F.col("score"), 4)
    return rows.select(*keys, *[shaped.get(f, F.col(f)).alias(f) for f in CSV_FIELDS])


def write_csv(rows: DataFrame, path: str, shorten: bool = False) -> None:
    """Write the tabular layout as CSV part files with headers and doubled quotes."""
    options = {
        "header": True,
        "escape": '"',
        "emptyValue": "",
        "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False,
    }
    csv_rows(rows, shorten=shorten).write.options(**options).csv(path)


def write_report(report: DataFrame, rows: DataFrame, path: str) -> None:
    """Write the one-row report and, next to it, the slim rows as their own dataset."""
    report.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(f"{path}/report")
    slim_rows(rows).write.json(f"{path}/rows")
