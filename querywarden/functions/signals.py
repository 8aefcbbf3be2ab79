"""Further text signals and the weighted overall score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import java_regex
from .numbers import ratio


@dataclass(frozen=True)
class OverallConfig:
    """Thresholds of the anomaly rule; the presets below change some of them."""

    overall: float = 0.60
    ast_align: float = 0.60
    semantic_align: float = 0.65
    stealth: float = 0.70
    policy_strict: bool = True


STANDARD = OverallConfig()
LENIENT = OverallConfig(ast_align=0.5, semantic_align=0.55, policy_strict=False)
STRICT = OverallConfig(ast_align=0.75, semantic_align=0.75, policy_strict=True)


def overall_score(ast: Column, semantic: Column, policy_risk: Column, stealth: Column) -> Column:
    """0.35·ast + 0.35·semantic + 0.20·(1 − policy) + 0.10·(1 − stealth)."""
    return (
        F.lit(0.35) * ast
        + F.lit(0.35) * semantic
        + F.lit(0.20) * (F.lit(1.0) - policy_risk)
        + F.lit(0.10) * (F.lit(1.0) - stealth)
    )


def is_anomaly(
    overall: Column, ast: Column, semantic: Column, violated: Column, stealth: Column, config: OverallConfig = STANDARD
) -> Column:
    return (
        (overall < config.overall)
        | (ast < config.ast_align)
        | (semantic < config.semantic_align)
        | violated
        | (stealth > config.stealth)
    )


def _entropy(counts: Column) -> Column:
    """Shannon entropy in bits from the counts c of each value: log2 n − Σ c·log2 c / n."""

    def add(acc: Column, c: Column) -> Column:
        return F.struct((acc["n"] + c).alias("n"), (acc["s"] + c * F.log2(c)).alias("s"))

    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"))
    return F.aggregate(
        counts, start, add, lambda acc: F.when(acc["n"] > 0, F.log2(acc["n"]) - acc["s"] / acc["n"]).otherwise(F.lit(0.0))
    )


def _runs(sorted_text: Column, unit: str) -> Column:
    """The runs of one repeated unit in a text whose units are sorted, so equal ones are neighbours."""
    return F.regexp_extract_all(sorted_text, F.lit(java_regex(rf"({unit})\1*", "s")), F.lit(0))


def char_entropy(text: Column) -> Column:
    """Entropy of the characters: sorted, cut into runs of the same one, and only the runs summed up."""
    runs = _runs(F.array_join(F.sort_array(F.split(text, "")), ""), ".")
    return _entropy(F.transform(runs, lambda run: F.length(run).cast("double")))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(java_regex(r"\w+")), F.lit(0))


def token_entropy(text: Column) -> Column:
    """Entropy of the words, in the same way; every word is followed by one space."""
    words = F.sort_array(tokens(text))
    runs = _runs(F.concat(F.array_join(words, " "), F.lit(" ")), "[^ ]+ ")
    return _entropy(F.transform(runs, lambda run: (F.length(run) - F.length(F.replace(run, F.lit(" "), F.lit("")))).cast("double")))


def length_ratio(sql: Column, nlq: Column) -> Column:
    return ratio(F.length(sql), F.length(nlq))


def keyword_overlap(sql: Column, nlq: Column) -> Column:
    """Share of the question's distinct words of three or more letters that the SQL also contains."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(nlq), F.lit(java_regex(r"\w{3,}")), F.lit(0)))
    return ratio(F.size(F.array_intersect(words, tokens(F.lower(sql)))), F.size(words))


# Our choice of what counts as each kind of trigger.
NON_ASCII = r"[^\x{0}-\x{7F}]"
HTML_ENTITY = r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);"
ODD_SPACE = r"[\x{9}\x{B}\x{C}\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def char_triggers(text: Column) -> dict[str, Column]:
    """Flags for characters that generated SQL has little reason to hold."""
    return {
        "has_non_ascii": text.rlike(java_regex(NON_ASCII)),
        "has_html_entity": text.contains("&") & text.rlike(java_regex(HTML_ENTITY)),
        "has_odd_space": text.rlike(java_regex(ODD_SPACE)),
    }


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two numeric arrays; NULL for different lengths, 0 for a zero vector."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)

    x, y = a.cast("array<double>"), b.cast("array<double>")
    norm = F.sqrt(dot(x, x) * dot(y, y))
    return F.when(F.size(a) == F.size(b), F.when(norm > 0, dot(x, y) / norm).otherwise(F.lit(0.0)))
