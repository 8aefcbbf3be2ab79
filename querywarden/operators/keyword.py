"""Keyword scan: which catalogue rules a text matches, and what follows from the hits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalogue import BUILTIN_RULES, MAX_RULE_WEIGHT, SEVERITY_WEIGHT, UNKNOWN_SEVERITY_WEIGHT, Rule
from ..functions.dialect import listed, matches, regex_literal, squeeze, text_literal
from ..functions.numbers import fixed
from ..functions.staging import pinned

HITS, TEXT, FOLDED = "_kw_hits", "_kw_text", "_kw_folded"


def with_hits(df: DataFrame, sql_col: str, rules: Sequence[Rule]) -> DataFrame:
    """Add the numbers of the matched rules, in catalogue order; everything else is read from them.

    The list is pinned, so each regex runs once per row however many columns are derived from it
    and whatever they are filtered by.  NULL and blank text match nothing.
    """
    df = df.withColumn(TEXT, F.coalesce(F.col(sql_col), F.lit(""))).withColumn(FOLDED, F.expr(squeeze(TEXT)))
    nonblank = matches(TEXT, FOLDED, r"[^\s]")
    hits = []
    for i, r in enumerate(rules):
        hit = matches(TEXT, FOLDED, r.pattern, r.flags, r.needles)
        # A pattern with literals cannot match blank text anyway.
        hits.append((hit if r.needles else f"{nonblank} AND {hit}", str(i)))
    return pinned(df, HITS, listed(hits)).drop(FOLDED)


def _of_hits(values: Sequence[str]) -> str:
    """Per hit, the rule's entry in a list of SQL literals."""
    return f"transform({HITS}, i -> array({', '.join(values)})[i])"


def _labels(rules: Sequence[Rule], field: str) -> str:
    return _of_hits([text_literal(getattr(r, field)) for r in rules])


def risk_score(rules: Sequence[Rule]) -> str:
    """min(1, max(severest hit, summed weight / 0.80)); summed in catalogue order."""
    severities = _of_hits([f"{SEVERITY_WEIGHT.get(r.severity, UNKNOWN_SEVERITY_WEIGHT)!r}D" for r in rules])
    total = f"aggregate({_of_hits([f'{float(r.weight)!r}D' for r in rules])}, 0D, (sum, weight) -> sum + weight)"
    score = f"least(1D, greatest(array_max({severities}), {total} / {MAX_RULE_WEIGHT!r}D))"
    return f"CASE WHEN size({HITS}) > 0 THEN {score} ELSE 0D END"


def recommendation(rules: Sequence[Rule], strict: bool) -> str:
    def any_of(severity: str) -> str:
        numbers = ", ".join(str(i) for i, r in enumerate(rules) if r.severity == severity)
        return f"arrays_overlap({HITS}, array({numbers}))" if numbers else "false"

    high = "REJECT" if strict else "FLAG_FOR_REVIEW"
    return (
        f"CASE WHEN size({HITS}) = 0 THEN 'ALLOW' WHEN {any_of('CRITICAL')} THEN 'REJECT' "
        f"WHEN {any_of('HIGH')} THEN '{high}' ELSE 'FLAG_FOR_REVIEW' END"
    )


def snippet(text: str, rule: Rule) -> str:
    """The first match with up to 10 characters before and 20 after it, on one line.

    The reluctant lead-in makes the regex engine stop at the leftmost match; a dot is one code point.
    """
    around = r"(?s:.{0,10}?)(?:" + rule.pattern + r")(?s:.{0,20})"
    found = f"regexp_extract({text}, {regex_literal(around, rule.flags)}, 0)"
    return f"concat('...', replace({found}, '\\n', ' '), '...')"


def match_details(rules: Sequence[Rule]) -> str:
    """Per hit a struct of the rule's fields and the snippet."""

    def entry(r: Rule) -> str:
        fields = {"rule": r.name, "attack_type": r.attack_type, "severity": r.severity, "description": r.description}
        fixed_part = ", ".join(f"'{k}', {text_literal(v)}" for k, v in fields.items())
        return f"named_struct({fixed_part}, 'snippet', {snippet(TEXT, r)})"

    branches = " ".join(f"WHEN i = {i} THEN {entry(r)}" for i, r in enumerate(rules))
    return f"transform({HITS}, i -> CASE {branches} END)"


def keyword_scan(
    df: DataFrame,
    sql_col: str = "sql",
    extra_rules: Sequence[Rule] = (),
    strict: bool = True,
    prefix: str = "",
) -> DataFrame:
    """Add ``flagged``, ``keyword_risk_score``, ``matched_rules``, ``attack_types_found``,
    ``severities_found``, ``match_details`` and ``recommendation`` (each with ``prefix``).

    ``extra_rules`` follow the built-in catalogue.  Columns that are not selected later are pruned.
    """
    rules = (*BUILTIN_RULES, *extra_rules)
    df = with_hits(df, sql_col, rules)
    columns = {
        "flagged": f"size({HITS}) > 0",
        "keyword_risk_score": risk_score(rules),
        "matched_rules": _labels(rules, "name"),
        "attack_types_found": f"array_distinct({_labels(rules, 'attack_type')})",
        "severities_found": f"array_distinct({_labels(rules, 'severity')})",
        "match_details": match_details(rules),
        "recommendation": recommendation(rules, strict),
    }
    return df.withColumns({prefix + n: F.expr(c) for n, c in columns.items()}).drop(HITS, TEXT)


def keyword_hits(scanned: DataFrame, *keys: str) -> DataFrame:
    """The match details as rows: the keys plus (pos, rule, attack_type, severity, description, snippet)."""
    rows = scanned.select(*keys, F.posexplode("match_details").alias("pos", "hit"))
    return rows.select(*keys, "pos", "hit.*")


def keyword_explain(scanned: DataFrame, out: str = "explanation") -> DataFrame:
    """Add a readable report of a scan's outcome."""
    lines = F.transform(
        "match_details",
        lambda d: F.concat(
            F.lit("     ["), _pad(d["severity"], 8), F.lit("] "), _pad(d["rule"], 40), F.lit(" → "), d["snippet"]
        ),
    )
    head = F.concat(F.lit("🚨 Query FLAGGED — risk score: "), fixed(F.col("keyword_risk_score"), 2))
    text = F.concat_ws(
        "\n",
        head,
        F.concat(F.lit("   Recommendation: "), F.col("recommendation")),
        F.concat(F.lit("   Attack types detected: "), F.array_join("attack_types_found", ", ")),
        F.lit(""),
        F.lit("   Matched rules:"),
        lines,
    )
    passed = F.lit("✅ Query passed all keyword rules — no suspicious patterns detected.")
    return scanned.withColumn(out, F.when(F.col("flagged"), text).otherwise(passed))


def _pad(text: Column, width: int) -> Column:
    """Pad on the right to at least ``width``; longer text stays whole."""
    return F.rpad(text, F.greatest(F.length(text), F.lit(width)), F.lit(" "))
