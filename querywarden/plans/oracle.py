"""The registered queries once more as DuckDB SQL, for checking results side by side.

The SQL is written from the operators' definitions, not from the Spark plans: rules are matched
one by one without pre-tests, the split ranks every row, and the sweep compares every row with
every threshold.  Patterns and word lists are shared with the package because they are fixed.
"""

from __future__ import annotations

import math

from ..functions.catalogue import (
    BUILTIN_RULES, DANGEROUS_FUNCTIONS, FORBIDDEN_KEYWORDS, PATTERN_LABELS, POLICY_PATTERNS, SEVERITY_WEIGHT, Rule,
)
from ..functions.dialect import SPACE as NEAR_SPACE, WIDE_SPACE, WORD
from ..functions.structure import SKELETON_FIELDS, TREE_FEATURES
from .queries import EXTRA_PATTERNS, EXTRA_RULES, WATCHED
from .querylog import BASE, MESSY_TEMPLATES, TEMPLATES


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def ctes(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts)


SPACE = NEAR_SPACE + WIDE_SPACE

# ---- patterns ----------------------------------------------------------------------------------


def _classes(pattern: str, boundaries: bool) -> str:
    """Spell out the space and word classes; RE2 knows only the ASCII ones."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in (r"\s", r"\w"):
            body = SPACE if two == r"\s" else WORD
            out.append(body if in_class else f"[{body}]")
            i += 2
            continue
        if two == r"\b" and boundaries:
            before = i == 0 or pattern[i - 1] in "|(" or pattern[i - 1] == "}"
            if i > 0 and pattern[i - 1] == "'":
                out.append(f"[{WORD}]")
            elif before:
                out.append(f"(?:^|[^{WORD}])")
            else:
                out.append(f"(?:$|[^{WORD}])")
            i += 2
            continue
        if len(two) == 2 and two[0] == "\\":
            out.append(two)
            i += 2
            continue
        in_class = (in_class or pattern[i] == "[") and pattern[i] != "]"
        out.append(pattern[i])
        i += 1
    return "".join(out)


# Both rules below have a boundary on each side of a gap, which has to be spelt out without lookaround.
_SPELT_OUT = {
    "union_select_info_schema": rf"(?:^|[^{WORD}])UNION\s+(?:ALL\s+)?SELECT(?:[^{WORD}]|[^{WORD}].{{0,118}}[^{WORD}])"
    rf"information_schema(?:$|[^{WORD}])",
    "union_select_then_comment": rf"(?:^|[^{WORD}])UNION\s+(?:ALL\s+)?SELECT(?:|[^{WORD}].{{0,199}})--",
}


def re2(rule: Rule, unicode: bool) -> str:
    if not unicode:
        return rule.pattern
    if rule.name in _SPELT_OUT:
        return _classes(_SPELT_OUT[rule.name], False)
    return _classes(rule.pattern, True)


def flagged(pattern: str, flags: str) -> str:
    """Flags inside the pattern: DuckDB's own flag letters differ."""
    return lit((f"(?{flags})" if flags else "") + pattern)


# ---- shared parts ------------------------------------------------------------------------------

_VALUES = ", ".join(f"({i}, $${t}$$, {toxic}, {lit(attack)})" for i, (t, toxic, attack) in enumerate(TEMPLATES))


def _filled(template: str, c: str = "o_custkey", k: str = "o_orderkey") -> str:
    return f"replace(replace({template}, '{{c}}', {c}::VARCHAR), '{{k}}', {k}::VARCHAR)"


LOG = (
    f"templates(tid, template, toxic, attack) AS (VALUES {_VALUES}), "
    "log AS (SELECT o_orderkey AS id, tid, 'db_' || o_orderstatus AS db_id, "
    "'Which orders were placed by customer ' || o_custkey::VARCHAR AS question, toxic, attack, "
    f"{_filled('template')} AS sql FROM orders JOIN templates ON o_orderkey % {len(TEMPLATES)} = tid)"
)
_MESSY_VALUES = ", ".join(f"({i}, $${t}$$)" for i, t in enumerate(MESSY_TEMPLATES))
MESSY = (
    f"templates(tid, template) AS (VALUES {_MESSY_VALUES}), log AS (SELECT o_orderkey AS id, "
    f"{_filled('template')} AS sql FROM orders JOIN templates ON o_orderkey % {len(MESSY_TEMPLATES)} = tid)"
)
GOLD = (
    "gold AS (SELECT CASE WHEN o_custkey % 10 = 7 THEN 'none' ELSE 'db_' || o_orderstatus END AS db_id, "
    "'Which orders were placed by customer ' || o_custkey::VARCHAR AS question, "
    f"min({_filled('$$' + BASE + '$$')}) AS gold_sql FROM orders GROUP BY ALL)"
)


def texts(table: str, keys: str, text: str) -> str:
    return f"log AS (SELECT {keys}, {text} AS sql FROM {table})"


def joined(pairs: list[tuple[str, str]], sep: str = ",") -> str:
    """Labels whose condition holds, joined in order; empty text if none."""
    return f"concat_ws({lit(sep)}, " + ", ".join(f"CASE WHEN {cond} THEN {lit(label)} END" for cond, label in pairs) + ")"


def hits_cte(rules=BUILTIN_RULES, unicode: bool = False, keep: str = "*", src: str = "log") -> str:
    cols = ", ".join(
        f"(regexp_matches(sql, {flagged(re2(r, unicode), r.flags)})) AS h{i}" for i, r in enumerate(rules)
    )
    return f"hits AS MATERIALIZED (SELECT {keep}, {cols} FROM {src})"


def scan_cols(rules=BUILTIN_RULES, strict: bool = True) -> dict[str, str]:
    n = range(len(rules))

    def firsts(attr: str) -> str:
        """Distinct values in order of first hit."""
        values = list(dict.fromkeys(getattr(r, attr) for r in rules))
        any_of = {v: " OR ".join(f"h{i}" for i in n if getattr(rules[i], attr) == v) for v in values}
        first = {v: "least(" + ", ".join(f"CASE WHEN h{i} THEN {i} ELSE 999 END" for i in n if getattr(rules[i], attr) == v) + ", 999)" for v in values}
        structs = ", ".join(f"CASE WHEN {any_of[v]} THEN {{'p': {first[v]}, 'v': {lit(v)}}} END" for v in values)
        return f"array_to_string(list_transform(list_sort(list_filter([{structs}], lambda s: s IS NOT NULL)), lambda s: s.v), ',')"

    any_hit = "(" + " OR ".join(f"h{i}" for i in n) + ")"
    total = " + ".join(f"CASE WHEN h{i} THEN {rules[i].weight}::DOUBLE ELSE 0::DOUBLE END" for i in n)
    worst = "greatest(" + ", ".join(f"CASE WHEN h{i} THEN {SEVERITY_WEIGHT.get(rules[i].severity, .15)}::DOUBLE ELSE 0::DOUBLE END" for i in n) + ")"

    def has(sev: str) -> str:
        return "(" + (" OR ".join(f"h{i}" for i in n if rules[i].severity == sev) or "false") + ")"

    return {
        "flagged": f"{any_hit}::INT",
        "matched_rules": joined([(f"h{i}", rules[i].name) for i in n]),
        "attack_types": firsts("attack_type"),
        "severities": firsts("severity"),
        "risk": f"round(CASE WHEN {any_hit} THEN least(1::DOUBLE, greatest({worst}, ({total}) / 0.8::DOUBLE)) ELSE 0::DOUBLE END, 6)",
        "recommendation": f"CASE WHEN {has('CRITICAL')} THEN 'REJECT' WHEN {has('HIGH')} THEN "
        f"{lit('REJECT' if strict else 'FLAG_FOR_REVIEW')} WHEN {any_hit} THEN 'FLAG_FOR_REVIEW' ELSE 'ALLOW' END",
    }


def raw_risk() -> str:
    """The keyword risk before rounding."""
    return scan_cols()["risk"].removeprefix("round(").removesuffix(", 6)")


def aliased(cols: dict[str, str]) -> str:
    return ", ".join(f"{expr} AS {name}" for name, expr in cols.items())


def scan_sql(source: str, keys: str, rules=BUILTIN_RULES, unicode: bool = False) -> str:
    return f"{ctes(source, hits_cte(rules, unicode))} SELECT {keys}, {aliased(scan_cols(rules))} FROM hits"


def pattern_conditions(text: str = "sql") -> dict[str, str]:
    low = f"lower({text})"

    def has(*parts: str) -> str:
        return "(" + " OR ".join(f"contains({low}, {lit(p)})" for p in parts) + ")"

    return {
        "has_comment_injection": has("--", "/*"),
        "has_tautology": has("1=1", "'1'='1'", "true"),
        "has_time_delay": has("sleep", "delay", "waitfor"),
        "has_piggy_back": f"(length({text}) - length(replace({text}, ';', '')) > 1)",
        "has_union_select": f"({has('union')} AND {has('select')} AND {has('null', '--', 'information_schema')})",
    }


# ---- text and structure ------------------------------------------------------------------------


def sub(text: str, pattern: str, to: str, flags: str = "") -> str:
    return f"regexp_replace({text}, {flagged(_classes(pattern, False), flags)}, {lit(to)}, 'g')"


def count(text: str, pattern: str, flags: str = "is") -> str:
    return f"len(regexp_extract_all({text}, {flagged(_classes(pattern, False), flags)}))"


def clean_ctes(src: str = "log", out: str = "cleaned", text: str = "sql", p: str = "") -> str:
    c = f"{p}c"
    return (
        f"{out}1 AS (SELECT *, {sub(sub(f'trim({sub(text, chr(92) + chr(115) + chr(43), chr(32))})', TAIL_NUMBER, '', 'i'), TAIL_STRING, '', 'i')} AS {c}1 FROM {src}), "
        f"{out}2 AS (SELECT *, string_split({c}1, '\"') AS {c}q FROM {out}1), "
        f"{out}3 AS (SELECT *, array_to_string(list_transform({c}q, lambda x, i: CASE WHEN i % 2 = 1 THEN x "
        f"WHEN i = len({c}q) THEN '\"' || x ELSE '''' || replace(x, '''', '''''') || '''' END), '') AS {c}2 FROM {out}2), "
        f"{out}4 AS (SELECT *, {sub(sub(sub(sub(f'{c}2', '(?i)intersect'.join([WB, WB]), 'INTERSECT'), '(?i)union'.join([WB, WB]), 'UNION'), OR_END, '', 'i'), OR_SEMI, '; ', 'i')} AS {c}3 FROM {out}3), "
        f"{out}5 AS (SELECT *, string_split({c}3, ')') AS {c}p FROM {out}4), "
        f"{out}6 AS (SELECT *, CASE WHEN len({c}p) - 1 > length({c}3) - length(replace({c}3, '(', '')) THEN "
        f"trim(array_to_string({c}p[1:list_max(list_filter(range(1, len({c}p) + 1), lambda n: n - 1 <= "
        f"length(array_to_string({c}p[1:n], ')')) - length(replace(array_to_string({c}p[1:n], ')'), '(', ''))))], ')')) "
        f"ELSE {c}3 END AS {c}4 FROM {out}5), "
        f"{out}7 AS (SELECT *, trim({sub(f'{c}4', SPACES, ' ')}) AS {p}clean FROM {out}6), "
        f"{out}8 AS (SELECT *, regexp_replace({p}clean, {lit(MASK)}, ' \\1\\1 ', 'g') AS {p}mask FROM {out}7), "
        f"{out} AS MATERIALIZED (SELECT *, ({well_formed(p + 'mask')}) AS {p}wf FROM {out}8)"
    )


SPACES = r"\s+"
TAIL_NUMBER = r";?\s*OR\s+1\s*=\s*1\s*;?$"
TAIL_STRING = r";?\s*OR\s+'[^']+'\s*=\s*'[^']+'\s*;?$"
OR_END = r"\bOR\s*$"
OR_SEMI = r";\s*OR\s+"
WB = r"\b"
MASK = r"(?s)(')(?:[^']|'')*'|--.*|/\*.*?\*/"


def well_formed(mask: str) -> str:
    def n(ch: str) -> str:
        return f"(length({mask}) - length(replace({mask}, {lit(ch)}, '')))"

    return f"trim({mask}) != '' AND {n('(')} = {n(')')} AND {n(chr(39))} % 2 = 0"


AGG = r"\b(?:COUNT|SUM|AVG|MIN|MAX|STDDEV\w*|VAR\w*|ARRAY_AGG|STRING_AGG|GROUP_CONCAT|MEDIAN)\s*\("
FROM_LIST = (
    r"\bFROM\b([^()]*?)(?:\b(?:WHERE|GROUP|ORDER|HAVING|LIMIT|UNION|INTERSECT|EXCEPT|LEFT|RIGHT|FULL|INNER|CROSS|NATURAL|JOIN|ON)\b|[()]|$)"
)
WHERE_PART = r"\bWHERE\b(.*?)(?:\b(?:GROUP|ORDER|HAVING|LIMIT|UNION|INTERSECT|EXCEPT)\b|$)"


def group(text: str, pattern: str) -> str:
    return f"regexp_extract({text}, {flagged(_classes(pattern, False), 'is')}, 1)"


def structure_ctes(src: str, out: str, p: str = "") -> str:
    f, r, raw, key = f"{p}f", f"{p}r", f"{p}raw", f"{p}key"
    inner = r"'\([^()]*\)'"
    # A query wrapped as a whole is empty without its parentheses; then those around it come off.
    flat = f"CASE WHEN trim({raw}) = '' THEN regexp_replace(trim({f}, '( )'), {inner}, '', 'g') ELSE {raw} END"
    whole = f"{p}whole"
    main = f"CASE WHEN {whole} ILIKE 'with %' THEN regexp_replace({whole}, {flagged(WITH_PART, 'is')}, '\\1') ELSE {whole} END"
    slices = f"array_to_string(regexp_extract_all({f}, {flagged(_classes(FROM_LIST, False), 'is')}, 1), '|')"
    tree = {
        "node_count": count(f, r"\w+|[^\s\w]"),
        "select_count": count(f, r"\bSELECT\b"),
        "where_count": count(f, r"\bWHERE\b"),
        "join_count": count(f, r"\bJOIN\b"),
        "aggregate_count": count(f, AGG),
        "subquery_count": count(f, r"\(\s*SELECT\b"),
        "union_count": count(f, r"\b(?:UNION|INTERSECT|EXCEPT)\b"),
        "table_count": f"{count(f, chr(92) + 'b(?:FROM|JOIN)' + chr(92) + 's+[A-Za-z_]')} + {count(slices, ',' + chr(92) + 's*[A-Za-z_]')}",
        "query_type": f"CASE WHEN {group(r, LAST_OP)} != '' THEN {initcap(group(r, LAST_OP))} WHEN upper({group(r, VERB)}) IN "
        f"('SELECT', 'INSERT', 'UPDATE', 'DELETE') THEN upper({group(r, VERB)}) ELSE {initcap(group(r, VERB))} END",
    }
    where = group(f, WHERE_PART)
    sel = f"{p}t_query_type = 'SELECT'"

    def some(feature: str) -> str:
        return f"({sel} AND {p}t_{feature} > 0)"

    skeleton = {
        "query_type": f"{p}t_query_type",
        "main_clauses": "''",
        "has_where": f"{some('where_count')}::INT",
        "has_subquery": f"{some('subquery_count')}::INT",
        "has_union": f"{some('union_count')}::INT",
        "has_join": f"{some('join_count')}::INT",
        "has_aggregate": f"{some('aggregate_count')}::INT",
        "table_count": f"CASE WHEN {sel} THEN {p}t_table_count ELSE 0 END",
        "column_count": f"CASE WHEN {sel} THEN {count(group(r, SELECT_PART), ',')} + 1 ELSE 0 END",
        "condition_complexity": f"CASE WHEN {some('where_count')} THEN {count(where, ANDOR)} - {count(where, BTW)} ELSE 0 END",
        "clause_order": f"CASE WHEN {some('where_count')} THEN 'WHERE' ELSE '' END",
    }
    return (
        f"{out}1 AS (SELECT *, trim(string_split({p}mask, ';')[1]) AS {f} FROM {src}), "
        f"{out}1k AS MATERIALIZED (SELECT *, row_number() OVER () AS {key} FROM {out}1), "
        f"{out}1r AS (SELECT {key}, {f} AS {raw} FROM {out}1k UNION ALL SELECT {key}, regexp_replace({raw}, {inner}, '', 'g') FROM {out}1r WHERE regexp_matches({raw}, {inner})), "
        f"{out}1f AS (SELECT {out}1k.*, {out}1r.{raw} FROM {out}1k LEFT JOIN {out}1r ON {out}1k.{key} = {out}1r.{key} AND NOT regexp_matches({out}1r.{raw}, {inner})), "
        f"{out}1g AS (SELECT *, {flat} AS {whole} FROM {out}1f), "
        f"{out}2 AS (SELECT * EXCLUDE ({whole}), {main} AS {r} FROM {out}1g), "
        f"{out}3 AS MATERIALIZED (SELECT *, {', '.join(f'{e} AS {p}t_{n}' for n, e in tree.items())} FROM {out}2), "
        f"{out} AS (SELECT *, {', '.join(f'CASE WHEN {p}wf THEN {e} END AS {p}s_{n}' for n, e in skeleton.items())} FROM {out}3)"
    )


LAST_OP = r"^.*\b(UNION|INTERSECT|EXCEPT)\b"
VERB = r"^\(*\s*(\w+)"
WITH_PART = r"^.*?\b(SELECT|INSERT|UPDATE|DELETE)\b"
SELECT_PART = r"^\s*SELECT\s+(.*?)(?:\bFROM\b|$)"
ANDOR = r"\b(?:AND|OR|NOT)\b"
BTW = r"\bBETWEEN\b"


def initcap(text: str) -> str:
    return f"(upper(left({text}, 1)) || lower(substr({text}, 2)))"


# ---- verdict -----------------------------------------------------------------------------------


def verdict_ctes(src: str, out: str, weight: float, flag: float, reject: float, similarity: str = "1::DOUBLE", unicode: bool = False) -> str:
    """From a relation with sql, mask and wf to the fused columns."""
    cols = scan_cols(strict=False)
    pats = pattern_conditions()
    n = " + ".join(f"({c})::INT" for c in pats.values())
    labels = joined([(c, PATTERN_LABELS[k]) for k, c in pats.items()])
    shown = joined([(c, PATTERN_LABELS[k]) for k, c in pats.items()], "', '")
    kw = aliased({f"k_{k}": v for k, v in cols.items()})
    return (
        f"{hits_cte(unicode=unicode, src=src)}, "
        f"{out}1 AS MATERIALIZED (SELECT *, {kw}, {raw_risk()} AS kr, {n} AS np, {labels} AS patt, {shown} AS shown, "
        f"CASE WHEN wf THEN {similarity} ELSE 0::DOUBLE END AS al FROM hits), "
        f"{out}2 AS (SELECT *, CASE WHEN wf IS NOT TRUE THEN 1::DOUBLE ELSE least(1::DOUBLE, np * {weight}::DOUBLE) END AS ar FROM {out}1), "
        f"{out}3 AS (SELECT *, CASE WHEN sql IS NULL THEN 1::DOUBLE ELSE least(1::DOUBLE, 0.4::DOUBLE * kr + 0.6::DOUBLE * ar) END AS risk FROM {out}2), "
        f"{out} AS MATERIALIZED (SELECT *, CASE WHEN sql IS NULL OR (risk >= {reject}::DOUBLE AND (k_flagged = 1 OR wf IS NOT TRUE OR np > 0 OR al < 0.6::DOUBLE)) "
        f"THEN 'REJECT' WHEN risk >= {flag}::DOUBLE THEN 'FLAG_FOR_REVIEW' ELSE 'ALLOW' END AS action FROM {out}3)"
    )


REASONS = (
    "concat_ws('; ', CASE WHEN NOT wf THEN 'SQL could not be parsed — possibly malformed/injected' "
    "WHEN al < 0.6::DOUBLE THEN 'AST alignment ' || printf('%.2f', al) || ' < threshold 0.60' END, "
    "CASE WHEN k_flagged = 1 THEN 'Keyword gate: ' || replace(k_matched_rules, ',', ', ') || ' → ' || k_recommendation END, "
    "CASE WHEN np > 0 THEN 'AST structural anomalies: [''' || shown || ''']' END)"
)
VERDICT = {
    "action": "action",
    "is_toxic": "(action != 'ALLOW')::INT",
    "overall_risk_score": "round(risk, 6)",
    "keyword_flagged": "k_flagged",
    "keyword_risk_score": "k_risk",
    "keyword_matched_rules": "k_matched_rules",
    "keyword_attack_types": "k_attack_types",
    "keyword_recommendation": "k_recommendation",
    "ast_parsed": "wf::INT",
    "ast_alignment_score": "round(al, 6)",
    "ast_suspicious_patterns": "patt",
    "reasons": REASONS,
}
DEFAULTS, EVAL = (0.20, 0.35, 0.60), (0.35, 0.20, 0.40)
SIMILARITY = "(" + " + ".join(f"(t_{f} IS NOT DISTINCT FROM e_t_{f})::INT" for f in TREE_FEATURES) + ") / 9::DOUBLE"
GOLD_JOIN = "paired AS (SELECT log.*, gold_sql AS expected_sql FROM log LEFT JOIN gold USING (db_id, question))"
WITH_GOLD = ", ".join(
    [
        LOG, GOLD, GOLD_JOIN,
        clean_ctes("paired", "cl"), structure_ctes("cl", "st"),
        clean_ctes("st", "ecl", "expected_sql", "e_"), structure_ctes("ecl", "both_sides", "e_"),
    ]
)
USABLE_SIMILARITY = f"CASE WHEN e_wf AND expected_sql != '' THEN {SIMILARITY} ELSE 1::DOUBLE END"


def fused(settings: tuple[float, float, float], base: str = LOG, unicode: bool = False) -> str:
    return ctes(base, clean_ctes("log", "cl"), verdict_ctes("cl", "v", *settings, unicode=unicode))


# ---- policy ------------------------------------------------------------------------------------


def policy_lists(mode: str, extra: dict[str, str] | None = None, unicode: bool = False) -> dict[str, list[tuple[str, str]]]:
    def n(ch: str) -> str:
        return f"(length(sql) - length(replace(sql, {lit(ch)}, '')))"

    edge = (rf"(?:^|[^{WORD}])", rf"(?:$|[^{WORD}])", f"[{SPACE}]*") if unicode else (r"\b", r"\b", r"\s*")
    book = [(name, regex) for name, regex, _ in POLICY_PATTERNS] + list((extra or {}).items())
    return {
        "forbidden_keywords": [
            (f"regexp_matches(upper(sql), {lit(edge[0] + k + (edge[1] if not k.endswith('_') or unicode else WB))})", f"Forbidden keyword detected: {k}")
            for k in FORBIDDEN_KEYWORDS[mode]
        ],
        "dangerous_functions": [
            (f"regexp_matches(lower(sql), {lit(edge[0] + f + edge[2] + chr(92) + '(')})", f"Dangerous function detected: {f}")
            for f in DANGEROUS_FUNCTIONS[mode]
        ],
        "suspicious_patterns": [
            # DuckDB lets a dot match a newline unless told otherwise.
            (f"regexp_matches(lower(sql), {flagged(_classes(regex, False), 'i')}, 'n')", f"Suspicious pattern detected: {name}")
            for name, regex in book
        ],
        "structural_anomalies": [
            (f"{n(';')} > 1", "Multiple statements detected"),
            (f"{n('(')} > 10", "Excessive nesting detected (possible subquery bomb)"),
            (
                f"length(regexp_extract(sql, {flagged(_classes(r'WHERE' + chr(92) + r's+(.+?)(?:GROUP BY|ORDER BY|LIMIT|HAVING|$)', False), 'is')}, 1)) > 2000",
                "Abnormally long WHERE clause",
            ),
            (f"{n(chr(39))} % 2 != 0", "Unbalanced quotes detected"),
        ],
    }


def policy_cte(mode: str, extra: dict[str, str] | None = None, unicode: bool = False) -> str:
    lists = policy_lists(mode, extra, unicode)
    cols = ", ".join(f"{joined(pairs, '; ')} AS {name}" for name, pairs in lists.items())
    everything = joined([p for pairs in lists.values() for p in pairs], "; ")
    total = " + ".join(f"(CASE WHEN {c} THEN 1 ELSE 0 END)" for pairs in lists.values() for c, _ in pairs)
    risk = " + ".join(
        f"CASE WHEN {name} != '' THEN {w}::DOUBLE ELSE 0::DOUBLE END" for name, w in zip(lists, (0.25, 0.25, 0.30, 0.20), strict=True)
    )
    return (
        f"pol1 AS (SELECT *, {cols}, {everything} AS violations, {total} AS nv FROM log), "
        f"pol AS (SELECT *, least(1::DOUBLE, {risk}) AS rs FROM pol1)"
    )


POLICY_COLS = (
    "(nv > 0)::INT AS violation_detected, forbidden_keywords, dangerous_functions, suspicious_patterns, "
    "structural_anomalies, violations, round(rs, 6) AS risk_score"
)
ENFORCE = "CASE WHEN nv = 0 THEN 'ALLOW' WHEN rs < 0.3::DOUBLE THEN 'ALLOW_WITH_LOGGING' WHEN rs < 0.6::DOUBLE THEN 'SANDBOX' ELSE 'REJECT' END"


# ---- evaluation --------------------------------------------------------------------------------

EVAL_ROWS = (
    f"{LOG}, {clean_ctes('log', 'cl')}, {verdict_ctes('cl', 'v', *EVAL)}, "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY md5('42:' || id::VARCHAR), id) - 1 AS rk, "
    "count(*) OVER (PARTITION BY toxic) AS sz FROM v), "
    "rows_ AS (SELECT *, toxic AS label, risk AS score, (action != 'ALLOW')::INT AS pred_hard, "
    "CASE WHEN rk < floor(sz * 0.6::DOUBLE) THEN 'train' "
    "WHEN rk < floor(sz * 0.6::DOUBLE) + floor(sz * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM ranked)"
)


def counts(pred: str) -> str:
    return (
        f"count(*) FILTER (label = 1 AND {pred}) AS tp, count(*) FILTER (label = 0 AND {pred}) AS fp, "
        f"count(*) FILTER (label = 0 AND NOT {pred}) AS tn, count(*) FILTER (label = 1 AND NOT {pred}) AS fn"
    )


P = "(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0::DOUBLE END)"
R = "(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0::DOUBLE END)"
F1 = f"(CASE WHEN {P} + {R} > 0 THEN 2 * {P} * {R} / ({P} + {R}) ELSE 0::DOUBLE END)"
ACC = "(CASE WHEN tp + fp + tn + fn > 0 THEN (tp + tn)::DOUBLE / (tp + fp + tn + fn) ELSE 0::DOUBLE END)"
METRIC_COLS = f"round({P}, 6) AS precision, round({R}, 6) AS recall, round({F1}, 6) AS f1, round({ACC}, 6) AS accuracy, tp, fp, tn, fn"

THETAS = "thetas AS (SELECT k / 100::DOUBLE AS threshold FROM range(101) t(k))"


def curve_cte(split: str) -> str:
    return (
        f"curve_{split} AS (SELECT threshold, {counts('score > threshold')} FROM thetas, rows_ WHERE split = '{split}' GROUP BY threshold), "
        f"best_{split} AS (SELECT *, {F1} AS f1_ FROM curve_{split} ORDER BY f1_ DESC, threshold LIMIT 1)"
    )


SWEPT = f"{EVAL_ROWS}, {THETAS}, {curve_cte('val')}, {curve_cte('test')}"
BY_SPLIT = (
    f"{SWEPT}, m AS (SELECT split, 'sweep' AS kind, {counts('score > (SELECT threshold FROM best_val)')} FROM rows_ GROUP BY split "
    f"UNION ALL SELECT split, 'hard', {counts('pred_hard = 1')} FROM rows_ GROUP BY split)"
)
STATS = (
    "count(*) AS n_total, count(*) FILTER (toxic = 1) AS n_toxic, count(*) - count(*) FILTER (toxic = 1) AS n_clean, "
    "round(100 * (count(*) FILTER (toxic = 1))::DOUBLE / count(*), 6) AS pct_toxic, "
    "round(100 * (count(*) - count(*) FILTER (toxic = 1))::DOUBLE / count(*), 6) AS pct_clean"
)


def entropy_sql(source: str, key: str) -> str:
    def part(name: str, items: str) -> str:
        return (
            f"{name}c AS (SELECT {key}, x, count(*)::DOUBLE AS c FROM (SELECT {key}, unnest({items}) AS x FROM log WHERE sql != '') GROUP BY {key}, x), "
            f"{name} AS (SELECT {key}, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h FROM {name}c GROUP BY {key})"
        )

    word = lit(f"[{WORD}]+")
    return (
        f"{ctes(source, part('ch', 'regexp_extract_all(sql, ' + lit('(?s).') + ')'), part('tk', f'regexp_extract_all(sql, {word})'))} "
        f"SELECT log.{key}, round(coalesce(ch.h, 0), 6) AS char_entropy, round(coalesce(tk.h, 0), 6) AS token_entropy "
        f"FROM log LEFT JOIN ch USING ({key}) LEFT JOIN tk USING ({key})"
    )


def trigger_cols(text: str) -> dict[str, str]:
    return {
        "has_non_ascii": f"regexp_matches({text}, {lit('[^' + chr(92) + 'x00-' + chr(92) + 'x7F]')})::INT",
        "has_html_entity": f"regexp_matches({text}, '&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);')::INT",
        "has_odd_space": f"regexp_matches({text}, {lit(r'[\x{9}\x{B}\x{C}\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]')})::INT",
    }


def detail_rows() -> str:
    """One row per hit: the snippet is cut from the text by position."""
    parts = []
    for i, r in enumerate(BUILTIN_RULES):
        start = f"length(regexp_extract(sql, {flagged('^((?s:.)*?)(?:' + r.pattern + ')', r.flags)}, 1))"
        size = f"length(regexp_extract(sql, {flagged(r.pattern, r.flags)}))"
        cut = f"substring(sql, greatest({start} - 10, 0) + 1, least(length(sql), {start} + {size} + 20) - greatest({start} - 10, 0))"
        parts.append(
            f"SELECT id, {i} AS no, {lit(r.name)} AS rule, {lit(r.attack_type)} AS attack_type, {lit(r.severity)} AS severity, "
            f"{lit(r.description)} AS description, '...' || replace({cut}, chr(10), ' ') || '...' AS snippet FROM hits WHERE h{i}"
        )
    return "details AS (" + " UNION ALL ".join(parts) + ")"


def report_texts() -> str:
    recs = (
        "concat_ws('; ', CASE WHEN nv > 5 THEN 'Query contains multiple policy violations - REJECT' "
        "WHEN nv > 0 THEN 'Query contains policy violations - ROUTE TO SANDBOX' END, "
        "CASE WHEN rs > 0.7::DOUBLE THEN 'High-risk query - Consider additional review' END, "
        "CASE WHEN contains(violations, 'DELETE') OR contains(violations, 'DROP') THEN 'Data modification/destruction detected - REJECT' END, "
        "CASE WHEN contains(lower(violations), 'time_delay') THEN 'Time-based attack pattern detected - REJECT' END)"
    )
    return (
        "SELECT id, sql AS sql_query, nv AS violations_count, "
        "round(rs, 6) AS risk_score, CASE WHEN rs < 0.2::DOUBLE THEN 'LOW' WHEN rs < 0.5::DOUBLE THEN 'MEDIUM' WHEN rs < 0.8::DOUBLE THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level, "
        f"violations, CASE WHEN {recs} = '' THEN 'Query passes policy checks' ELSE {recs} END AS recommendations FROM pol"
    )


ALIGN = f"{ctes(WITH_GOLD)}, scored AS (SELECT *, CASE WHEN wf THEN {USABLE_SIMILARITY} ELSE 0::DOUBLE END AS sim, {' + '.join(f'({c})::INT' for c in pattern_conditions().values())} AS np, {joined([(c, PATTERN_LABELS[k]) for k, c in pattern_conditions().items()])} AS patt FROM both_sides)"


def oracle() -> dict[str, str]:
    flags = aliased({k: f"{c}::INT" for k, c in pattern_conditions().items()})
    skeleton_cols = ", ".join(f"s_{f} AS {f}" for f in SKELETON_FIELDS)
    rules_custom = (*BUILTIN_RULES, *[Rule(r.name, r.pattern.replace(r"\d", "[0-9]"), r.attack_type, r.severity, r.description, r.flags, r.weight) for r in EXTRA_RULES])
    consistency = {
        "query_type_match": "s_query_type = e_s_query_type",
        "where_clause_match": "s_has_where = e_s_has_where",
        "join_match": "s_has_join = e_s_has_join",
        "aggregate_match": "s_has_aggregate = e_s_has_aggregate",
        "table_count_match": "s_table_count = e_s_table_count",
    }
    compared = "(wf AND e_wf)"
    explain_lines = (
        "string_agg('     [' || rpad(severity, 8, ' ') || '] ' || rpad(rule, 40, ' ') || ' → ' || snippet, chr(10) ORDER BY no)"
    )
    docs, pages, convs = (
        texts("documents", "doc_id", "text"), texts("pages", "page_id", "html"), texts("conversations", "conv_id, turn", "text"),
    )
    clean_cols = "md5(clean) AS clean_md5, md5(mask) AS mask_md5, wf::INT AS well_formed"
    triggers_3 = "(" + " + ".join(trigger_cols("sql").values()) + ") / 3::DOUBLE"
    words_q = "list_distinct(regexp_extract_all(lower(question), '[a-z0-9_]{3,}'))"
    overlap = f"(len(list_intersect({words_q}, list_distinct(regexp_extract_all(lower(sql), '[a-z0-9_]+'))))::DOUBLE / len({words_q}))"
    out = {
        "keyword_scan_log": scan_sql(LOG, "id"),
        "keyword_scan_lenient": f"{ctes(LOG, hits_cte())} SELECT id, {scan_cols(strict=False)['recommendation']} AS recommendation FROM hits",
        "keyword_scan_custom": scan_sql(LOG, "id", rules_custom),
        "keyword_hits_long": f"{ctes(LOG, hits_cte(), detail_rows())} SELECT id, row_number() OVER (PARTITION BY id ORDER BY no) - 1 AS pos, "
        "rule, attack_type, severity, description, snippet FROM details",
        "keyword_risk": f"{ctes(LOG, hits_cte())} SELECT risk, recommendation, count(*) AS n FROM (SELECT {aliased(scan_cols())} FROM hits) GROUP BY ALL",
        "keyword_explain_log": f"{ctes(LOG, hits_cte(), detail_rows())}, lines AS (SELECT id, {explain_lines} AS t FROM details GROUP BY id), "
        f"heads AS (SELECT id, {aliased({**scan_cols(), 'raw': raw_risk()})} FROM hits) "
        "SELECT heads.id, CASE WHEN flagged = 0 THEN '✅ Query passed all keyword rules — no suspicious patterns detected.' ELSE "
        "'🚨 Query FLAGGED — risk score: ' || printf('%.2f', raw) || chr(10) || '   Recommendation: ' || recommendation || chr(10) || "
        "'   Attack types detected: ' || replace(attack_types, ',', ', ') || chr(10) || chr(10) || '   Matched rules:' || chr(10) || t END AS explanation "
        "FROM heads LEFT JOIN lines USING (id)",
        "rule_hit_counts": f"{ctes(LOG, hits_cte())} "
        + " UNION ALL ".join(
            f"SELECT {i} AS rule_no, {lit(r.name)} AS name, {lit(r.attack_type)} AS attack_type, {lit(r.severity)} AS severity, "
            f"{lit(r.description)} AS description, {r.weight}::DOUBLE AS weight, count(*) FILTER (h{i}) AS hits FROM hits"
            for i, r in enumerate(BUILTIN_RULES)
        ),
        "doc_keyword_scan": scan_sql(docs, "doc_id", unicode=True),
        "page_keyword_scan": scan_sql(pages, "page_id", unicode=True),
        "conversation_keyword_scan": scan_sql(convs, "conv_id, turn", unicode=True),
        "suspicious_patterns": f"{ctes(LOG)} SELECT id, {flags}, {joined([(c, PATTERN_LABELS[k]) for k, c in pattern_conditions().items()])} AS patterns_found FROM log",
        "doc_suspicious_patterns": f"{ctes(docs)} SELECT doc_id, {flags} FROM log",
        "clean_sql": f"{ctes(LOG, clean_ctes())} SELECT id, clean, mask FROM cleaned",
        "clean_sql_messy": f"{ctes(MESSY, clean_ctes())} SELECT id, clean, mask, wf::INT AS well_formed FROM cleaned",
        "doc_clean_sql": f"{ctes(docs, clean_ctes())} SELECT doc_id, {clean_cols} FROM cleaned",
        "page_clean_sql": f"{ctes(pages, clean_ctes())} SELECT page_id, {clean_cols} FROM cleaned",
        "well_formed_counts": f"{ctes(LOG, clean_ctes())} SELECT tid, wf::INT AS well_formed, count(*) AS n FROM cleaned GROUP BY ALL",
        "skeleton": f"{ctes(LOG, clean_ctes(), structure_ctes('cleaned', 'st'))} SELECT id, wf::INT AS well_formed, {skeleton_cols} FROM st",
        "skeleton_messy": f"{ctes(MESSY, clean_ctes(), structure_ctes('cleaned', 'st'))} SELECT id, wf::INT AS well_formed, {skeleton_cols} FROM st",
        "tree_features": f"{ctes(LOG, clean_ctes(), structure_ctes('cleaned', 'st'))} SELECT id, {', '.join(f'CASE WHEN wf THEN t_{f} END AS {f}' for f in TREE_FEATURES)} FROM st",
        "gold_join": f"{ctes(LOG, GOLD, GOLD_JOIN)} SELECT id, expected_sql FROM paired",
        "tree_similarity": f"{ALIGN} SELECT id, round(sim, 6) AS tree_similarity FROM scored",
        "alignment_check": f"{ALIGN} SELECT id, round(CASE WHEN wf THEN greatest(0::DOUBLE, sim - np * 0.15::DOUBLE) ELSE 0::DOUBLE END, 6) AS alignment_score, "
        "round(sim, 6) AS tree_similarity, CASE WHEN wf THEN patt ELSE 'Failed to parse generated SQL' END AS anomaly_indicators, "
        "s_query_type AS generated_type, CASE WHEN wf THEN e_s_query_type END AS expected_type FROM scored",
        "skeleton_consistency": f"{ALIGN} SELECT id, {', '.join(f'CASE WHEN {compared} THEN ({c})::INT END AS {n}' for n, c in consistency.items())}, "
        f"CASE WHEN {compared} THEN concat_ws(',', CASE WHEN NOT ({consistency['query_type_match']}) THEN 'Query type mismatch' END, "
        f"CASE WHEN NOT ({consistency['where_clause_match']}) THEN 'WHERE clause mismatch' END, "
        f"CASE WHEN NOT ({consistency['join_match']}) THEN 'JOIN clause mismatch' END) END AS inconsistencies, "
        f"CASE WHEN {compared} THEN round(({' + '.join(f'({c})::INT' for c in consistency.values())}) / 5::DOUBLE, 6) END AS consistency_score FROM scored",
        "policy_strict": f"{ctes(LOG, policy_cte('strict'))} SELECT id, {POLICY_COLS} FROM pol",
        "policy_lenient": f"{ctes(LOG, policy_cte('lenient'))} SELECT id, {POLICY_COLS} FROM pol",
        "policy_extra_patterns": f"{ctes(LOG, policy_cte('strict', EXTRA_PATTERNS))} SELECT id, {POLICY_COLS} FROM pol",
        "page_policy": f"{ctes(pages, policy_cte('strict', unicode=True))} SELECT page_id, {POLICY_COLS} FROM pol",
        "policy_report_log": f"{ctes(LOG, policy_cte('strict'))} {report_texts()}",
        "policy_quarantine": f"{ctes(LOG, policy_cte('strict'))} SELECT CASE WHEN nv = 0 THEN 'allowed' ELSE 'quarantine' END AS part, attack, count(*) AS n FROM pol GROUP BY ALL",
        "fused_default": f"{fused(DEFAULTS)} SELECT id, {aliased(VERDICT)} FROM v",
        "fused_eval": f"{fused(EVAL)} SELECT id, {aliased(VERDICT)} FROM v",
        "fused_with_gold": f"{ctes(WITH_GOLD, verdict_ctes('both_sides', 'v', *DEFAULTS, similarity=USABLE_SIMILARITY))} SELECT id, {aliased(VERDICT)} FROM v",
        "fused_actions": f"{fused(DEFAULTS)} SELECT action, attack, count(*) AS n, round(avg(risk), 6) AS mean_risk FROM v GROUP BY ALL",
        "fused_batch_keys": f"{fused(DEFAULTS)} SELECT id, '' AS asked, action FROM v",
        "fused_null_rows": f"{ctes(LOG.replace('log AS (', 'log0 AS ('), 'log AS (SELECT * FROM log0 UNION ALL SELECT * REPLACE (-id AS id, CAST(NULL AS VARCHAR) AS sql) FROM log0)', clean_ctes('log', 'cl'), verdict_ctes('cl', 'v', *DEFAULTS))} "
        "SELECT id, action, (action != 'ALLOW')::INT AS is_toxic, round(risk, 6) AS overall_risk_score, coalesce(k_flagged, 0) AS keyword_flagged, "
        "coalesce(k_risk, 0) AS keyword_risk_score, coalesce(k_matched_rules, '') AS keyword_matched_rules, coalesce(k_attack_types, '') AS keyword_attack_types, "
        "k_recommendation AS keyword_recommendation, coalesce(wf, false)::INT AS ast_parsed, coalesce(patt, '') AS ast_suspicious_patterns FROM v",
        "doc_fused": f"{fused(DEFAULTS, docs, True)} SELECT doc_id, {aliased({k: v for k, v in VERDICT.items() if k != 'ast_alignment_score'})} FROM v",
        "verdict_explain_log": f"{fused(DEFAULTS)} SELECT id, CASE action WHEN 'ALLOW' THEN '✅' WHEN 'FLAG_FOR_REVIEW' THEN '⚠️' ELSE '🚨' END || ' Action: ' || action || '  (risk=' || "
        f"{two_digits('risk')} || ')' || chr(10) || chr(10) || CASE WHEN {REASONS} != '' THEN '  Reasons:' || chr(10) || '    • ' || replace({REASONS}, '; ', chr(10) || '    • ') || chr(10) || chr(10) ELSE '' END || "
        f"CASE WHEN k_flagged = 1 THEN '  [Stage 1 – Keyword] risk=' || {two_digits('kr')} || ', rules=[''' || replace(k_matched_rules, ',', ''', ''') || '''], attack_types=[''' || replace(k_attack_types, ',', ''', ''') || ''']' || chr(10) ELSE '' END || "
        "CASE WHEN wf THEN '  [Stage 2 – AST] alignment=' || printf('%.2f', al) || ', suspicious=' || CASE WHEN np = 0 THEN '[]' ELSE '[''' || shown || ''']' END "
        "ELSE '  [Stage 2 – AST] parse FAILED (query not valid SQL)' END AS explanation FROM v",
        "custom_detectors": f"{ctes(LOG)} SELECT id, length(sql) - length(replace(sql, ',', '')) AS n_commas, (length(sql) > 80)::INT AS is_long FROM log",
        "corpus_stats": f"{ctes(LOG)} SELECT {STATS} FROM log",
        "split": f"{ctes(EVAL_ROWS)} SELECT id, toxic, split FROM rows_",
        "split_stats": f"{ctes(EVAL_ROWS)} SELECT split, {STATS} FROM rows_ GROUP BY split",
        "doc_split": "WITH d AS (SELECT doc_id, (n_chars % 10 = 0)::INT AS label FROM documents), ranked AS (SELECT *, "
        "row_number() OVER (PARTITION BY label ORDER BY md5('7:' || doc_id::VARCHAR), doc_id) - 1 AS rk, count(*) OVER (PARTITION BY label) AS sz FROM d) "
        "SELECT doc_id, label, CASE WHEN rk < floor(sz * 0.7::DOUBLE) THEN 'train' WHEN rk < floor(sz * 0.7::DOUBLE) + floor(sz * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM ranked",
        "confusion_metrics": f"{ctes(BY_SPLIT)} SELECT split, kind, {METRIC_COLS} FROM m",
        "sweep_curve": f"{ctes(SWEPT)} SELECT round(threshold, 6) AS threshold, {METRIC_COLS} FROM curve_val",
        "sweep_best": f"{ctes(SWEPT)} SELECT 'val' AS split, round(threshold, 6) AS threshold, {METRIC_COLS} FROM best_val",
        "oracle_sweep": f"{ctes(SWEPT)} SELECT 'test' AS split, round(threshold, 6) AS threshold, {METRIC_COLS} FROM best_test",
        "apply_threshold": f"{ctes(SWEPT)} SELECT id, split, round(score, 6) AS score, (score > (SELECT threshold FROM best_val))::INT AS pred_sweep, pred_hard FROM rows_",
        "eval_slim_rows": f"{ctes(SWEPT)} SELECT id, split, db_id, label, round(score, 6) AS score, action, k_matched_rules AS kw_rules, k_attack_types AS kw_types, "
        "patt AS ast_patt, (score > (SELECT threshold FROM best_val))::INT AS pred_sweep, pred_hard FROM rows_",
        "eval_csv_rows": f"{ctes(SWEPT)} SELECT id, split, db_id, label, printf('%.4f', score) AS score, action, (score > (SELECT threshold FROM best_val))::INT AS pred_sweep, pred_hard, "
        "k_matched_rules AS kw_rules, k_attack_types AS kw_types, patt AS ast_patt, sql, question AS nlq FROM rows_",
        "overfit_gap": f"{ctes(BY_SPLIT)}, x AS (SELECT split, {P} AS precision, {R} AS recall, {F1} AS f1, {ACC} AS accuracy FROM m WHERE kind = 'sweep') "
        + " UNION ALL ".join(
            f"SELECT '{m}' AS metric, round(v.{m}, 6) AS val, round(t.{m}, 6) AS test, round(v.{m} - t.{m}, 6) AS gap, (abs(v.{m} - t.{m}) > 0.05)::INT AS possible_overfit "
            "FROM (SELECT * FROM x WHERE split = 'val') v, (SELECT * FROM x WHERE split = 'test') t"
            for m in ("f1", "precision", "recall", "accuracy")
        ),
        "evaluation_report": f"{ctes(BY_SPLIT)}, x AS (SELECT split, kind, {F1} AS f1, {ACC} AS accuracy, tp + fp + tn + fn AS n FROM m) "
        "SELECT 42 AS random_seed, (SELECT round(threshold, 6) FROM best_val) AS best_threshold, 0.2::DOUBLE AS test_ratio, "
        + ", ".join(
            f"max({col}) FILTER (split = '{s}' AND kind = '{k}') AS {name}"
            for name, s, k, col in (
                ("n_train", "train", "hard", "n"), ("train_f1", "train", "sweep", "round(f1, 6)"), ("n_val", "val", "hard", "n"),
                ("val_f1", "val", "sweep", "round(f1, 6)"), ("val_hard_f1", "val", "hard", "round(f1, 6)"), ("n_test", "test", "hard", "n"),
                ("test_f1", "test", "sweep", "round(f1, 6)"), ("test_hard_accuracy", "test", "hard", "round(accuracy, 6)"),
            )
        )
        + ", (SELECT round(threshold, 6) FROM best_test) AS oracle_threshold FROM x",
        "detection_by_attack": f"{fused(EVAL)} SELECT attack AS attack_type, count(*) AS n, count(*) FILTER (action != 'ALLOW') AS detected, "
        "round((count(*) FILTER (action != 'ALLOW'))::DOUBLE / count(*), 6) AS detection_rate FROM v GROUP BY attack",
        "ablation": f"{fused(EVAL)}, r AS (SELECT *, toxic AS label FROM v), m AS ("
        + " UNION ALL ".join(
            f"SELECT '{name}' AS variant, {counts(f'{col} >= 0.2::DOUBLE')} FROM r"
            for name, col in (("keyword_only", "kr"), ("structure_only", "ar"), ("fused", "risk"))
        )
        + f") SELECT variant, {METRIC_COLS} FROM m",
        "security_metrics": f"{fused(EVAL)}, r AS (SELECT toxic AS label, action != 'ALLOW' AS p FROM v), m AS (SELECT {counts('p')} FROM r) "
        "SELECT round(fn::DOUBLE / (tp + fn), 6) AS asr, round(tp::DOUBLE / (tp + fn), 6) AS tpr, round(fn::DOUBLE / (tp + fn), 6) AS fnr, "
        "round(fp::DOUBLE / (fp + tn), 6) AS fpr FROM m",
        "hard_metrics_by_db": f"{fused(EVAL)}, r AS (SELECT db_id, toxic AS label, action != 'ALLOW' AS p FROM v), m AS (SELECT db_id, {counts('p')} FROM r GROUP BY db_id) SELECT db_id, {METRIC_COLS} FROM m",
        "doc_sweep_curve": f"{ctes('log AS (SELECT doc_id AS id, text AS sql, toxic FROM documents JOIN labels USING (doc_id))', clean_ctes('log', 'cl'), verdict_ctes('cl', 'v', *EVAL, unicode=True), THETAS)}, "
        f"c AS (SELECT threshold, {counts('score > threshold')} FROM thetas, (SELECT toxic AS label, risk AS score FROM v) GROUP BY threshold) SELECT round(threshold, 6) AS threshold, {METRIC_COLS} FROM c",
        "stream_guard": "WITH " + LOG.split(", log AS")[0] + f", log AS (SELECT event_id, {_filled('template', 'user_id', 'event_id')} AS sql FROM events JOIN templates ON event_id % {len(TEMPLATES)} = tid), "
        f"{clean_ctes('log', 'cl')}, {verdict_ctes('cl', 'v', *DEFAULTS)} SELECT event_id, round(risk, 6) AS overall_risk_score, action FROM v",
        "entropy": entropy_sql(docs, "doc_id"),
        "query_entropy": entropy_sql(LOG, "id"),
        "nlq_divergence": f"{ctes(LOG)} SELECT id, round(length(sql)::DOUBLE / length(question), 6) AS length_ratio, round({overlap}, 6) AS overlap FROM log",
        "char_triggers": f"SELECT page_id, {aliased(trigger_cols('html'))} FROM pages",
        "doc_char_triggers": f"SELECT doc_id, {aliased(trigger_cols('text'))} FROM documents",
        "cosine_alignment": "WITH p AS (SELECT a.vec_id, (a.label = b.label)::INT AS same_label, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s "
        "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT vec_id, same_label, round(s, 5) AS cosine, (s >= 0.65)::INT AS aligned FROM p",
        "overall_score": f"{ctes(LOG, policy_cte('strict'), clean_ctes('pol', 'cl'))}, a AS (SELECT *, CASE WHEN wf THEN greatest(0::DOUBLE, 1 - ({' + '.join(f'({c})::INT' for c in pattern_conditions().values())}) * 0.15::DOUBLE) ELSE 0::DOUBLE END AS al, "
        f"{overlap} AS sem, {triggers_3} AS st FROM cl), o AS (SELECT *, 0.35::DOUBLE * al + 0.35::DOUBLE * sem + 0.2::DOUBLE * (1 - rs) + 0.1::DOUBLE * (1 - st) AS overall FROM a) "
        "SELECT id, round(overall, 6) AS overall, "
        + ", ".join(
            f"(overall < 0.6::DOUBLE OR al < {a}::DOUBLE OR sem < {s}::DOUBLE OR nv > 0 OR st > 0.7::DOUBLE)::INT AS anomaly{n}"
            for n, a, s in (("", 0.6, 0.65), ("_lenient", 0.5, 0.55), ("_strict", 0.75, 0.75))
        )
        + " FROM o",
    }
    # Every query against all rows.
    out["nearest_vector"] = (
        "WITH p AS (SELECT a.vec_id, b.vec_id AS other, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS s "
        "FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) "
        "SELECT vec_id, other AS nearest_id, round(s, 6) AS nearest_cosine FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, other) = 1"
    )
    popular = "Which orders are open?"
    out["gold_join_hot"] = (
        f"{ctes(LOG, GOLD)}, asked AS (SELECT id, db_id, CASE WHEN id % 3 = 0 THEN {lit(popular)} ELSE question END AS question FROM log), "
        f"known AS (SELECT * FROM gold UNION ALL SELECT DISTINCT db_id, {lit(popular)}, 'SELECT * FROM orders -- ' || db_id FROM gold) "
        "SELECT id, gold_sql AS expected_sql FROM asked LEFT JOIN known USING (db_id, question)"
    )
    # Every pair of distinct trees of a database.
    equal = " + ".join(f"(a.t_{f} IS NOT DISTINCT FROM b.t_{f})::INT" for f in TREE_FEATURES)
    trees = ", ".join(f"t_{f}" for f in TREE_FEATURES)
    out["nearest_clean"] = (
        f"{ctes(LOG, clean_ctes(), structure_ctes('cleaned', 'st'))}, toxic_ AS (SELECT DISTINCT db_id, {trees} FROM st WHERE wf AND toxic = 1), "
        f"clean_ AS (SELECT db_id, {trees}, min(sql) AS gold FROM st WHERE wf AND toxic = 0 AND trim(sql) <> '' GROUP BY ALL), "
        f"pairs AS (SELECT a.*, gold, {equal} AS same FROM toxic_ a JOIN clean_ b ON a.db_id = b.db_id), "
        f"best AS (SELECT * FROM pairs WHERE same >= 7 QUALIFY row_number() OVER (PARTITION BY db_id, {trees} ORDER BY same DESC, gold) = 1) "
        "SELECT id, CASE WHEN wf THEN gold END AS nearest_sql, CASE WHEN wf THEN round(same / 9::DOUBLE, 6) END AS nearest_similarity FROM st LEFT JOIN best ON st.wf AND st.db_id = best.db_id AND "
        + " AND ".join(f"st.t_{f} IS NOT DISTINCT FROM best.t_{f}" for f in TREE_FEATURES)
        + " WHERE toxic = 1"
    )

    def each_rule(key: str, columns: str, unicode: bool) -> str:
        return " UNION ALL ".join(
            f"SELECT {key}, {i} AS rule_no, {lit(r.name)} AS name{columns.format(lit(r.severity))} FROM hits WHERE h{i}" for i, r in enumerate(BUILTIN_RULES)
        )

    # The watch list by taking the number out of the text.
    number = "unnest(list_distinct(regexp_extract_all(sql, '(?i)\\bo_custkey\\s*=\\s*([0-9]+)\\b', 1)))"
    watched = f"(SELECT {{}}, {number} AS n FROM log) WHERE n NOT LIKE '0%' AND length(n) < 9 AND n::INT <= {WATCHED}"
    first = len(BUILTIN_RULES) - 1
    out["rule_index_hits"] = (
        f"{ctes(LOG, hits_cte())} {each_rule('id', ', {} AS severity', False)} UNION ALL SELECT id, n::INT + {first}, 'customer_' || n, 'LOW' FROM {watched.format('id')}"
    )
    out["doc_rule_index_hits"] = (
        f"{ctes(docs, hits_cte(unicode=True))} {each_rule('doc_id', '', True)} UNION ALL SELECT doc_id, n::INT + {first}, 'customer_' || n FROM {watched.format('doc_id')}"
    )

    def exact(source: str, by: str) -> str:
        """Sums over all scores up to each one by a window."""
        return (
            f"per AS (SELECT {by}, round(score, 6) AS threshold, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM {source} WHERE score IS NOT NULL GROUP BY ALL), "
            f"curve AS (SELECT *, sum(pos) OVER w - sum(pos) OVER o AS tp, sum(neg) OVER w - sum(neg) OVER o AS fp, sum(neg) OVER o AS tn, sum(pos) OVER o AS fn, "
            f"sum(pos) OVER w AS all_pos, sum(neg) OVER w AS all_neg FROM per WINDOW w AS (PARTITION BY {by}), o AS (PARTITION BY {by} ORDER BY threshold)), "
            f"points AS (SELECT {by}, threshold, {METRIC_COLS}, {F1} AS f1_ FROM curve), "
            f"area AS (SELECT {by}, CASE WHEN max(all_pos) > 0 AND max(all_neg) > 0 THEN sum(neg * (2 * tp + pos))::DOUBLE / (2 * max(all_pos)::DOUBLE * max(all_neg)::DOUBLE) END AS auc FROM curve GROUP BY {by}), "
            f"best AS (SELECT * FROM points QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY f1_ DESC, threshold) = 1)"
        )

    named = "threshold, precision, recall, f1, accuracy, tp, fp, tn, fn"
    out["exact_sweep"] = f"{ctes(EVAL_ROWS, exact('rows_', 'split'))} SELECT split, {named} FROM points"
    out["exact_best"] = f"{ctes(EVAL_ROWS, exact('rows_', 'split'))} SELECT split, {named}, round(auc, 6) AS auc FROM best JOIN area USING (split)"
    labelled = "log AS (SELECT doc_id AS id, text AS sql, toxic, lang AS db_id FROM documents JOIN labels USING (doc_id))"
    out["doc_exact_best"] = (
        f"{ctes(labelled, clean_ctes('log', 'cl'), verdict_ctes('cl', 'v', *EVAL, unicode=True))}, rows_ AS (SELECT db_id, toxic AS label, risk AS score FROM v), "
        f"{exact('rows_', 'db_id')} SELECT best.db_id, {named}, round(auc, 6) AS auc FROM best JOIN area ON best.db_id IS NOT DISTINCT FROM area.db_id"
    )
    out["grouped_split"] = (
        f"{ctes(LOG)}, sized AS (SELECT question, count(*) AS n FROM log GROUP BY question), "
        "placed AS (SELECT question, sum(n) OVER (ORDER BY md5('42:=' || question), question) - n AS first, sum(n) OVER () AS total FROM sized) "
        "SELECT id, question, CASE WHEN first < floor(total * 0.6::DOUBLE) THEN 'train' WHEN first < floor(total * 0.6::DOUBLE) + floor(total * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS split "
        "FROM log JOIN placed USING (question)"
    )
    out["stream_replay"] = out["stream_guard"]
    out["clean_divergence"] = (
        f"{ctes(LOG)}, words AS (SELECT id, toxic, unnest(regexp_extract_all(lower(sql), '[a-z0-9_]+')) AS w FROM log), "
        "model AS (SELECT w, count(*) AS c FROM words WHERE toxic = 0 GROUP BY w), total AS (SELECT sum(c) + count(*) + 1 AS q FROM model), "
        "held AS (SELECT id, w, count(*) AS n, sum(count(*)) OVER (PARTITION BY id) AS size FROM words GROUP BY id, w), "
        "found AS (SELECT id, sum(n::DOUBLE / size * log2((n::DOUBLE / size) / ((coalesce(c, 0) + 1)::DOUBLE / q))) AS d, sum(CASE WHEN c IS NULL THEN n ELSE 0 END)::DOUBLE / max(size) AS u "
        "FROM held LEFT JOIN model USING (w) CROSS JOIN total GROUP BY id) SELECT log.id, round(d, 6) AS divergence, round(u, 6) AS unknown FROM log LEFT JOIN found USING (id)"
    )
    def registers(by: str, column: str, source: str) -> str:
        rest = f"('0x' || substr(md5({column}), 4, 13))::BIGINT"
        return (
            f"SELECT {by}, '{column}' AS col, 'distinct' AS kind, ('0x' || substr(md5({column}), 1, 3))::BIGINT AS bucket, "
            f"max(CASE WHEN {rest} = 0 THEN 53 ELSE 53 - length(bin({rest})) END)::BIGINT AS v FROM {source} WHERE {column} IS NOT NULL GROUP BY ALL"
        )

    def grid(by: str, source: str) -> str:
        shift = "greatest(length(bin(len::BIGINT)) - 6, 0)"
        return f"SELECT {by}, 'length' AS col, 'quantile' AS kind, ({shift} * 64 + (len::BIGINT >> {shift}))::BIGINT AS bucket, count(*) AS v FROM {source} WHERE len IS NOT NULL GROUP BY ALL"

    def estimate(by: str, source: str) -> str:
        raw = f"{0.7213 / (1 + 1.079 / 4096) * 4096 * 4096!r}::DOUBLE / (4096 - count(*) + sum(2.0::DOUBLE ** -v))"
        few = f"count(*) < 4096 AND {raw} <= 10240"
        return f"SELECT {by}, col, CASE WHEN {few} THEN 4096 * ln(4096::DOUBLE / greatest(4096 - count(*), 1)) ELSE {raw} END AS n FROM ({source}) GROUP BY ALL"

    # Quantiles from the sorted lengths themselves: the one of the rank, put on the grid.
    step = "greatest(length(bin(x::BIGINT)) - 6, 0)"
    middle = f"((x::BIGINT >> {step}) << {step}) + ((1::BIGINT << {step}) >> 1)"
    dated = "dated AS (SELECT log.*, strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%Y') AS year, length(sql) AS len FROM log JOIN orders ON o_orderkey = id)"
    out["corpus_sketch"] = (
        f"{ctes(LOG, dated)} SELECT month, col AS column, kind, bucket, v AS value FROM ({registers('month', 'sql', 'dated')} UNION ALL {registers('month', 'question', 'dated')} UNION ALL {grid('month', 'dated')})"
    )
    out["corpus_sketch_merged"] = (
        f"{ctes(LOG, dated)}, counts AS ({estimate('year', registers('year', 'sql', 'dated') + ' UNION ALL ' + registers('year', 'question', 'dated'))}), "
        "sorted AS (SELECT year, list_sort(list(len)) AS xs FROM dated GROUP BY year), "
        "picked AS (SELECT year, p, xs[greatest(ceil(p::DOUBLE * len(xs)), 1)::INT] AS x FROM sorted, (VALUES ('0.0'), ('0.5'), ('0.9'), ('0.99'), ('1.0')) t(p)) "
        f"SELECT year, col || '_distinct' AS what, round(n, 3) AS value FROM counts UNION ALL SELECT year, 'length_' || p, ({middle})::DOUBLE FROM picked"
    )
    out["doc_sketch"] = (
        f"WITH d AS (SELECT source, text, length(text) AS len FROM documents), counts AS ({estimate('source', registers('source', 'text', 'd'))}), "
        "sorted AS (SELECT source, list_sort(list(len)) AS xs FROM d WHERE len IS NOT NULL GROUP BY source), "
        "picked AS (SELECT source, p, xs[greatest(ceil(p::DOUBLE * len(xs)), 1)::INT] AS x FROM sorted, (VALUES ('0.5'), ('0.9')) t(p)), "
        f"shown AS (SELECT source, p, {middle} AS m FROM picked) "
        "SELECT source, round(n, 3) AS texts, (SELECT m FROM shown a WHERE a.source IS NOT DISTINCT FROM c.source AND p = '0.5') AS middle, "
        "(SELECT m FROM shown a WHERE a.source IS NOT DISTINCT FROM c.source AND p = '0.9') AS long FROM counts c"
    )
    # The same digests; the weight is the number of borders of the Poisson distribution that a group of four digits reaches.
    shares = [sum(2.718281828459045**-1 / math.factorial(j) for j in range(k)) for k in range(1, 9)]
    weight = " + ".join(f"(x >= {math.floor(65536 * share)})::INT" for share in shares if math.floor(65536 * share) < 65536)
    out["bootstrap_by_db"] = (
        f"{fused(EVAL)}, r AS (SELECT id, db_id, toxic AS label, action != 'ALLOW' AS p FROM v), "
        "hashed AS (SELECT *, md5('42:' || id || ':' || k) AS d FROM r, range(25) t(k)), "
        "drawn AS (SELECT db_id, label, p, 8 * k + j + 1 AS b, ('0x' || substr(d, 1 + 4 * j::INT, 4))::INT AS x FROM hashed, range(8) s(j)), "
        f"cells AS (SELECT db_id, label, p, b, sum({weight}) AS n FROM drawn GROUP BY ALL UNION ALL SELECT db_id, label, p, 0, count(*) FROM r GROUP BY ALL), "
        "c AS (SELECT db_id, b, coalesce(sum(n) FILTER (label = 1 AND p), 0) AS tp, coalesce(sum(n) FILTER (label = 0 AND p), 0) AS fp, "
        "coalesce(sum(n) FILTER (label = 0 AND NOT p), 0) AS tn, coalesce(sum(n) FILTER (label = 1 AND NOT p), 0) AS fn FROM cells GROUP BY ALL), "
        f"long AS (SELECT db_id, b, unnest([{{'m': 'precision', 'x': {P}}}, {{'m': 'recall', 'x': {R}}}, {{'m': 'f1', 'x': {F1}}}, {{'m': 'accuracy', 'x': {ACC}}}], recursive := true) FROM c), "
        "listed AS (SELECT db_id, m, max(x) FILTER (b = 0) AS estimate, list_sort(list(x) FILTER (b > 0)) AS xs FROM long GROUP BY ALL) "
        "SELECT db_id, m AS metric, round(estimate, 6) AS estimate, round(xs[5], 6) AS low, round(xs[196], 6) AS high FROM listed"
    )
    for level in ("strict", "medium", "lenient"):
        mode = "strict" if level == "strict" else "lenient"
        out[f"policy_enforce_{level}"] = (
            f"{ctes(LOG, policy_cte(mode))} SELECT id, (nv = 0)::INT AS allowed, '{level}' AS policy_level, violations, round(rs, 6) AS risk_score, {ENFORCE} AS action FROM pol"
        )
    return out


def two_digits(value: str) -> str:
    return f"printf('%.2f', {value})"
