"""Structure features of SQL text: counts and slices found by regex, not by a parser.

Every feature is defined on the first statement of the cleaned and masked text; statements stacked behind
it are left to the rules.  The patterns
have no lookaround and every open-ended one is anchored, so they are linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dialect import count_matches, fold, has_needles, regex_literal, text_literal
from .staging import pinned
from .text import masked, well_formed, with_clean_sql

TREE_FEATURES = (
    "node_count", "select_count", "where_count", "join_count", "aggregate_count",
    "subquery_count", "union_count", "table_count", "query_type",
)
SKELETON_FIELDS = (
    "query_type", "main_clauses", "has_where", "has_subquery", "has_union", "has_join",
    "has_aggregate", "table_count", "column_count", "condition_complexity", "clause_order",
)


#: What else ignore-case takes for a letter (as in ``fold``).
_ALIKE = {"S": "ſ", "I": "İı", "K": "\u212a"}


def _begins(*words: str) -> str:
    """A look at the next character, which any of the words (in capitals) begins with: one look-up in place
    of a comparison with each word, at nearly all places of a text the only one."""
    return "(?=(?-i:[" + "".join(c + c.lower() + _ALIKE.get(c, "") for c in dict.fromkeys(w[0] for w in words)) + "]))"


def _words(*words: str) -> str:
    """Any of the words as a whole word; the boundary is repeated because it is cheapest next to a letter."""
    return _begins(*words) + "(?:" + "|".join(rf"\b{w}" for w in words) + r")\b"


_TOKEN = r"\w+"
_AGGREGATE = (
    _begins(*"CSAMVG") + r"(?:\bCOUNT|\bSUM|\bAVG|\bMIN|\bMAX|\bSTDDEV\w*|\bVAR\w*|\bARRAY_AGG|\bSTRING_AGG|\bGROUP_CONCAT|\bMEDIAN)\s*\("
)
_SET_OPERATORS = ("UNION", "INTERSECT", "EXCEPT")
_CLAUSES = ("GROUP", "ORDER", "HAVING", "LIMIT", *_SET_OPERATORS)
_JOINS = ("LEFT", "RIGHT", "FULL", "INNER", "CROSS", "NATURAL", "JOIN", "ON")
_SET_OPERATOR = _words(*_SET_OPERATORS)
_TABLE_REF = r"(?:\bFROM|\bJOIN)\s+[A-Za-z_]"
_FROM_SLICE = rf"\bFROM\b([^()]*?)(?:{_words('WHERE', *_CLAUSES, *_JOINS)}|[()]|$)"
_VERBS = ("SELECT", "INSERT", "UPDATE", "DELETE", "MERGE")
_VERB = r"^[\s(]*(\w+)"
_OPENERS = r"^([\s(]*)"
#: All that the root of a query depends on: nesting, list commas, verbs, set operators.
_ROOT_TOKEN = r"([(),]|" + _words(*_VERBS, "FROM", *_SET_OPERATORS) + ")"
_WHERE_SLICE = rf"\bWHERE\b(.*?)(?:{_words(*_CLAUSES)}|$)"
_LIST_ITEM = r",\s*[A-Za-z_]"
_CONNECTIVE = _words("AND", "OR", "NOT")
_BETWEEN = r"\bBETWEEN\b"


def _group(text: str, pattern: str) -> str:
    return f"regexp_extract({text}, {regex_literal(pattern, 'isc')}, 1)"


def _count(text: str, pattern: str) -> str:
    return f"regexp_count({text}, {regex_literal(pattern, 'isc')})"


def _root(first: str, openers: str) -> str:
    """The root of a query in one pass over its tokens, whatever the nesting.

    The root's depth is the number of parentheses it is wrapped in. Fields: ``op`` is the last set operator at
    the smallest depth that has one, if that is not inside the root; ``verb`` the first verb at the root's
    depth (behind the definitions of a WITH); ``commas`` those of its list, up to FROM at the same depth.
    A closer without an opener changes nothing.
    """
    ops = ", ".join(text_literal(w) for w in _SET_OPERATORS)
    verbs = ", ".join(text_literal(w) for w in _VERBS)
    base = f"length(replace({openers}, ' ', ''))"
    found, inside = f"(t IN ({ops}) AND a.depth <= a.op_depth)", "a.depth = a.base"
    return (
        f"aggregate(transform(regexp_extract_all({first}, {regex_literal(_ROOT_TOKEN, 'isc')}, 1), t -> upper(t)), "
        f"named_struct('base', {base}, 'depth', 0, 'op', '', 'op_depth', {base}, 'verb', '', 'stage', 0, 'commas', 0), "
        "(a, t) -> named_struct('base', a.base, "
        "'depth', CASE t WHEN '(' THEN a.depth + 1 WHEN ')' THEN greatest(a.depth - 1, 0) ELSE a.depth END, "
        f"'op', CASE WHEN {found} THEN t ELSE a.op END, 'op_depth', CASE WHEN {found} THEN a.depth ELSE a.op_depth END, "
        f"'verb', CASE WHEN a.verb = '' AND {inside} AND t IN ({verbs}) THEN t ELSE a.verb END, "
        f"'stage', CASE WHEN a.stage = 0 AND {inside} AND t = 'SELECT' THEN 1 WHEN a.stage = 1 AND {inside} AND t = 'FROM' THEN 2 ELSE a.stage END, "
        f"'commas', a.commas + CASE WHEN a.stage = 1 AND {inside} AND t = ',' THEN 1 ELSE 0 END))"
    )


def with_structure(df: DataFrame, sql_col: str = "sql", prefix: str = "") -> DataFrame:
    """Add ``well_formed``, ``tree`` (9 features) and ``skeleton`` (11 fields); both NULL if not well formed."""
    p = prefix
    clean, mask, first, root, folded, verb, items, where, kind, counts, plain = names = [
        f"_{p}{n}" for n in ("clean", "mask", "first", "root", "folded", "verb", "items", "where", "kind", "counts", "plain")
    ]
    formed, tree, skeleton = (f"{p}{n}" for n in ("well_formed", "tree", "skeleton"))
    df = with_clean_sql(df, sql_col, clean)
    df = pinned(df, mask, masked(clean)).drop(clean)
    df = df.withColumn(formed, F.expr(well_formed(mask)))
    df = df.withColumn(first, F.expr(f"trim(CASE WHEN contains({mask}, ';') THEN split({mask}, ';', -1)[0] ELSE {mask} END)"))
    df = df.withColumn(folded, F.expr(fold(first)))
    # Each slice is a column, so that it is cut out once however often it is read.
    slices = f"array_join(regexp_extract_all({first}, {regex_literal(_FROM_SLICE, 'isc')}, 1), '|')"
    parts = {
        verb: _group(first, _VERB),
        root: _root(first, _group(first, _OPENERS)),
        # Joined with a bar, so that counting in the joined slices cannot reach across two of them.
        items: f"CASE WHEN {has_needles(folded, 'from ,')} THEN {slices} ELSE '' END",
        where: f"CASE WHEN {has_needles(folded, 'where')} THEN {_group(first, _WHERE_SLICE)} ELSE '' END",
    }
    df = df.withColumns({name: F.expr(part) for name, part in parts.items()})
    # Small steps: the JVM never compiles a generated method of more than 8,000 bytes.
    df = df.withColumn(kind, F.expr(f"CASE WHEN {root}.op != '' THEN {root}.op WHEN upper({verb}) = 'WITH' AND {root}.verb != '' THEN {root}.verb ELSE {verb} END"))
    df = df.withColumn(counts, F.expr(_named_struct(_tree_counts(first, folded, kind, items))))
    df = df.withColumn(plain, F.expr(f"{counts}.query_type = 'SELECT'"))
    df = df.withColumns(
        {
            tree: F.expr(f"CASE WHEN {formed} THEN {counts} END"),
            skeleton: F.expr(f"CASE WHEN {formed} THEN {_named_struct(_skeleton(counts, plain, root, where))} END"),
        }
    )
    return df.drop(*names)


def _named_struct(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"


def _tree_counts(first: str, folded: str, kind: str, items: str) -> dict[str, str]:
    def count(pattern: str, needles: str = "") -> str:
        return count_matches(first, folded, pattern, "isc", needles)

    listed = f"CASE WHEN {items} != '' THEN {_count(items, _LIST_ITEM)} ELSE 0 END"
    return {
        # A token is a run of word characters or one other character that is not a space.
        "node_count": f"length(replace(regexp_replace({first}, {regex_literal(_TOKEN)}, 'w'), ' ', ''))",
        "select_count": count(r"\bSELECT\b", "select"),
        "where_count": count(r"\bWHERE\b", "where"),
        "join_count": count(r"\bJOIN\b", "join"),
        "aggregate_count": count(_AGGREGATE, "("),
        "subquery_count": count(r"\(\s*SELECT\b", "( select"),
        "union_count": count(_SET_OPERATOR, "union | intersect | except"),
        "table_count": f"{count(_TABLE_REF, 'from | join')} + {listed}",
        "query_type": _shown(kind),
    }


def _shown(verb: str) -> str:
    return f"CASE WHEN upper({verb}) IN ('SELECT', 'INSERT', 'UPDATE', 'DELETE') THEN upper({verb}) ELSE initcap({verb}) END"


def _skeleton(counts: str, plain: str, root: str, where: str) -> dict[str, str]:
    """Only a plain SELECT has structure to report; other roots keep the defaults."""

    def present(feature: str) -> str:
        return f"({plain} AND {counts}.{feature} > 0)"

    def if_select(value: str, condition: str = plain) -> str:
        return f"CASE WHEN {condition} THEN {value} ELSE 0 END"

    conditions = f"{_count(where, _CONNECTIVE)} - {_count(where, _BETWEEN)}"
    return {
        "query_type": f"{counts}.query_type",
        "main_clauses": "CAST(array() AS ARRAY<STRING>)",
        "has_where": present("where_count"),
        "has_subquery": present("subquery_count"),
        "has_union": present("union_count"),
        "has_join": present("join_count"),
        "has_aggregate": present("aggregate_count"),
        "table_count": if_select(f"{counts}.table_count"),
        "column_count": if_select(f"{root}.commas + 1"),
        "condition_complexity": if_select(conditions, present("where_count")),
        "clause_order": f"CASE WHEN {present('where_count')} THEN array('WHERE') ELSE CAST(array() AS ARRAY<STRING>) END",
    }


def tree_similarity(a: Column, b: Column) -> Column:
    """Share of the nine tree features that are equal."""
    same = sum((a[n].eqNullSafe(b[n]).cast("int") for n in TREE_FEATURES[1:]), a["node_count"].eqNullSafe(b["node_count"]).cast("int"))
    return same / F.lit(float(len(TREE_FEATURES)))
