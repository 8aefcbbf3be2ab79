"""Cleaning, literal masking and well-formedness of SQL text.

Each step is its own projection: Catalyst keeps projections apart when a later one uses an
expensive column more than once, so every regex runs once per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dialect import SPACES, fold, has_needles, occurrences, regex_literal

QUOTE = "'"

# ---- fixed values: the cleaning patterns -------------------------------------------------------
TRAILING_OR_NUMBER = r";?\s*OR\s+1\s*=\s*1\s*;?$"
TRAILING_OR_STRING = r";?\s*OR\s+'[^']+'\s*=\s*'[^']+'\s*;?$"
DANGLING_OR = r"\bOR\s*$"
OR_AFTER_SEMICOLON = r";\s*OR\s+"
# ---- end of fixed values -----------------------------------------------------------------------

# A quoted literal ('' is an escaped quote), a line comment or a block comment.  The quantifier over
# the literal's characters is possessive because Java recurses once per character otherwise and a
# long literal would overflow the stack; the second alternative then covers a literal whose closing
# quote has to be the first of the last '' pair.
MASK = r"(')(?:[^']|'')*+'|(').*'(?='[^']*\z)|--.*|/\*.*?\*/"


def _sub(text: str, pattern: str, replacement: str, flags: str = "") -> str:
    return f"regexp_replace({text}, {regex_literal(pattern, flags)}, '{replacement}')"


def requote(pieces: str, text: str) -> str:
    """Turn "…" literals into '…' with inner quotes doubled; an unpaired last " stays.

    ``pieces`` is the text split at ", or NULL if it has none.
    """
    # With an even number of pieces the last quote has no partner.
    unpaired = f"size({pieces}) % 2 = 0 AND i = size({pieces}) - 1"
    quoted = (
        f"transform({pieces}, (piece, i) -> CASE WHEN i % 2 = 0 THEN piece WHEN {unpaired} THEN concat('\"', piece) "
        r"ELSE concat('\'', replace(piece, '\'', '\'\''), '\'') END)"
    )
    return f"CASE WHEN {pieces} IS NOT NULL THEN array_join({quoted}, '') ELSE {text} END"


def drop_extra_closers(text: str) -> str:
    """Cut at the last ``)`` until no more ``)`` than ``(`` are left: the longest balanced-enough prefix."""
    pieces = rf"split({text}, r'\)', -1)"
    # Over the pieces between closers: count the openers so far and remember the longest good prefix.
    keep = (
        f"aggregate({pieces}, named_struct('seen', 0, 'opens', 0, 'keep', 1), (acc, piece) -> named_struct("
        f"'seen', acc.seen + 1, 'opens', acc.opens + {occurrences('piece', '(')}, "
        f"'keep', CASE WHEN acc.seen <= acc.opens + {occurrences('piece', '(')} THEN acc.seen + 1 ELSE acc.keep END)).keep"
    )
    cut = f"trim(array_join(slice({pieces}, 1, {keep}), ')'))"
    return f"CASE WHEN {occurrences(text, ')')} > {occurrences(text, '(')} THEN {cut} ELSE {text} END"


def _case(condition: str, value: str, text: str) -> str:
    """``value`` where a cheap test says the step can change anything, else the text as it is."""
    return f"CASE WHEN {condition} THEN {value} ELSE {text} END"


def with_clean_sql(df: DataFrame, sql_col: str, out: str) -> DataFrame:
    """Add ``out``: the text with whitespace collapsed and common injection debris removed.

    From the second step on, the only white space is the plain space.
    """
    end, pieces = f"lower(right({out}, 3))", f"{out}_pieces"
    collapsed_again = _case(f"contains({out}, '  ')", _sub(out, SPACES, " ", "c"), out)
    df = df.withColumn(out, F.col(sql_col))
    for name, step in [
        (out, f"trim({_sub(out, SPACES, ' ')})"),
        (out, _case(f"contains({end}, '1')", _sub(out, TRAILING_OR_NUMBER, "", "ic"), out)),
        (out, _case(f"contains({end}, '\\'')", _sub(out, TRAILING_OR_STRING, "", "ic"), out)),
        (pieces, _case(f"contains({out}, '\"')", f"split({out}, '\"', -1)", "NULL")),
        (out, requote(pieces, out)),
        (out, _case(has_needles(fold(out), "intersect"), _sub(out, r"\bINTERSECT\b", "INTERSECT", "ic"), out)),
        (out, _case(has_needles(fold(out), "union"), _sub(out, r"\bUNION\b", "UNION", "ic"), out)),
        (out, _case(f"contains({end}, 'or')", _sub(out, DANGLING_OR, "", "ic"), out)),
        (out, _case(f"contains({out}, ';')", _sub(out, OR_AFTER_SEMICOLON, "; ", "ic"), out)),
        (out, drop_extra_closers(out)),
        (out, f"trim({collapsed_again})"),
    ]:
        df = df.withColumn(name, F.expr(step))
    return df.drop(pieces)


def masked(text: str) -> str:
    """The text with every literal emptied and every comment removed.

    A comment that never ends would be searched for an end from each of its openers, so openers
    behind the last ``*/`` are hidden from the pattern by a control character.
    """
    tail = f"substring_index({text}, '*/', -1)"
    head = f"left({text}, length({text}) - length({tail}))"
    hidden = f"concat({head}, replace({tail}, '/*', '/\\u0001*'))"
    open_ended = f"contains({tail}, '/*') AND NOT contains({text}, '\\u0001')"
    mask = " $1$2$1$2 "
    return (
        f"CASE WHEN NOT (contains({text}, '\\'') OR contains({text}, '--') OR contains({text}, '/*')) THEN {text} "
        f"WHEN {open_ended} THEN replace({_sub(hidden, MASK, mask, 's')}, '/\\u0001*', '/*') "
        f"ELSE {_sub(text, MASK, mask, 's')} END"
    )


def well_formed(mask: str) -> str:
    """Balance check on masked text; it stands in for a parse and accepts more than a parser would."""
    balanced = f"{occurrences(mask, '(')} = {occurrences(mask, ')')}"
    return f"coalesce(trim({mask}) != '' AND {balanced} AND {occurrences(mask, QUOTE)} % 2 = 0, false)"
