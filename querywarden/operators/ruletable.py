"""Keyword rules as a table, for lists too long to be written into a plan.

Every match of a rule contains certain literals.  The rule table holds, for each alternative of a rule, one
three-letter piece of its literals: the piece that the fewest rules share.  A text meets, by an equi-join on its
own pieces, the rules whose piece it contains, and only those are tried as regular expressions.  The plan is the
same for ten rules and for ten thousand.  The table is broadcast, since it is as long as a list the driver wrote: a text
stays where it is, and only the keys and numbers of its hits are shuffled.
Rules without a literal of three letters meet every text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Sequence
from re import _constants as codes
from re import _parser as parser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalogue import Rule
from ..functions.dialect import java_regex, squeeze

PIECE = 3
RULE_INDEX = "rule_no INT, name STRING, attack_type STRING, severity STRING, description STRING, weight DOUBLE, regex STRING, piece STRING, literal STRING"


def required_literal(pattern: str, flags: str = "") -> str:
    """The longest literal that every match contains, in lower case and without white space; '' if none is found.

    White space between two literals is no gap, since texts are looked at without it.
    """
    runs, run = [], ""

    def close() -> None:
        nonlocal run
        runs.append(run)
        run = ""

    def walk(items: Iterable) -> None:
        nonlocal run
        for op, value in items:
            if op is codes.LITERAL and value < 128:
                run += chr(value).lower().strip()
            elif op is codes.SUBPATTERN:
                walk(value[3])
            elif op in (codes.MAX_REPEAT, codes.MIN_REPEAT) and _blank(value[2]) or op is codes.AT:
                continue
            elif op in (codes.MAX_REPEAT, codes.MIN_REPEAT) and value[0] > 0:
                close()
                walk(value[2])
                close()
            else:
                close()

    walk(parser.parse(pattern, re.I if "i" in flags else 0))
    close()
    return max(runs, key=len)


def _blank(items: Sequence) -> bool:
    return all(op is codes.IN and list(v) == [(codes.CATEGORY, codes.CATEGORY_SPACE)] or op is codes.LITERAL and chr(v).isspace() for op, v in items)


def _pieces_of(words: Iterable[str]) -> set[str]:
    return {w[i : i + PIECE] for w in words for i in range(len(w) - PIECE + 1)}


def _alternatives(rule: Rule) -> list[list[str]]:
    """The literals of each alternative; a match of it contains them all."""
    if not rule.needles:
        return [[required_literal(rule.pattern, rule.flags)]]
    return [["".join(w.lower().split()) for w in a.removeprefix("=").split(" ")] for a in rule.needles.split(" | ")]


def rule_index(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """One row for each rule, piece by which it is found ('' for every text), and literal that the text must hold then."""
    listed = [[(_pieces_of(words), max(words, key=len)) for words in _alternatives(r)] for r in rules]
    common = Counter(p for alternatives in listed for p in set().union(*(pieces for pieces, _ in alternatives)))
    rows = []
    for i, (r, alternatives) in enumerate(zip(rules, listed, strict=True)):
        chosen = {(min(pieces, key=lambda p: (common[p], p)) if pieces else "", literal) for pieces, literal in alternatives}
        fields = (i, r.name, r.attack_type, r.severity, r.description, float(r.weight), java_regex(r.pattern, r.flags))
        rows += [(*fields, *found) for found in ({("", "")} if ("", "") in chosen else sorted(chosen))]
    return spark.createDataFrame(rows, RULE_INDEX)


def indexed_hits(df: DataFrame, index: DataFrame, keys: Sequence[str], sql_col: str = "sql") -> DataFrame:
    """One row for each text and rule that matches it: the keys, rule_no, name, attack_type, severity, weight.

    ``keys`` name a text.  NULL and blank text matches nothing.
    """
    text, squeezed, letters, piece = "_rt_text", "_rt_squeezed", "_rt_letters", "piece"
    texts = df.select(*keys, F.col(sql_col).alias(text)).where(F.expr(f"{text} RLIKE r'[^{_space()}]'"))
    texts = texts.withColumn(squeezed, F.expr(squeeze(text))).withColumn(letters, F.split(squeezed, ""))
    # A text of fewer letters has one piece, NULL, which meets nothing.
    cut = ", ".join(f"get({letters}, i + {k})" for k in range(PIECE))
    own = F.array_distinct(F.expr(f"transform(sequence(0, greatest(size({letters}) - {PIECE}, 0)), i -> concat({cut}))"))
    tried = F.broadcast(index.select("rule_no", "regex", piece, "literal"))
    met = texts.select(*keys, text, squeezed, F.explode(F.array_append(own, F.lit(""))).alias(piece)).join(tried, piece)
    met = met.where(F.contains(squeezed, "literal"))
    # A rule with several alternatives may be met by more than one of them.
    found = met.where(F.expr(f"{text} RLIKE regex")).select(*keys, "rule_no").distinct()
    rules = index.select("rule_no", "name", "attack_type", "severity", "weight").distinct()
    return found.join(F.broadcast(rules), "rule_no").select(*keys, "rule_no", "name", "attack_type", "severity", "weight")


def _space() -> str:
    from ..functions.dialect import SPACE, WIDE_SPACE

    return SPACE + WIDE_SPACE
