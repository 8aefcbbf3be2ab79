"""Regular expressions that mean the same in a Spark executor as in Python's ``re``.

Java's own ``\\w``, ``\\s`` and ``\\b`` are ASCII-only, and its Unicode mode counts combining
marks as word characters.  Patterns here are therefore written in the Python spelling and
expanded to explicit character classes before they reach ``rlike``.

The helpers below return Spark SQL text over column names.  A scan has hundreds of sub-expressions,
and one ``F.expr`` per column builds them far faster than as many calls into the JVM.
"""

from __future__ import annotations

import re
from string import ascii_letters, digits

# The characters a Python str pattern counts as word and as space.  Java looks up single
# characters below 256 in one bitmap, so the common ones are spelt out; ranges and properties cost
# a call each.
WORD = ascii_letters + digits + r"_\p{L}\p{N}"
SPACE = r"\x{9}\x{A}\x{B}\x{C}\x{D}\x{1C}\x{1D}\x{1E}\x{1F}\x{20}\x{85}\x{A0}"
WIDE_SPACE = r"\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

SPACES = r"\s+"
_AT_MOST = re.compile(r"\{,\d+\}")
_UNKNOWN_GROUP = re.compile(r"\(\?(?![:=!>]|<[=!]|P<|[ims-]+:)")
_QUOTE = r"\x{27}"
_IN_CLASS = {"w": WORD, "s": SPACE + WIDE_SPACE, "d": r"\p{Nd}"}
# The rarer spaces are only looked at inside their span.
_ALONE = {"w": f"[{WORD}]", "s": rf"[{SPACE}[\x{{1680}}-\x{{3000}}&&[{WIDE_SPACE}]]]", "d": r"\p{Nd}"}


def java_regex(pattern: str, flags: str = "") -> str:
    """Expand a Python-style pattern.

    ``flags`` is any of ``i`` (ignore case), ``s`` (dot all) and ``c`` (the text is collapsed: its
    only white space is the plain space).
    """
    in_class_of = {**_IN_CLASS, "s": " "} if "c" in flags else _IN_CLASS
    alone = {**_ALONE, "s": " "} if "c" in flags else _ALONE
    out: list[str] = []
    in_class = negated = False
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            i += 2
            if nxt in alone:
                out.append(in_class_of[nxt] if in_class else alone[nxt])
            elif nxt in "WSD":
                if in_class and negated:
                    raise ValueError(f"\\{nxt} inside a negated class is not supported: {pattern!r}")
                # A class inside a class adds to it.
                out.append(f"[^{in_class_of[nxt.lower()]}]")
            elif nxt in "ABZbz" and in_class or nxt in "aegklpqyBCEGHIJKLMNOPQRTUVXYchijmo":
                raise ValueError(f"escape \\{nxt} is not supported: {pattern!r}")
            elif nxt == "Z":
                out.append(r"\z")
            elif nxt == "v":
                out.append(r"\x{B}")
            elif nxt == "b" and not in_class:
                following = pattern[i : i + 1]
                optional = pattern[i + 1 : i + 2] in ("?", "*", "{", "+")
                if _is_word(following) and not optional:
                    # Checked after the letter it precedes: few positions get that far.
                    out.append(f"{following}(?<![{WORD}].)")
                    i += 1
                else:
                    out.append(_boundary(out[-1] if out else ""))
            else:
                out.append(_QUOTE if nxt == "'" else ch + nxt)
            continue
        if ch == "[" and not in_class:
            in_class, negated = True, pattern[i + 1 : i + 2] == "^"
            first = i + 1 + negated
            if pattern[first : first + 1] == "]":  # as the first member it does not close the class
                out.append("[^\\]" if negated else "[\\]")
                i = first + 1
                continue
        elif ch == "[":
            ch = "\\["
        elif ch == "&" and in_class:
            ch = "\\&"
        elif ch == "]":
            in_class = False
        elif ch == "{" and not in_class and _AT_MOST.match(pattern, i):
            out.append("{0")
            i += 1
            continue
        elif ch == "(" and pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
            continue
        elif ch == "(" and _UNKNOWN_GROUP.match(pattern, i):
            raise ValueError(f"this group is not supported: {pattern[i:i + 12]!r} in {pattern!r}")
        # A quote is written by its code, so that a pattern always fits in an r'…' literal.
        out.append(_QUOTE if ch == "'" else ch)
        i += 1
    # d: only \n ends a line, as in Python; u: case folding beyond ASCII.
    return f"(?{'iu' if 'i' in flags else ''}{'s' if 's' in flags else ''}d)" + "".join(out)


def _is_word(ch: str) -> bool:
    return ch != "" and ch in ascii_letters + digits + "_"


def _boundary(preceding: str) -> str:
    """A word boundary; one-sided where the pattern text before it ends in a word character."""
    if len(preceding) == 1 and _is_word(preceding):
        return f"(?![{WORD}])"
    return f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"


def text_literal(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def regex_literal(pattern: str, flags: str = "") -> str:
    """A raw SQL string literal holding the Java form of a pattern."""
    return f"r'{java_regex(pattern, flags)}'"


def fold(text: str) -> str:
    """Lower-case text in which every character that ignore-case treats as s, i or k is that letter."""
    return f"lower(replace(replace(replace({text}, 'İ', 'i'), 'ı', 'i'), 'ſ', 's'))"


def squeeze(text: str) -> str:
    """The folded text without any white space: what needles are looked for in."""
    return f"regexp_replace({fold(text)}, {regex_literal(SPACES)}, '')"


def has_needles(folded: str, needles: str, text: str = "") -> str:
    """Cheap necessary test for a pattern: literals that every match must contain.

    Alternatives are separated by `` | ``; the words of one alternative must follow each other.  An
    alternative that starts with ``=`` is looked for in ``text`` itself.  A plain byte search is far
    cheaper than a regex, and most rows fail it.
    """
    alternatives = [
        _in_order(text, alt[1:].split(" ")) if alt.startswith("=") else _in_order(folded, alt.split(" "))
        for alt in needles.split(" | ")
    ]
    return "(" + " OR ".join(alternatives) + ")"


def _in_order(folded: str, words: list[str]) -> str:
    first = text_literal(words[0])
    tests = [f"contains({folded}, {first})"]
    end = f"locate({first}, {folded}) + {len(words[0])}"
    for word in words[1:]:
        at = f"locate({text_literal(word)}, {folded}, {end})"
        tests.append(f"{at} > 0")
        end = f"{at} + {len(word)}"
    return "(" + " AND ".join(tests) + ")"


def matches(text: str, folded: str, pattern: str, flags: str = "", needles: str = "") -> str:
    """``re.search(pattern, text) is not None``, behind its literal pre-test."""
    hit = f"{text} RLIKE {regex_literal(pattern, flags)}"
    return f"({has_needles(folded, needles, text)} AND {hit})" if needles else f"({hit})"


def count_matches(text: str, folded: str, pattern: str, flags: str = "", needles: str = "") -> str:
    """Number of non-overlapping matches, behind the same pre-test."""
    n = f"regexp_count({text}, {regex_literal(pattern, flags)})"
    return f"CASE WHEN {has_needles(folded, needles, text)} THEN {n} ELSE 0 END" if needles else n


def occurrences(text: str, char: str) -> str:
    """How often a single character occurs."""
    return f"(length({text}) - length(replace({text}, {text_literal(char)}, '')))"


def listed(hits: list[tuple[str, str]]) -> str:
    """Array of the labels whose condition holds, from (condition, label expression) pairs."""
    return "array_compact(array(" + ", ".join(f"CASE WHEN {hit} THEN {label} END" for hit, label in hits) + "))"
