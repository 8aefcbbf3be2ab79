"""Secret scan by one combined deterministic automaton.

The rules' regexes are parsed to one nondeterministic automaton, made deterministic by subset construction,
minimised by partition refinement, and stored as a transition array over byte classes. One pass over a
text's UTF-8 bytes tells which rules match anywhere, whatever the number of rules. Only for rules that hit, the
rule's own reversed automaton marks the starts and its forward automaton the longest end of each match:
leftmost, longest, not overlapping per rule. Matches that are too short are dropped after matching, so
they still use up their text. A rule's tail only lengthens a match, so the combined automaton and the reversed one
leave it out.

A private key reaches from its BEGIN marker to its END marker, whatever stands between but five dashes. If no END
marker follows, it reaches over the armor headers and the key lines of 24 or more characters behind the marker, and
one shorter last line and checksum.

The regex dialect: literals, classes, groups, `|`, `?`, `*`, `+`, `{n,}`; ASCII only, `(?i)` by a flag.

A null or empty text has no spans; an empty table gives an empty one; repeated rows are scanned each.
Spans count code points, the end is exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querywarden.llm.base import arrow_column, fresh, ship


class Rule(NamedTuple):
    kind: str
    pattern: str
    any_case: bool = False
    #: A match of the pattern counts if it has so many characters; with `value`, if that part of it has.
    least: int = 0
    value: str = ""
    #: What a match may go on with; matches the empty text.
    tail: str = ""


# What may stand between the lines of a key (escaped line ends, quotation and string marks included), a
# line of the armor's headers, and the rest of a key behind its BEGIN marker, with and without an END marker.
_GAP = r"""([\x20\x09\x0d\x0a>#"',]|\\n|\\r)+"""
_HEADER = _GAP + r"[A-Z][A-Za-z]*(-[A-Z][A-Za-z]*)*:\x20(-?[\x20-,.-\x7e\x80-\xff])*"
_KEY_END = r"(-?-?-?-?[\x00-,.-\xff])*-----END ([A-Z]+ )*PRIVATE KEY( BLOCK)?-----"
_KEY_LINES = f"({_HEADER})*({_GAP}[A-Za-z0-9+/=]{{24,}})+({_GAP}[A-Za-z0-9+/=]+)?({_GAP}=[A-Za-z0-9+/]+)?"

#: Fixed values. The order is that of the report.
RULES = (
    Rule("assign", r"""((password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)[A-Za-z0-9+/_.=-]+""", True, 6, r"""[a-z_]+["']?\x20*[:=]\x20*["']?"""),
    Rule("access", r"AKIA[A-Z0-9]+", False, 20),
    Rule("hex", r"[0-9a-f]{24,}", False, 24),
    Rule("private_key", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY( BLOCK)?-----", tail=f"({_KEY_END}|{_KEY_LINES})?"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", False, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", False, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", False, 39),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", False, 32),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", False, 40),
)
BASE_KINDS = ("assign", "access", "hex")


# --- regex to nondeterministic automaton -----------------------------------------------------------------


class _Nfa:
    """States are numbers; step[s] holds (bytes, target), skip[s] the targets without input."""

    def __init__(self) -> None:
        self.step: list[list[tuple[frozenset[int], int]]] = []
        self.skip: list[list[int]] = []

    def state(self) -> int:
        self.step.append([])
        self.skip.append([])
        return len(self.step) - 1


def _char_set(pattern: str, at: int) -> tuple[frozenset[int], int]:
    """The bytes of the class, escape or literal at `at`, and the place after it."""

    def one(i: int) -> tuple[int, int]:
        if pattern[i] != "\\":
            return ord(pattern[i]), i + 1
        if pattern[i + 1] == "x":
            return int(pattern[i + 2 : i + 4], 16), i + 4
        return ord(pattern[i + 1]), i + 2

    if pattern[at] != "[":
        value, at = one(at)
        return frozenset([value]), at
    members, at = set(), at + 1
    while pattern[at] != "]":
        low, at = one(at)
        high = low
        if pattern[at] == "-" and pattern[at + 1] != "]":
            high, at = one(at + 1)
        members.update(range(low, high + 1))
    return frozenset(members), at + 1


def _parse(pattern: str, any_case: bool) -> tuple:
    """A tree of ("set", bytes), ("cat", …), ("or", …), ("rep", node, least, endless)."""
    at = 0

    def alternatives() -> tuple:
        nonlocal at
        out = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            out.append(sequence())
        return ("or", *out) if len(out) > 1 else out[0]

    def sequence() -> tuple:
        nonlocal at
        out = []
        while at < len(pattern) and pattern[at] not in "|)":
            if pattern[at] == "(":
                at += 1
                node = alternatives()
                at += 1
            else:
                chars, at = _char_set(pattern, at)
                if any_case:
                    chars |= {c ^ 32 for c in chars if chr(c).isascii() and chr(c).isalpha()}
                node = ("set", chars)
            if at < len(pattern) and pattern[at] in "?*+{":
                if pattern[at] == "{":
                    end = pattern.index(",}", at)
                    least, endless, at = int(pattern[at + 1 : end]), True, end + 2
                else:
                    least, endless = int(pattern[at] == "+"), pattern[at] != "?"
                    at += 1
                node = ("rep", node, least, endless)
            out.append(node)
        return ("cat", *out)

    tree = alternatives()
    if at != len(pattern):
        raise ValueError(f"cannot read rule {pattern!r} at {at}")
    return tree


def _build(nfa: _Nfa, tree: tuple, start: int, back: bool) -> int:
    """Add the tree after `start` (mirrored if `back`); returns the state in which it ends."""
    kind, *parts = tree
    if kind == "set":
        end = nfa.state()
        nfa.step[start].append((parts[0], end))
        return end
    if kind == "cat":
        for part in reversed(parts) if back else parts:
            start = _build(nfa, part, start, back)
        return start
    if kind == "or":
        end = nfa.state()
        for part in parts:
            begin = nfa.state()
            nfa.skip[start].append(begin)
            nfa.skip[_build(nfa, part, begin, back)].append(end)
        return end
    node, least, endless = parts
    for _ in range(least):
        start = _build(nfa, node, start, back)
    begin, end = nfa.state(), nfa.state()
    nfa.skip[start] += [begin, end]
    last = _build(nfa, node, begin, back)
    nfa.skip[last].append(end)
    if endless:
        nfa.skip[last].append(begin)
    return end


# --- deterministic automaton -----------------------------------------------------------------------------


class Automaton(NamedTuple):
    """table[state][classes[byte]] is the next state; state 0 is the start; hits[state] has bit r if rule r ends
    there. dead is the state without way out, or -1. States that report nothing come first: below `quiet`."""

    classes: bytes
    table: list[list[int]]
    hits: list[int]
    dead: int
    quiet: int


def compile_rules(rules: list[tuple[str, bool]], search: bool, back: bool = False) -> Automaton:
    """search: a match may begin anywhere; otherwise only at the first byte."""
    nfa = _Nfa()
    root = nfa.state()
    ends = {}
    for number, (pattern, any_case) in enumerate(rules):
        begin = nfa.state()
        nfa.skip[root].append(begin)
        ends[_build(nfa, _parse(pattern, any_case), begin, back)] = 1 << number
    # Bytes that no rule tells apart share a class.
    edges = {chars for out in nfa.step for chars, _ in out}
    signature = {b: tuple(b in chars for chars in edges) for b in range(256)}
    classes = {s: i for i, s in enumerate(dict.fromkeys(signature.values()))}
    byte_class = [classes[signature[b]] for b in range(256)]
    sample = {i: b for b, i in enumerate(byte_class)}

    @cache
    def closure(state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for t in nfa.skip[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if nfa.step[s] or s in ends)

    moves = [[frozenset().union(*[closure(t) for chars, t in out if sample[c] in chars]) for c in range(len(classes))] for out in nfa.step]
    first = closure(root)
    known, order, table = {first: 0}, [first], []
    for members in order:
        row = []
        for c in range(len(classes)):
            target = frozenset().union(*[moves[s][c] for s in members], first if search else frozenset())
            if target not in known:
                known[target] = len(order)
                order.append(target)
            row.append(known[target])
        table.append(row)
    hits = [sum({ends[s] for s in members if s in ends}) for members in order]
    # Minimise: split blocks by hits, then by the blocks their rows lead to, until nothing changes.
    block = hits
    count = 0
    while True:
        names: dict[tuple, int] = {}
        block = [names.setdefault((block[s], *[block[t] for t in table[s]]), len(names)) for s in range(len(table))]
        if len(names) == count:
            break
        count = len(names)
    # Number the blocks anew: the start first, then those that report nothing, then the rest.
    some = {b: s for s, b in reversed(list(enumerate(block)))}
    numbers = sorted(some, key=lambda b: (hits[some[b]] != 0, b != block[0], b))
    new = {b: i for i, b in enumerate(numbers)}
    rows = [[new[block[table[some[b]][c]]] for c in range(len(classes))] for b in numbers]
    kept = [hits[some[b]] for b in numbers]
    dead = next((i for i, row in enumerate(rows) if not kept[i] and set(row) == {i}), -1)
    return Automaton(bytes(byte_class), rows, kept, dead, sum(not h for h in kept))


class Scanner:
    """All rules of one rule set, compiled."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        plain = [(r.pattern, r.any_case) for r in rules]
        self.all = compile_rules(plain, search=True)
        self.starts = [compile_rules([p], search=True, back=True) for p in plain]
        self.ends = [compile_rules([(r.pattern + r.tail, r.any_case)], search=False) for r in rules]
        if any(a.hits[0] for a in (self.all, *self.ends)):
            raise ValueError("a rule matches the empty text")

    def which(self, data: bytes) -> int:
        """The rules that match anywhere in data, as bits: one look-up per byte."""
        table, hits, quiet = self.all.table, self.all.hits, self.all.quiet
        state = found = 0
        for b in data.translate(self.all.classes):
            state = table[state][b]
            if state >= quiet:
                found |= hits[state]
        return found

    def matches(self, rule: int, data: bytes) -> list[tuple[int, int]]:
        """Byte spans of the rule's matches: leftmost, longest, not overlapping."""
        table, quiet, seen = self.starts[rule].table, self.starts[rule].quiet, data.translate(self.starts[rule].classes)
        starts, state = [], 0
        for i in range(len(data) - 1, -1, -1):
            state = table[state][seen[i]]
            if state >= quiet:
                starts.append(i)
        table, quiet, dead, seen = self.ends[rule].table, self.ends[rule].quiet, self.ends[rule].dead, data.translate(self.ends[rule].classes)
        out, after = [], 0
        for start in reversed(starts):
            if start < after:
                continue
            state, after = 0, start + 1
            for i in range(start, len(data)):
                state = table[state][seen[i]]
                if state == dead:
                    break
                if state >= quiet:
                    after = i + 1
            out.append((start, after))
        return out

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, end, rule) in code points, by start and then rule."""
        data = (text or "").encode("utf-8", "surrogatepass")
        found = self.which(data)
        if not found:
            return []
        wide = [] if data.isascii() else [i for i, b in enumerate(data) if b & 0xC0 == 0x80]
        out = []
        for number, rule in enumerate(self.rules):
            if found >> number & 1:
                for start, end in self.matches(number, data):
                    least = end - start
                    if rule.value:
                        least -= re.match(rule.value, data[start:end].decode("ascii"), re.I).end()
                    if least >= rule.least:
                        out.append((start - bisect_left(wide, start), end - bisect_left(wide, end), number))
        return sorted(out, key=lambda x: (x[0], x[2]))


@cache
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """Compiled once per Python process."""
    return Scanner(rules)


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def with_secrets(docs: DataFrame, text_col: str = "text", name: str = "secrets", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, str]:
    """Add an array of (kind, start, end), by start and then rule order; returns the frame and the column's
    name (changed if the frame has a column of that name)."""
    held = fresh(docs, name)

    def found(texts: pa.Array) -> pa.Array:
        scan = scanner(rules)
        return pa.array([[{"kind": rules[r].kind, "start": s, "end": e} for s, e, r in scan.spans(t)] for t in texts.to_pylist()], _ARROW)

    return ship(docs).withColumn(held, arrow_column(found, SPANS)(F.col(text_col))), held


def redacted(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with each stretch of text that some span covers replaced by [secret]."""

    def cut(texts: pa.Array) -> pa.Array:
        scan, out = scanner(rules), []
        for text in texts.to_pylist():
            spans = scan.spans(text)
            pieces, at = [], 0
            for start, end, _ in spans:
                if start >= at:
                    pieces += [text[at:start], "[secret]"]
                at = max(at, end)
            out.append("".join([*pieces, text[at:]]) if spans else text)
        return pa.array(out, pa.string())

    return ship(docs).withColumn(text_col, arrow_column(cut, T.StringType())(F.col(text_col)))
