"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one integer whose bit i
is set if rule i failed. A policy is a named, versioned set of rules, so applying another policy, or
asking what a policy would do without one of its rules, reads the stored bits and no text.

A null text has no words (every count is 0) and fails `too_few_words`. An empty table gives an empty
ledger; repeated rows give repeated ledger rows; columns of any other name pass through unchanged.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querywarden.llm.base import WORD, arrow_column, fresh, ship

#: Words that mark abuse.
FLAGGED = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_alpha_words", "n_upper_words", "n_flagged",
)

#: Rule i fails if its expression over the measurements holds. Integers only, so every engine agrees.
RULES = {
    "too_few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbol_density": "10 * n_symbols > n_words",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "no_letters": "100 * n_alpha_words < 70 * n_words",
    "shouting": "100 * n_upper_words > 50 * n_words",
    "flagged_words": "n_flagged >= 3 AND 200 * n_flagged > n_words",
}

#: Versioned policies: a document is kept if none of the named rules failed.
POLICIES = {
    "base": ("too_few_words", "repeated_words"),
    "v1": ("too_few_words", "repeated_words", "symbol_density", "duplicate_lines", "short_words", "long_words", "no_letters"),
    "v2": tuple(RULES),
}

_WORD = re.compile(WORD)
_SYMBOL = re.compile(r"[#*$%&|<>]")
# Whole words: "closer" holds no "loser".
_FLAGGED = re.compile(rf"(?<![^\W\d_])(?:{'|'.join(FLAGGED)})(?![^\W\d_])")


def mask(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(rule) for rule in POLICIES[policy])


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    if not text:
        return (0,) * len(MEASURES)
    words = _WORD.findall(text)
    n = len(words)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    repeated = 0
    if len(counts) < len(windows):
        covered = bytearray(n)
        for i, window in enumerate(windows):
            if counts[window] > 1:
                covered[i : i + 3] = b"\1\1\1"
        repeated = covered.count(1)
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    alpha = sum(map(str.isalpha, words))
    if alpha < n:  # words with a letter anywhere, in ASCII or beyond
        alpha = sum(w.isalpha() or any(map(str.isalpha, w)) for w in words)
    return (
        n, sum(map(len, words)), len(_SYMBOL.findall(text)), len(lines), len(lines) - len(set(lines)), repeated, alpha,
        sum(len(w) > 1 and w.isupper() for w in words), len(_FLAGGED.findall(text.lower())),
    )


def _measures(texts: pa.Array) -> pa.Array:
    rows = [measure(x) for x in texts.to_pylist()]
    columns = zip(*rows, strict=True) if rows else [()] * len(MEASURES)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(MEASURES))


_measured = arrow_column(_measures, T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))


def failed_bits(measures: str) -> Column:
    """The failure bits from a struct column of measurements."""
    bits = []
    for i, rule in enumerate(RULES.values()):
        expression = re.sub(r"\b(n_\w+|word_chars)\b", rf"`{measures}`.\1", rule)
        bits.append(f"CASE WHEN {expression} THEN {1 << i}L ELSE 0L END")
    return F.expr(" + ".join(bits))


def ledger(docs: DataFrame, text_col: str = "text", name: str = "ledger") -> tuple[DataFrame, str]:
    """Add one struct column with all measurements and `failed` (the failure bits); returns the frame and
    the column's name (changed if the frame has a column of that name)."""
    held = fresh(docs, name)
    raw = fresh(docs, held + "_raw")
    out = ship(docs).withColumn(raw, _measured(F.col(text_col)))
    fields = [F.col(raw)[m].alias(m) for m in MEASURES]
    return out.withColumn(held, F.struct(*fields, failed_bits(raw).alias("failed"))).drop(raw), held


def kept(failed: Column, policy: str) -> Column:
    return failed.bitwiseAND(F.lit(mask(policy))) == 0


def apply_policy(docs: DataFrame, policy: str = "v2", text_col: str = "text") -> DataFrame:
    """The documents that pass the policy, with their own columns only."""
    out, held = ledger(docs, text_col)
    return out.where(kept(F.col(held)["failed"], policy)).drop(held)


def ablations(ledgers: DataFrame, failed_col: str = "failed") -> DataFrame:
    """For each policy and rule: documents the rule fails, documents only that rule rejects (kept again
    without it), and documents kept. Reads one count per distinct bit pattern (2^rules at most)."""
    patterns = ledgers.groupBy(F.col(failed_col).alias("bits")).agg(F.count("*").alias("docs"))
    names = list(RULES)
    rows = [(p, r, mask(p), 1 << names.index(r)) for p in POLICIES for r in POLICIES[p]]
    rules = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(m).cast("long").alias("mask"), F.lit(b).cast("long").alias("bit")) for p, r, m, b in rows]))
    hit = F.col("bits").bitwiseAND(F.col("r.mask"))

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("docs"))), F.lit(0))

    return (
        patterns.select("bits", "docs", rules.alias("r"))
        .groupBy("r.policy", "r.rule")
        .agg(
            total(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("failed_docs"),
            total(hit == F.col("r.bit")).alias("rejected_by_it_alone"),
            total(hit == 0).alias("kept_docs"),
        )
    )
