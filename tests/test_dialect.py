"""Patterns must mean the same in Spark as in Python's re."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from querywarden.functions.catalogue import BUILTIN_RULES, POLICY_PATTERNS
from querywarden.functions.dialect import java_regex, matches, squeeze
from querywarden.functions.numbers import fixed

PIECES = [
    "OR", "or", "AND", "1", "=", "1=1", "'", "'a'", "true", "--", "/*", "*/", "#", " ", "  ", "\t", "\n", "\r",
    " ", " ", "\u0085", "\x1c", "sleep", "ſleep", "SLEEP", "(", ")", "pg_sleep(", "waitfor", "delay",
    "benchmark(", ";", "select", "ſelect", "drop", "table", "vıew", "VİEW", "union", "all", "null", "information_schema",
    "xp_cmdshell", "load_file(", "into", "outfile", "truncate", "insert", "update", "delete", "é", "x", "_", "́", "😀",
    "K", "cross", "join", "create",
]


def _python(pattern, flags):
    return re.compile(pattern, (re.I if "i" in flags else 0) | (re.S if "s" in flags else 0))


def _texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) + rng.choice(["", " "]) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_rules_agree_with_python_on_random_text(spark):
    texts = _texts(6000, 1)
    # The attacks themselves rarely come out of a random draw, so some are planted.
    for i, snippet in enumerate(
        ["OR 1=1", "or 1 = 1", "OR 'a'='b'c", "AND 'x' = 'y'é", "UNION ALL SELECT NULL", "; ſelect", "ſLEEP (", "/* \n */",
         "union select a\rfrom information_schema", "union select " + "x" * 119 + "--", "INTO OUTFILE", "DROP\tVıEW", "# "]
    ):
        for j in range(40):
            texts.append(texts[i * 40 + j] + snippet + texts[i * 40 + j + 1000])
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, t STRING").withColumn("f", F.expr(squeeze("t")))
    book = [(r.name, r.pattern, r.flags, r.needles) for r in BUILTIN_RULES]
    book += [("policy_" + n, p, "i", needles) for n, p, needles in POLICY_PATTERNS]
    gated = [F.expr(matches("t", "f", p, fl, needles)).alias(n) for n, p, fl, needles in book]
    plain = [F.expr(matches("t", "f", p, fl)).alias(n + "_plain") for n, p, fl, _ in book]
    compiled = {n: _python(p, fl) for n, p, fl, _ in book}
    fired = dict.fromkeys(compiled, 0)
    for row in df.select("t", *gated, *plain).collect():
        for name, pattern in compiled.items():
            want = pattern.search(row["t"]) is not None
            fired[name] += want
            assert row[name] == want, (name, row["t"])
            assert row[name + "_plain"] == want, (name, row["t"])
    assert sum(1 for n in fired.values() if n == 0) <= 4, fired


def test_word_and_space_classes_cover_the_same_characters(spark):
    old = unicodedata.ucd_3_2_0
    points = [c for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000 and old.category(chr(c)) not in ("Cn", "Co")]
    df = spark.createDataFrame([(c, chr(c)) for c in points], "c INT, t STRING")
    found = df.select(
        "c",
        F.col("t").rlike(java_regex(r"\w")).alias("w"),
        F.col("t").rlike(java_regex(r"\s")).alias("s"),
        F.col("t").rlike(java_regex(r"[^\s\w]")).alias("n"),
        F.concat(F.lit("a"), "t", F.lit("a")).rlike(java_regex(r"a\b.a")).alias("b"),
    )
    bad = []
    for r in found.collect():
        ch = chr(r["c"])
        word, space = re.match(r"\w", ch) is not None, re.match(r"\s", ch) is not None
        if (r["w"], r["s"], r["n"]) != (word, space, not word and not space) or r["b"] != (not word and ch != "\n"):
            bad.append((hex(r["c"]), unicodedata.category(ch)))
    assert bad == []


def test_fixed_rounds_like_python(spark):
    rng = random.Random(3)
    values = [0.485, 0.375, 0.3 / 0.8, 0.125, 0.275, 0.395, 0.6875, 0.0, 1.0, 0.005, 0.995, 2.675, 12.345]
    values += [rng.random() for _ in range(500)] + [rng.randint(0, 1000) / 1000 for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    for row in df.select("v", fixed(F.col("v"), 2).alias("two"), fixed(F.col("v"), 4).alias("four")).collect():
        assert row["two"] == f"{row['v']:.2f}", row
        assert row["four"] == f"{row['v']:.4f}", row


PYTHON_PATTERNS = [
    r"a\Wb", r"\S", r"\D+x", r"[a\W]b", r"[\S]", r"(?P<q>a)b", r"[^[]x", r"a{,3}b", r"[a&&b]", r"[]a]x", r"[^]a]x", r"a\vb", r"a\Z", r"x[&]y", r"[[]", r"(?:a|b)\d",
]
PROBES = ["aéb", "a b", "a-b", "\u00a0", " ", "1x", "éx", "٣x", "a٣", "ab", "aab", "aaaab", "[x", "yx", "a", "b", "&", "]x", "ax", "a\x0bb", "a\n", "x&y", "x]y", "", "ſ", "a1", "\u2003b"]


def test_python_spelling(spark):
    import re

    from pyspark.sql import functions as F
    from querywarden.functions.dialect import regex_literal

    frame = spark.createDataFrame([(p,) for p in PROBES], "t string")
    columns = [F.expr(f"t RLIKE {regex_literal(p)}").alias(f"p{i}") for i, p in enumerate(PYTHON_PATTERNS)]
    for row in frame.select("t", *columns).collect():
        for i, pattern in enumerate(PYTHON_PATTERNS):
            assert row[f"p{i}"] == bool(re.search(pattern, row.t)), (pattern, row.t)


def test_what_has_no_java_form_is_refused():
    import pytest
    from querywarden.functions.dialect import java_regex

    for pattern in (r"[^\W]", r"(?P=q)", r"(?i)a", r"(?#c)a", r"a\Bb", r"\N{DASH}"):
        with pytest.raises(ValueError):
            java_regex(pattern)
