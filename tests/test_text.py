"""Cleaning and masking against plain loops written from their definitions."""

import random
import re

from pyspark.sql import functions as F

from querywarden.functions.signals import char_entropy, token_entropy
from querywarden.functions.structure import with_structure
from querywarden.functions.text import masked, with_clean_sql
from querywarden.operators.keyword import keyword_scan
from querywarden.operators.policy import check_boundaries
from querywarden.operators.verdict import score

PIECES = ["a", "OR", "or ", " 1", "=", "1", ";", "'", '"', "(", ")", " ", "\n", "--", "/*", "*/", "intersect", "UNION", "''", "ſ", "OR 'a'='b'", "OR 1=1"]


def clean_loop(text):
    t = " ".join(text.split())
    t = re.sub(r";? ?or +1 ?= ?1 ?;?$", "", t, flags=re.I)
    t = re.sub(r";? ?or +'[^']+' ?= ?'[^']+' ?;?$", "", t, flags=re.I)
    while True:
        start = t.find('"')
        end = t.find('"', start + 1) if start >= 0 else -1
        if end < 0:
            break
        t = t[:start] + "\0" + t[start + 1 : end].replace("'", "''") + "\0" + t[end + 1 :]
    t = t.replace("\0", "'")
    for word in ("INTERSECT", "UNION"):
        t = re.sub(rf"\b{word}\b", word, t, flags=re.I)
    t = re.sub(r"\bor ?$", "", t, flags=re.I)
    t = re.sub(r"; ?or +", "; ", t, flags=re.I)
    while t.count(")") > t.count("("):
        t = t[: t.rindex(")")]
    return " ".join(t.split())


def mask_loop(text):
    """Scan left to right; a literal ends at the first quote that is not doubled."""
    out, i = [], 0
    while i < len(text):
        if text[i] == "'":
            j, last = i + 1, -1
            while j < len(text):
                if text[j] == "'":
                    if text[j + 1 : j + 2] == "'":
                        last = j
                        j += 2
                        continue
                    break
                j += 1
            if j >= len(text):
                j = last  # no closing quote: the first of the last doubled pair closes it
            if j > i:
                out.append(" '' ")
                i = j + 1
                continue
        elif text.startswith("--", i):
            out.append("  ")
            break
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            if end >= 0:
                out.append("  ")
                i = end + 2
                continue
        out.append(text[i])
        i += 1
    return "".join(out)


def test_clean_and_mask_equal_the_loops(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(6000)]
    texts += ["a) ) ( b)", "c = \"d'e\" f \"g"]
    df = with_clean_sql(spark.createDataFrame(list(enumerate(texts)), "id INT, t STRING"), "t", "c")
    for row in df.withColumn("m", F.expr(masked("c"))).collect():
        assert row["c"] == clean_loop(row["t"]), row["t"]
        assert row["m"] == mask_loop(row["c"]), row["c"]


def test_worked_examples(spark):
    df = spark.createDataFrame([("a) ) ( b)",), ("c = \"d'e\" f \"g",)], "t STRING")
    assert [r["c"] for r in with_clean_sql(df, "t", "c").collect()] == ["a", "c = 'd''e' f \"g"]


def test_long_hostile_text_is_scored_whole(spark):
    """Long literals must not overflow the regex engine's stack, and no pattern may go quadratic."""
    n = 200_000
    texts = ["'" + "''" * n, "'" + "x" * n + "'", "(" * n, "/* " * n, "*/" + "/* " * n, "select " * n, "or 1=" * n, "\"'" * n, "a) " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, sql STRING").repartition(8)
    rows = {r["id"]: r for r in score(df).collect()}
    assert len(rows) == len(texts)
    assert not rows[0]["ast_parsed"] and rows[1]["ast_parsed"] and not rows[2]["ast_parsed"]
    assert len(check_boundaries(df).collect()) == len(texts)
    found = df.select("id", char_entropy(F.col("sql")).alias("c"), token_entropy(F.col("sql")).alias("t")).collect()
    values = {r["id"]: (round(r["c"], 3), round(r["t"], 3)) for r in found}
    assert values[0] == (0.0, 0.0) and values[1] == (0.0, 0.0) and values[7] == (1.0, 0.0) and values[5][1] == 0.0


def test_filters_stay_above_the_scan(spark):
    """A filter on a derived column must neither repeat the regexes nor blow the plan up."""
    df = spark.createDataFrame([(1, "SELECT 1 OR 1=1")], "id INT, sql STRING")
    for frame in (keyword_scan(df).filter("flagged"), score(df).filter("is_toxic"), with_structure(df).filter("skeleton.has_where")):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RLIKE") <= 25
        assert len(plan) < 60_000
    assert score(df).filter("is_toxic").count() == 1
