"""Structure of gold texts: taken once for each key, in steps that the JVM compiles, by patterns that look ahead."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from querywarden.functions import structure
from querywarden.functions.dialect import regex_literal
from querywarden.functions.structure import with_structure
from querywarden.operators.alignment import EXPECTED_COLUMNS, check_alignment, join_gold, with_alignment
from querywarden.operators.verdict import score

GOLD = [("d", "q1", "SELECT a, b FROM t WHERE x = 1"), ("d", "q1", "SELECT a, b FROM t WHERE x = 1"), ("d", None, "SELECT '"), ("e", "q1", ""), ("e", "q2", None), ("e", "q3", " ")]
ROWS = [
    (i, d, q, s)
    for i, (d, q, s) in enumerate(
        (d, q, s) for d in ("d", "e", None) for q in ("q1", "q2", "q3", "", None) for s in ("SELECT a FROM t", "SELECT a, b FROM t WHERE x = 1", "SELECT '", "", None)
    )
]


def frames(spark):
    generated = spark.createDataFrame(ROWS * 2, "id long, db_id string, question string, sql string")
    return generated, spark.createDataFrame(GOLD, "db_id string, question string, gold_sql string")


@pytest.mark.parametrize("spread", [None, True, False])
def test_joined_structure_gives_the_results_of_a_row(spark, spread):
    generated, gold = frames(spark)
    plain, structured = join_gold(generated, gold, spread=spread), join_gold(generated, gold, spread=spread, structure=True)
    assert structured.columns == [*plain.columns, *EXPECTED_COLUMNS]
    for how in (with_alignment, check_alignment, score):
        want, got = how(plain, expected_col="expected_sql"), how(structured, expected_col="expected_sql", structured=True)
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())), how
        assert got.count() == len(ROWS) * 2


@pytest.mark.parametrize("name", ["alignment_check", "tree_similarity", "skeleton_consistency", "fused_with_gold"])
def test_gold_texts_are_taken_apart_below_the_join(spark, sf, name):
    plan = __spark_entry__.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_expected_mask") and plan.index("Join LeftOuter") < plan.index("_expected_mask")


@pytest.mark.parametrize("name", ["skeleton", "alignment_check", "tree_similarity", "fused_with_gold"])
def test_generated_methods_are_small_enough_to_be_compiled(spark, sf, name):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = __spark_entry__.queries()[name](spark, sf)
        shown = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", shown)]
    assert sizes and max(sizes) < 8000


def test_looking_ahead_loses_no_word(spark):
    words = [w for ws in (structure._CLAUSES, structure._JOINS, structure._VERBS, ("AND", "OR", "NOT", "WHERE", "KEY")) for w in ws]
    spellings = {v for w in words for v in (w, w.lower(), w.replace("S", "ſ"), w.replace("I", "ı"), w.replace("I", "İ"), w.replace("K", "K"), f"x{w}", f"{w}_", w[1:])}
    df = spark.createDataFrame([(" ".join((v, "a,", v, "(")) + v,) for v in sorted(spellings)], "t string")
    for some in (structure._SET_OPERATORS, structure._CLAUSES, structure._JOINS, structure._VERBS, tuple(words)):
        plain = "(?:" + "|".join(rf"\b{w}" for w in some) + r")\b"
        hits = [f"regexp_extract_all(t, {regex_literal(p, 'isc')}, 0)" for p in (plain, structure._words(*some))]
        assert df.where(f"NOT {hits[0]} <=> {hits[1]}").count() == 0 < df.where(f"size({hits[0]}) > 0").count()
    calls = "SELECT COUNT(a), ſum (b), Avg(c), mın(d), MAX(e), StdDev_x(f), variance(g), ARRAY_AGG(h), string_agg(i), group_concat(j), MEDıAN(k), f(l) FROM t"
    assert with_structure(spark.createDataFrame([(calls,)], "sql string")).select(F.col("tree.aggregate_count")).first()[0] == 11
