"""Edge cases, properties and skew of the operators."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from querywarden.functions import signals
from querywarden.functions.catalogue import Rule
from querywarden.functions.structure import with_structure
from querywarden.operators import evaluation as ev
from querywarden.operators.alignment import check_alignment, join_gold
from querywarden.operators.keyword import keyword_explain, keyword_scan
from querywarden.operators.policy import check_boundaries, enforce_policy, policy_report, split_allowed, write_quarantine
from querywarden.operators.verdict import batch_score, score, verdict_explain
from querywarden.plans.querylog import as_corpus, query_log
from querywarden.sources.corpus import normalise_corpus


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def text(spark, sql, **more):
    values = {"sql": sql, **more}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} STRING" for k in values))


def test_null_blank_and_unicode(spark):
    null = one(score(text(spark, None)))
    assert (null["overall_risk_score"], null["action"], null["keyword_matched_rules"]) == (1.0, "REJECT", [])
    for blank in ("", " \t\n "):
        assert one(keyword_scan(text(spark, blank)))["recommendation"] == "ALLOW"
        got = one(score(text(spark, blank)))
        assert (got["overall_risk_score"], got["action"]) == (0.6, "REJECT")
    assert one(keyword_scan(text(spark, None)))["flagged"] is False
    assert one(keyword_scan(text(spark, "ſLEEP(1)")))["matched_rules"] == ["delay_sleep"]
    assert one(keyword_scan(text(spark, "x OR 1=1")))["matched_rules"] == ["tautology_or_1_eq_1"]
    hits = one(keyword_scan(text(spark, "😀😀😀😀😀😀😀😀😀😀😀😀 or\n1=1 and so on and on and on")))["match_details"]
    assert hits[0]["snippet"] == "...😀😀😀😀😀😀😀😀😀 or 1=1 and so on and on an..."


def test_policy_edges(spark):
    names = lambda sql: [v.split(": ")[-1] for v in one(check_boundaries(text(spark, sql)))["violations"]]
    assert "union_inject" in names("union all select a\rfrom information_schema")
    assert "union_inject" not in names("union all select a\nfrom information_schema")
    assert "comment_injection" in names("a\nb /* x */") and "comment_injection" not in names("/* a\n*/")
    long = "select 1 from t where " + "a" * 2001
    assert names(long) == ["Abnormally long WHERE clause"] and names(long[:-1]) == []
    assert names("XP_CMDSHELL") == []
    failed = one(enforce_policy(text(spark, None)))
    assert (failed["allowed"], failed["action"]) == (False, "REJECT")
    report = one(policy_report(check_boundaries(text(spark, "x" * 101))))
    assert report["sql_query"] == "x" * 101 and report["sql_shown"] == "x" * 100 + "..." and report["recommendations"] == ["Query passes policy checks"]
    extra = one(check_boundaries(text(spark, "select 0xAF"), extra_patterns={"hex": r"0x[0-9a-f]+"}))
    assert extra["violations"] == ["Suspicious pattern detected: hex"]
    df = text(spark, "DROP TABLE t").union(text(spark, "SELECT 1")).union(text(spark, None))
    good, bad = split_allowed(enforce_policy(df))
    assert (good.count(), bad.count()) == (1, 2)


def test_adding_a_rule_never_lowers_a_score(spark, sf):
    log = query_log(spark, sf)
    extra = [Rule("customer", r"\bcustomer\b", "custom", "LOW", weight=0.1)]
    a = keyword_scan(log).select("id", F.col("keyword_risk_score").alias("a"))
    b = keyword_scan(log, extra_rules=extra).select("id", F.col("keyword_risk_score").alias("b"))
    both = a.join(b, "id")
    assert both.filter("b < a").count() == 0 and both.filter("b > a").count() > 0
    assert both.filter("a < 0 or a > 1 or b > 1").count() == 0


def test_explain_texts(spark):
    got = one(keyword_explain(keyword_scan(text(spark, "SELECT 1 # x"))))["explanation"]
    assert got.split("\n")[0] == f"🚨 Query FLAGGED — risk score: {0.3 / 0.8:.2f}"
    got = one(verdict_explain(score(text(spark, "SELECT 1 FROM t -- x"))))["explanation"].split("\n")
    assert got[0] == f"⚠️ Action: FLAG_FOR_REVIEW  (risk={0.4 * 0.6875 + 0.6 * 0.2:.2f})"
    assert got[2] == "  Reasons:" and got[-1].endswith("suspicious=['SQL Comment detected']")


def test_batch_keys(spark):
    df = spark.createDataFrame([("SELECT 1",)], "q STRING")
    got = one(batch_score(df, sql_key="q", nlq_key="asked"))
    assert (got["action"], got["asked"]) == ("ALLOW", "")
    assert one(batch_score(df, sql_key="other"))["action"] == "REJECT"


def test_alignment_cases(spark):
    same = one(check_alignment(text(spark, "SELECT a FROM t", e="SELECT b FROM u"), expected_col="e"))["alignment"]
    assert same["alignment_score"] == 1.0 and same["details"]["skeleton_consistency"]["consistency_score"] == 1.0
    broken = one(check_alignment(text(spark, "SELECT 'a", e="SELECT 1"), expected_col="e"))["alignment"]
    assert broken["alignment_score"] == 0.0 and broken["anomaly_indicators"] == ["Failed to parse generated SQL"]
    assert broken["suspicious_patterns"] is None and broken["skeleton_analysis"]["generated"] is None
    for missing in (None, "", "SELECT 'x"):
        assert one(check_alignment(text(spark, "SELECT a", e=missing), expected_col="e"))["alignment"]["tree_similarity"] == 1.0


def test_gold_join_with_a_hot_key(spark):
    """A third of the rows share one key and many have none; nothing is lost or repeated."""
    n = 30_000
    gen = spark.range(n).repartition(16).select(
        "id",
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id").cast("string")).alias("question"),
        F.lit("d").alias("db_id"),
    )
    gold = spark.range(n).select(F.lit("d").alias("db_id"), F.col("id").cast("string").alias("question"), F.concat(F.lit("g"), F.col("id")).alias("gold_sql"))
    gold = gold.union(spark.createDataFrame([("d", "hot", "a"), ("d", "hot", "a")], gold.schema)).filter("question not like '%5'")
    got = join_gold(gen, gold)
    want = {}
    for r in gen.collect():
        q = r["question"]
        want[r["id"]] = "a" if q == "hot" else None if q is None or q.endswith("5") else "g" + q
    assert {r["id"]: r["expected_sql"] for r in got.collect()} == want
    assert got.count() == n
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {r["id"]: r["expected_sql"] for r in join_gold(gen, gold).collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_different_gold_texts_are_an_error(spark):
    gen = spark.createDataFrame([("d", "q", "x")], "db_id string, question string, sql string")
    gold = spark.createDataFrame([("d", "q", "z"), ("d", "q", "a")], "db_id string, question string, gold_sql string")
    with pytest.raises(Exception, match="several gold texts for d, q"):
        join_gold(gen, gold).collect()


@pytest.mark.parametrize(
    "sql,query_type,columns,where",
    [
        ("SELECT f(g(h(i(j(k(l(a,b),c),d),e),f),g),h) FROM t", "SELECT", 1, False),
        ("SELECT " + "f(" * 40 + "a,b" + ")" * 40 + ", c FROM t", "SELECT", 2, False),
        ("WITH a AS (SELECT x, y FROM t), b AS (SELECT 1) SELECT a.x FROM a WHERE x = 1", "SELECT", 1, True),
        ("WITH a AS (SELECT 1 UNION SELECT 2) SELECT p, q, r FROM a", "SELECT", 3, False),
        ("WITH a AS (SELECT 1) SELECT p FROM a UNION SELECT 2", "Union", 0, False),
        ("WITH a AS (SELECT 1) DELETE FROM t WHERE k IN (SELECT * FROM a)", "DELETE", 0, False),
        ("(((((SELECT a FROM t UNION SELECT b FROM u)))))", "Union", 0, False),
        ("((SELECT a, f(b, c) FROM t))", "SELECT", 2, False),
        ("(SELECT a FROM t UNION SELECT b FROM u) EXCEPT (SELECT c FROM v)", "Except", 0, False),
        ("SELECT a FROM (SELECT b UNION SELECT c)", "SELECT", 1, False),
        ("DROP TABLE t", "Drop", 0, False),
    ],
)
def test_root_of_a_query(spark, sql, query_type, columns, where):
    found = one(with_structure(text(spark, sql)))["skeleton"]
    assert (found["query_type"], found["column_count"], found["has_where"]) == (query_type, columns, where)


def scans(df):
    """How often the final plan matches the rule of a fixed pattern: once for each scoring pass."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return plan.count("FileScan parquet")


def test_gap_scores_once(spark, sf):
    from querywarden.plans.queries import REGISTRY

    assert scans(REGISTRY["overfit_gap"](spark, sf)) <= scans(REGISTRY["evaluation_report"](spark, sf))
    assert scans(REGISTRY["policy_quarantine"](spark, sf)) == scans(REGISTRY["policy_strict"](spark, sf))


def test_quarantine_is_written_in_one_pass(spark, tmp_path):
    df = text(spark, "DROP TABLE t").union(text(spark, "SELECT 1")).union(text(spark, None))
    write_quarantine(enforce_policy(df), str(tmp_path / "q"))
    found = spark.read.parquet(str(tmp_path / "q")).groupBy("allowed").count().collect()
    assert {str(r["allowed"]): r["count"] for r in found} == {"true": 1, "false": 2}


@pytest.mark.parametrize("digits", [1, 4])
@pytest.mark.parametrize("ratios", [(0.6, 0.2), (0.5, 0.0), (0.01, 0.98), (0.0, 0.3)])
def test_split_is_exact(spark, digits, ratios):
    rows = [(i, 0 if i % 5 else 1) for i in range(997)] + [(1000 + i, 2) for i in range(10)]
    df = spark.createDataFrame(rows, "id INT, toxic INT").repartition(7)
    got = ev.stratified_split(df, "id", "toxic", *ratios, seed=3, hex_digits=digits).collect()
    assert len(got) == 997 and len({r["id"] for r in got}) == 997
    sizes = Counter((r["toxic"], r["split"]) for r in got)
    for label, n in ((1, 200), (0, 797)):
        train, val = int(n * ratios[0]), int(n * ratios[1])
        assert (sizes[label, "train"], sizes[label, "val"], sizes[label, "test"]) == (train, val, n - train - val)


def test_split_rejects_bad_ratios(spark):
    with pytest.raises(ValueError):
        ev.stratified_split(spark.range(3).withColumn("toxic", F.lit(1)), train_ratio=0.8, val_ratio=0.2)


def _sweep_loop(rows):
    best = None
    for k in range(101):
        tp, fp, tn, fn = (sum(1 for y, s in rows if y == label and (s > k / 100) == hit) for label, hit in ((1, True), (0, True), (0, False), (1, False)))
        p, r = (tp / (tp + fp) if tp + fp else 0.0), (tp / (tp + fn) if tp + fn else 0.0)
        f1 = 2 * p * r / (p + r) if p + r else 0.0
        if best is None or f1 > best[1]:
            best = (k / 100, f1, tp, fp, tn, fn)
    return best


def test_sweep_equals_the_loop(spark):
    import random

    rng = random.Random(9)
    for case in range(4):
        values = [k / 100 for k in range(101)] + [0.285, 0.29 + 1e-16, 0.57, 0.58 - 1e-16, 1.0, 0.0, 2.0]
        rows = [(rng.randint(0, 1), rng.choice(values) if case else 0.5) for _ in range(400)]
        df = spark.createDataFrame(rows, "label INT, score DOUBLE").withColumns({"pred_hard": F.lit(0), "split": F.lit("val")})
        best = one(ev.best_threshold(ev.sweep_curve(ev.outcome_cube(df))))
        want = _sweep_loop(rows)
        assert (best["threshold"], best["f1"], best["tp"], best["fp"], best["tn"], best["fn"]) == want
    below = spark.createDataFrame([(v,) for v in values], "s DOUBLE").select("s", ev.thresholds_below(F.col("s")).alias("n"))
    for r in below.collect():
        assert r["n"] == sum(1 for k in range(101) if k / 100 < r["s"]), r


def test_metrics_with_nothing_predicted_and_odd_labels(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (2, 1)], "label INT, p INT")
    got = one(ev.compute_metrics(df, "label", "p"))
    assert (got["precision"], got["f1"], got["tp"], got["fn"], got["tn"]) == (0.0, 0.0, 0, 2, 1)


def test_evaluation_end_to_end_scores_once(spark, sf, tmp_path):
    run = ev.run_evaluation(normalise_corpus(as_corpus(query_log(spark, sf))))
    assert "RLIKE" not in run.metrics._jdf.queryExecution().optimizedPlan().toString()
    report = one(run.report)
    assert report["train"]["n"] + report["validate"]["n"] + report["test"]["n"] == 1500
    curve = run.curve.filter("split = 'val'").agg(F.max("f1")).first()[0]
    assert report["validate"]["sweep"]["f1"] == curve
    assert run.rows.filter("pred_sweep != cast(score > %s as int)" % report["config"]["best_threshold_from_val"]).count() == 0


def test_signals(spark):
    row = one(
        spark.createDataFrame([("aabb", "a b a c", "SELECT name FROM t", "the name of")], "t STRING, w STRING, sql STRING, nlq STRING").select(
            signals.char_entropy(F.col("t")).alias("c"), signals.token_entropy(F.col("w")).alias("w"),
            signals.keyword_overlap(F.col("sql"), F.col("nlq")).alias("o"), signals.char_entropy(F.lit("")).alias("empty"),
            signals.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("cos"),
            signals.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("zero"),
            signals.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0), F.lit(2.0))).alias("odd"),
        )
    )
    assert (row["c"], row["w"], row["o"], row["empty"], row["zero"], row["odd"]) == (1.0, 1.5, 0.5, 0.0, 0.0, None)
    assert abs(row["cos"] - 0.5**0.5) < 1e-12
