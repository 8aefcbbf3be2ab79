"""Golden vectors: every template's rules, scores, actions, policy outcome and structure features."""

import re

import pytest
from pyspark.sql import functions as F

from querywarden.functions.catalogue import PATTERN_LABELS
from querywarden.functions.patterns import with_suspicious_patterns
from querywarden.functions.structure import TREE_FEATURES, tree_similarity, with_structure
from querywarden.operators.keyword import keyword_scan
from querywarden.operators.policy import enforce_policy
from querywarden.operators.verdict import EVALUATION, score
from querywarden.plans.querylog import TEMPLATES

FIXTURES = __file__.replace("tests/test_golden.py", "FIXTURES.md")
LETTER = dict(zip(PATTERN_LABELS, "CTDPU", strict=True))


def _table(header):
    lines = open(FIXTURES, encoding="utf-8").read().split("\n")
    at = next(i for i, line in enumerate(lines) if line.startswith(header))
    rows = []
    for line in lines[at + 2 :]:
        if not line.startswith("|"):
            break
        rows.append([c.strip() for c in line.strip("|").split("|")])
    return rows


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(i, t.replace("{c}", "370").replace("{k}", "7")) for i, (t, _, _) in enumerate(TEMPLATES)]
    return spark.createDataFrame(rows, "tid INT, sql STRING")


def _by_tid(df):
    return {r["tid"]: r for r in df.collect()}


def test_rules_and_verdicts(golden):
    scan, pats = _by_tid(keyword_scan(golden)), _by_tid(with_suspicious_patterns(golden))
    default, evaluated = _by_tid(score(golden)), _by_tid(score(golden, config=EVALUATION))
    rows = _table("| tid | Rules |")
    assert len(rows) == len(TEMPLATES)
    for tid, rules, risk, patterns, formed, by_default, by_eval in rows:
        tid = int(tid)
        assert ", ".join(scan[tid]["matched_rules"]) == rules.replace("–", ""), tid
        assert f"{scan[tid]['keyword_risk_score']:.4f}" in (risk, f"{float(risk) - 1e-12:.4f}"), tid
        assert "".join(LETTER[f] for f in LETTER if pats[tid][f]) == patterns.replace("–", ""), tid
        assert default[tid]["ast_parsed"] == (formed == "yes"), tid
        for got, want in ((default[tid], by_default), (evaluated[tid], by_eval)):
            value, action = want.split()
            assert got["action"] == action, tid
            assert abs(got["overall_risk_score"] - float(value)) < 5e-5, tid
            assert got["is_toxic"] == (action != "ALLOW")


def test_policy(golden):
    strict, lenient = _by_tid(enforce_policy(golden, level="strict")), _by_tid(enforce_policy(golden))
    structure = {"multi": "Multiple statements", "nest": "Excessive nesting", "quotes": "Unbalanced quotes"}
    for tid, violations, in_strict, in_lenient in _table("| tid | Strict violations |"):
        tid = int(tid)
        parts = [[] if p.strip() == "–" else p.strip().split(", ") for p in violations.split(" / ")]
        want = (
            [f"Forbidden keyword detected: {k}" for k in parts[0]]
            + [f"Dangerous function detected: {k}" for k in parts[1]]
            + [f"Suspicious pattern detected: {k}" for k in parts[2]]
        )
        got = strict[tid]["violations"]
        assert got[: len(want)] == want, tid
        assert [g.startswith(structure[s]) for g, s in zip(got[len(want) :], parts[3], strict=True)] == [True] * len(parts[3])
        for row, text in ((strict[tid], in_strict), (lenient[tid], in_lenient)):
            value, action = text.split()
            assert f"{row['risk_score']:.2f}" == value and row["action"] == action, tid
            assert row["allowed"] == (action == "ALLOW")


def test_structure(golden, spark):
    full = with_structure(golden)
    base = full.filter("tid = 0").select(F.col("tree").alias("base"))
    rows = _by_tid(full.join(F.broadcast(base)).withColumn("sim", tree_similarity(F.col("tree"), F.col("base"))))
    for line in _table("| tid | node |"):
        tid, counts, kind, complexity, columns, sim = int(line[0]), line[1:9], line[9], line[10], line[11], line[12]
        row = rows[tid]
        if tid in (33, 35):
            assert row["tree"] is None and row["skeleton"] is None
            continue
        assert [row["tree"][f] for f in TREE_FEATURES[:8]] == [int(c) for c in counts], tid
        assert row["tree"]["query_type"] == kind
        assert (row["skeleton"]["condition_complexity"], row["skeleton"]["column_count"]) == (int(complexity), int(columns)), tid
        assert round(row["sim"] * 9) == int(sim), tid


def test_every_rule_fires_somewhere(golden):
    names = {n for r in keyword_scan(golden).select("matched_rules").collect() for n in r[0]}
    assert len(names) == 25
    assert all(re.fullmatch(r"[a-z0-9_]+", n) for n in names)
