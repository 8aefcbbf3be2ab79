"""Skewed joins, running sums, nearest gold, rules as a table, replayed streams."""

import math
import random
import re
from collections import Counter
from statistics import median

import pytest
from pyspark.sql import functions as F
from querywarden.functions.catalogue import BUILTIN_RULES, Rule
from querywarden.functions.structure import TREE_FEATURES, with_structure
from querywarden.operators import divergence
from querywarden.operators import evaluation as ev
from querywarden.operators.alignment import join_gold
from querywarden.operators.divergence import corpus_divergence, merge_models, token_model
from querywarden.operators.keyword import keyword_scan
from querywarden.operators.nearest import nearest_gold
from querywarden.operators.ruletable import indexed_hits, required_literal, rule_index
from querywarden.operators.skew import hot_keys, running_sums, spread_join
from querywarden.plans.querylog import query_log
from querywarden.streaming.guard import start_guard


@pytest.fixture
def settings(spark):
    before = {}

    def put(**values):
        for k, v in values.items():
            name = "spark.sql." + k.replace("__", ".")
            before.setdefault(name, spark.conf.get(name))
            spark.conf.set(name, v)

    yield put
    for k, v in before.items():
        spark.conf.set(k, v)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- joins -------------------------------------------------------------------------------------


def hot_rows(spark, n):
    """Half of the rows ask one question of one database; 40 databases in all."""
    hot = F.col("id") % 2 == 0
    return spark.range(n).repartition(16).select(
        "id",
        F.when(hot, F.lit("d0")).otherwise(F.concat(F.lit("d"), (F.col("id") % 40).cast("string"))).alias("db_id"),
        F.when(hot, F.lit("hot")).otherwise((F.col("id") % 5000).cast("string")).alias("question"),
    )


def task_sizes(joined):
    """Rows of each task behind the join; the joined column is read, or the join would be left out."""
    found = joined.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.count("expected_sql"))
    return [r.n for r in found.collect()]


def test_the_rows_of_a_hot_question_are_dealt_over_all_tasks(spark, settings):
    settings(autoBroadcastJoinThreshold="-1", adaptive__enabled="false", shuffle__partitions="16")
    n = 200_000
    rows = hot_rows(spark, n)
    gold = rows.where("question like '%1' or question = 'hot'").select("db_id", "question", F.concat_ws(":", "db_id", "question").alias("gold_sql")).distinct()
    joined = join_gold(rows, gold)
    sizes = task_sizes(joined)
    assert len(sizes) == 16 and sum(sizes) == n and max(sizes) <= 2 * median(sizes)
    assert max(task_sizes(join_gold(rows, gold, spread=False))) >= n / 2
    q, d = F.col("question"), F.col("db_id")
    want = F.when(q.like("%1") | (q == "hot"), F.concat_ws(":", d, q))
    assert joined.where(~F.col("expected_sql").eqNullSafe(want)).count() == 0
    assert joined.select("id").distinct().count() == n
    shown = plan(joined)
    assert "CartesianProduct" not in shown and "BroadcastNestedLoopJoin" not in shown


def test_hot_keys_are_few_and_other_joins_agree(spark, settings):
    settings(autoBroadcastJoinThreshold="-1", shuffle__partitions="4")
    rows = hot_rows(spark, 4000)
    assert hot_keys(rows, ["db_id", "question"], "s").count() < 16 * 4
    right = rows.where("id % 3 = 0").select("db_id", "question", F.col("id").alias("other"))  # several rows for a key
    for how in ("left", "inner"):
        got, want = spread_join(rows, right, ["db_id", "question"], how), rows.join(right, ["db_id", "question"], how)
        assert got.count() == want.count() and got.select(*want.columns).exceptAll(want).isEmpty()
    assert spread_join(rows.limit(0), right, ["db_id", "question"]).count() == 0


def test_running_sums(spark, settings):
    settings(shuffle__partitions="7")
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.randrange(9)) for i in range(3000)]
    rng.shuffle(rows)
    got = running_sums(spark.createDataFrame(rows, "g string, o int, v int").repartition(5), ["o"], ["v"], ["g"])
    total, sums, want = Counter(), Counter(), set()
    for g, _, v in rows:
        total[g] += v
    for g, o, v in sorted(rows, key=lambda r: r[1]):
        sums[g] += v
        want.add((g, o, v, sums[g], total[g]))
    assert {tuple(r) for r in got.select("g", "o", "v", "sum_v", "all_v").collect()} == want
    alone = running_sums(spark.range(1000).select("id", F.lit(1).alias("v")), ["id"], ["v"])
    assert alone.where("sum_v <> id + 1 or all_v <> 1000").isEmpty() and alone.columns == ["id", "v", "sum_v", "all_v"]


# ---- nearest gold ------------------------------------------------------------------------------


def trees_of(spark, rows, column):
    found = with_structure(spark.createDataFrame(rows, f"db_id string, {column} string"), column)
    return [(r.db_id or "", r[column], tuple(r.tree) if r.tree else None) for r in found.collect()]


def test_nearest_gold_is_that_of_all_pairs(spark):
    rng = random.Random(5)
    parts = ["SELECT a", "SELECT a, COUNT(b)", "DELETE"], ["FROM t", "FROM t, u", "FROM t JOIN u ON t.a = u.a", "FROM (SELECT b FROM v) x"], ["", "WHERE a = 1", "WHERE a = 1 AND b = 2 OR c = 3"], ["", "UNION SELECT 1", "ORDER BY a"]

    def some(n):
        return [(rng.choice(["x", "y", None]), " ".join(rng.choice(p) for p in parts) + rng.choice(["", " LIMIT 3"])) for _ in range(n)]

    generated = some(150) + [("x", None), ("x", ""), ("x", "SELECT 'open"), ("nowhere", "SELECT a FROM t")]
    gold = some(60) + [("x", None), ("x", " "), ("x", "SELECT 'open"), ("y", "SELECT a FROM t")]
    left, right = trees_of(spark, generated, "sql"), [g for g in trees_of(spark, gold, "gold_sql") if g[2] and g[1].strip()]
    for least in (9, 7, 6):
        want = Counter()
        for db, sql, tree in left:
            near = [(-sum(a == b for a, b in zip(tree, t, strict=True)), g) for d, g, t in right if d == db] if tree else []
            best = min((x for x in near if -x[0] >= least), default=None)
            want[db, sql, *((best[1], round(-best[0] / 9, 9)) if best else (None, None))] += 1
        df = nearest_gold(spark.createDataFrame(generated, "db_id string, sql string"), spark.createDataFrame(gold, "db_id string, gold_sql string"), least_equal=least)
        assert df.columns == ["db_id", "sql", "nearest_sql", "nearest_similarity"]
        got = Counter((r[0] or "", r[1], r[2], None if r[3] is None else round(r[3], 9)) for r in df.collect())
        assert got == want
        assert "CartesianProduct" not in plan(df) and "NestedLoop" not in plan(df)
    with pytest.raises(ValueError):
        nearest_gold(df, df, least_equal=len(TREE_FEATURES) + 1)


# ---- rules as a table --------------------------------------------------------------------------


@pytest.mark.parametrize(
    "pattern,flags,literal",
    [
        (r"\bOR\s+1\s*=\s*1\b", "i", "or1=1"), (r"--", "", "--"), (r"\bDROP\s+(TABLE|VIEW)\b", "i", "drop"), (r"(ab)?cde+f", "", "cd"),
        (r"[xy]+", "", ""), (r"a|bcd", "", ""), (r"(?:foo\s*bar){2}z", "", "foobar"), (r"x{0,3}yes", "", "yes"), ("KK", "i", "k"),
    ],
)
def test_literals_of_a_pattern(pattern, flags, literal):
    assert required_literal(pattern, flags) == literal


def test_a_thousand_rules_by_the_index_are_the_rules_one_by_one(spark, sf):
    log = query_log(spark, sf).select("id", "sql")
    odd = [(-1, None), (-2, " \n"), (-3, "-"), (-4, "#  x"), (-5, "oR TRUE"), (-6, "ſLEEP ("), (-7, "or1=1 OR 1 = 1"), (-8, "long " * 50_000 + "; drop table x")]
    log = log.unionByName(spark.createDataFrame(odd, log.schema))
    more = [Rule(f"r{i}", rf"\bo_custkey\s*=\s*{i}\b|\bnone{i}\b" if i % 3 else rf"custkey\s=\s{i}\d", "x", "LOW", flags="i" if i % 2 else "") for i in range(1000)]
    rules = (*BUILTIN_RULES, *more)
    index = rule_index(spark, rules)
    got = {tuple(r) for r in indexed_hits(log, index, ["id"]).select("id", "rule_no", "name").collect()}
    texts = {r.id: r.sql for r in log.collect()}
    builtin = {r.id: set(r.matched_rules) for r in keyword_scan(log).select("id", "matched_rules").collect()}
    assert {(i, name) for i, no, name in got if no < len(BUILTIN_RULES)} == {(i, name) for i, names in builtin.items() for name in names}
    want = set()
    for no, r in enumerate(more, len(BUILTIN_RULES)):
        compiled = re.compile(r.pattern, re.I if "i" in r.flags else 0)
        want |= {(i, no, r.name) for i, t in texts.items() if t and t.strip() and compiled.search(t)}
    assert {x for x in got if x[1] >= len(BUILTIN_RULES)} == want and want

    def nodes(rules):
        return str(indexed_hits(log, rule_index(spark, rules), ["id"])._jdf.queryExecution().analyzed().treeString()).count("\n")

    assert nodes(rules) == nodes(rules[:30])


def test_queries_are_not_shuffled_to_their_nearest_tree(spark, sf, settings):
    settings(autoBroadcastJoinThreshold="-1")
    log = query_log(spark, sf)
    found = nearest_gold(log.where("toxic = 1"), log.where("toxic = 0").select("db_id", F.col("sql").alias("gold_sql")))
    assert "SortMergeJoin" not in plan(found)
    assert found.where("nearest_sql IS NOT NULL").count() > 0


# ---- evaluation --------------------------------------------------------------------------------


def test_a_text_is_not_shuffled_with_its_pieces(spark, settings):
    settings(autoBroadcastJoinThreshold="-1")
    index = rule_index(spark, (*BUILTIN_RULES, *(Rule(f"n{n}", rf"\bk\s*=\s*{n}\b", "w", "LOW", "") for n in range(300))))
    rows = [(1, "select 1 where k = 17 or k = 299"), (1, "k=17"), (None, "k = 4"), (2, "k"), (3, ""), (4, None), (5, "K=29900")]
    hits = indexed_hits(spark.createDataFrame(rows, "id INT, sql STRING"), index, ["id"])
    assert {(r.id, r.name) for r in hits.where("name LIKE 'n%'").collect()} == {(1, "n17"), (1, "n299"), (None, "n4")}
    assert hits.count() == hits.distinct().count()
    shown = plan(hits)
    assert "SortMergeJoin" not in shown
    assert all("_rt_text" not in line for line in shown.splitlines() if "Exchange hashpartitioning" in line)


def test_sweep_at_every_score(spark, settings):
    settings(shuffle__partitions="5")
    rng = random.Random(2)
    rows = [(rng.choice(["train", "val"]), rng.choice([0, 1, 1, None]), rng.choice([round(rng.random(), 3), 0.5, None])) for _ in range(4000)]
    rows += [("only", 1, 0.25), ("only", 1, 0.75)]
    curve = ev.exact_curve(spark.createDataFrame(rows, "split string, label int, score double"))
    assert "SinglePartition" not in plan(curve)
    got = {(r.split, r.threshold): (r.tp, r.fp, r.tn, r.fn) for r in curve.collect()}
    scored = {s: [(y, x) for g, y, x in rows if g == s and x is not None] for s in ("train", "val", "only")}
    for s, own in scored.items():
        for t in {x for _, x in own}:
            tp, fp = sum(y == 1 and x > t for y, x in own), sum(y == 0 and x > t for y, x in own)
            tn = sum(y == 0 and x <= t for y, x in own)
            assert got[s, t] == (tp, fp, tn, len(own) - tp - fp - tn)
    assert len(got) == sum(len({x for _, x in own}) for own in scored.values())
    for r in ev.exact_best(curve).collect():
        own = scored[r.split]
        pos, neg = [x for y, x in own if y == 1], [x for y, x in own if y == 0]
        area = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg)) if neg else None
        assert r.auc == (area if area is None else pytest.approx(area, abs=1e-12))
        f1 = {t: 2 * v[0] / (2 * v[0] + v[1] + v[3]) for (s, t), v in got.items() if s == r.split}
        assert r.f1 == pytest.approx(max(f1.values())) and r.threshold == min(t for t, f in f1.items() if f == pytest.approx(max(f1.values()), abs=1e-12))
    assert ev.exact_curve(spark.createDataFrame([], "split string, label int, score double")).isEmpty()


def test_a_question_is_in_one_part(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["big"] * 300 + [f"q{k}" for k in range(700)] + [None, ""])) for i in range(5000)]
    got = ev.grouped_split(spark.createDataFrame(rows, "id long, question string")).collect()
    assert sorted((r.id, r.question) for r in got if r.question) == sorted(r for r in rows if r[1])
    parts, sizes, groups = {}, Counter(), Counter()
    for r in got:
        parts.setdefault((r.question is None, r.question), set()).add(r.split)
        sizes[r.split] += 1
        groups[r.question] += 1
    assert all(len(p) == 1 for p in parts.values()) and sum(sizes.values()) == 5000
    largest = max(groups.values())
    assert abs(sizes["train"] - 3000) <= largest and abs(sizes["val"] - 1000) <= largest and abs(sizes["test"] - 1000) <= largest
    with pytest.raises(ValueError):
        ev.grouped_split(spark.createDataFrame(rows, "id long, question string"), train_ratio=0.9, val_ratio=0.1)


def test_intervals_do_not_depend_on_the_partitions(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b"]), int(rng.random() < 0.4), int(rng.random() < 0.5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, attack string, label int, pred_hard int")
    got = {(r.attack, r.metric): (r.estimate, r.low, r.high) for r in ev.bootstrap_intervals(df.repartition(3), by=["attack"]).collect()}
    again = {(r.attack, r.metric): (r.estimate, r.low, r.high) for r in ev.bootstrap_intervals(df.repartition(11, "pred_hard"), by=["attack"]).collect()}
    assert got == again and len(got) == 8
    for attack in "ab":
        own = [(y, p) for _, a, y, p in rows if a == attack]
        share = sum(y == p for y, p in own) / len(own)
        estimate, low, high = got[attack, "accuracy"]
        width = 1.96 * (share * (1 - share) / len(own)) ** 0.5
        assert estimate == pytest.approx(share) and low < estimate < high
        assert 0.7 * width < estimate - low < 1.4 * width and 0.7 * width < high - estimate < 1.4 * width
    weights = [w for (w,) in df.select(F.explode(ev.bootstrap_weights("id", 200, 7)).alias("w")).collect()]
    assert len(weights) == 600_000
    assert abs(sum(weights) / 600_000 - 1) < 0.01 and abs(sum(w == 0 for w in weights) / 600_000 - 0.3679) < 0.005
    assert "SinglePartition" not in plan(ev.bootstrap_intervals(df, by=["attack"]))


def test_intervals_sum_eight_weights_of_a_digest(spark):
    rows = [(i, i % 2, int(i % 3 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, label int, pred_hard int")
    found = ev.bootstrap_intervals(df, replicates=20)
    assert plan(found).count("partial_sum") < 20
    drawn = {r.id: r.w for r in df.select("id", ev.bootstrap_weights("id", 20, ev.SEED).alias("w")).collect()}
    shares = sorted(sum(drawn[i][k] for i, y, p in rows if y == p) / sum(w[k] for w in drawn.values()) for k in range(20))
    got = next(r for r in found.collect() if r.metric == "accuracy")
    assert got.estimate == sum(y == p for _, y, p in rows) / 200
    assert (got.low, got.high) == (pytest.approx(shares[0]), pytest.approx(shares[19]))


def test_more_text_takes_more_tasks_for_its_tokens(spark, monkeypatch):
    own = spark.createDataFrame([(i % 50, f"select a{i} from t") for i in range(100)] + [(None, "a b"), (None, "b")], "id int, sql string")
    model = token_model(own.where("id < 10"))

    def found():
        return {(r.id, r.divergence, r.unknown) for r in corpus_divergence(own, model, ["id"], spread=True).select("id", F.round("divergence", 9).alias("divergence"), "unknown").collect()}

    few = found()
    monkeypatch.setattr(divergence, "TASK_CHARS", 100)
    assert divergence._parts(own, "sql") > 8 and found() == few and len(few) == 51


def test_divergence_from_a_corpus(spark):
    clean = ["select a from t", "select b from t where a = 1", None, ""]
    own = [(1, "select a from t"), (2, "DROP table x"), (3, None), (4, " -- "), (5, "a a a zzz")]
    model = token_model(spark.createDataFrame([(t,) for t in clean], "sql string"))
    seen = Counter(w for t in clean for w in re.findall("[a-z0-9_]+", (t or "").lower()))
    assert {r.token: r["count"] for r in model.collect()} == seen
    size = sum(seen.values()) + len(seen) + 1
    for spread in (True, False):
        for r in corpus_divergence(spark.createDataFrame(own, "id int, sql string"), model, ["id"], spread=spread).collect():
            words = Counter(re.findall("[a-z0-9_]+", (dict(own)[r.id] or "").lower()))
            n = sum(words.values())
            if not n:
                assert r.divergence is None and r.unknown is None
                continue
            want = sum(k / n * math.log2(k / n / ((seen[w] + 1) / size)) for w, k in words.items())
            assert r.divergence == pytest.approx(want) and r.unknown == sum(k for w, k in words.items() if w not in seen) / n
    halves = [token_model(spark.createDataFrame([(t,) for t in part], "sql string")) for part in (clean[:1], clean[1:])]
    assert {r.token: r["count"] for r in merge_models(*halves).collect()} == seen


# ---- stream ------------------------------------------------------------------------------------


def test_a_stream_writes_its_actions_side_by_side(spark, settings, tmp_path):
    setting = "spark.sql.maxConcurrentOutputFileWriters"
    settings(maxConcurrentOutputFileWriters="0")
    spark.createDataFrame([(1, "select 1"), (2, "drop table x; -- y"), (3, None)], "id long, sql string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, sql string").parquet(str(tmp_path / "in"))
    start_guard(stream, str(tmp_path / "out"), str(tmp_path / "kept"), available_now=True).awaitTermination()
    assert int(spark.conf.get(setting)) > 3  # the sink looks at each batch
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_a_source_that_repeats_itself_and_restarts(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    def batch(ids):
        rows = spark.createDataFrame([(i,) for i in ids], "id long")
        at = (F.lit(1_700_000_000) + F.col("id")).cast("timestamp")
        return rows.select("id", at.alias("ts"), F.concat(F.lit("SELECT 1 -- "), F.col("id")).alias("sql"))

    for ids in ([1, 2, 3, 3], [2, 3, 4], [1, 2, 3, 4, 5], [4000, 5]):
        batch(ids).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long, ts timestamp, sql string").option("maxFilesPerTrigger", 1).parquet(source)
        query = start_guard(stream, out, checkpoint, available_now=True, once_by=["id"], event_time="ts", delay="10 minutes")
        query.awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).select("id").collect()) == [1, 2, 3, 4, 5, 4000]
    # The watermark has passed the first rows, so the state forgets them.
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1
