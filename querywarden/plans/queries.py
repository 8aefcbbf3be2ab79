"""Registered queries: every operator run over whole tables, with flat, comparable columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signals
from ..functions.catalogue import BUILTIN_RULES, PATTERN_LABELS, Rule, rule_table
from ..functions.patterns import with_suspicious_patterns
from ..functions.structure import SKELETON_FIELDS, TREE_FEATURES, with_structure
from ..functions.text import masked, well_formed, with_clean_sql
from ..operators import evaluation as ev
from ..operators.alignment import check_alignment, join_gold, with_alignment
from ..operators.divergence import corpus_divergence, token_model
from ..operators.keyword import keyword_explain, keyword_hits, keyword_scan
from ..operators.nearest import nearest_gold
from ..operators.policy import FAMILIES, check_boundaries, enforce_policy, policy_report
from ..operators.ruletable import indexed_hits, rule_index
from ..operators.sketches import distinct_counts, merge, quantile_values, sketch, store, stored
from ..operators.vectors import nearest_vector as find_nearest_vector
from ..operators.verdict import EVALUATION, batch_score, evaluation_rows, score, verdict_explain, with_detectors
from ..sources.corpus import normalise_corpus
from ..sources.sinks import csv_rows, slim_rows
from ..sources.storage import checkpointed, delete, shared_dir
from ..streaming.guard import start_guard
from .querylog import TEMPLATES, as_corpus, gold_queries, labelled_documents, messy_log, query_log, table, texts

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

EXTRA_RULES = (
    Rule("select_star", r"\bSELECT\s+\*", "exfiltration", "LOW", "SELECT *", weight=0.1),
    Rule("long_number", r"\d{5,}", "exfiltration", "ODD", "a long number"),
)
EXTRA_PATTERNS = {"hex_literal": r"0x[0-9a-f]+", "star_select": r"select\s+\*"}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def r6(value: str | Column) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, 6)


def num(flag: str | Column) -> Column:
    return (F.col(flag) if isinstance(flag, str) else flag).cast("int")


def joined(array: str, sep: str = ",") -> Column:
    return F.array_join(array, sep)


def _scan_columns() -> list[Column]:
    return [
        num("flagged").alias("flagged"),
        joined("matched_rules").alias("matched_rules"),
        joined("attack_types_found").alias("attack_types"),
        joined("severities_found").alias("severities"),
        r6("keyword_risk_score").alias("risk"),
        F.col("recommendation"),
    ]


# ---- keyword scan ------------------------------------------------------------------------------


@query
def keyword_scan_log(spark: SparkSession, sf: str) -> DataFrame:
    return keyword_scan(query_log(spark, sf)).select("id", *_scan_columns())


@query
def keyword_scan_lenient(spark: SparkSession, sf: str) -> DataFrame:
    return keyword_scan(query_log(spark, sf), strict=False).select("id", "recommendation")


@query
def keyword_scan_custom(spark: SparkSession, sf: str) -> DataFrame:
    return keyword_scan(query_log(spark, sf), extra_rules=EXTRA_RULES).select("id", *_scan_columns())


@query
def keyword_hits_long(spark: SparkSession, sf: str) -> DataFrame:
    return keyword_hits(keyword_scan(query_log(spark, sf)), "id").select(
        "id", "pos", "rule", "attack_type", "severity", "description", "snippet"
    )


@query
def keyword_risk(spark: SparkSession, sf: str) -> DataFrame:
    scanned = keyword_scan(query_log(spark, sf))
    return scanned.groupBy(r6("keyword_risk_score").alias("risk"), "recommendation").agg(F.count(F.lit(1)).alias("n"))


@query
def keyword_explain_log(spark: SparkSession, sf: str) -> DataFrame:
    return keyword_explain(keyword_scan(query_log(spark, sf))).select("id", "explanation")


@query
def rule_hit_counts(spark: SparkSession, sf: str) -> DataFrame:
    hits = keyword_scan(query_log(spark, sf)).select(F.explode("matched_rules").alias("name"))
    counted = hits.groupBy("name").agg(F.count(F.lit(1)).alias("hits"))
    return rule_table(spark).join(counted, "name", "left").select(
        "rule_no", "name", "attack_type", "severity", "description", "weight", F.coalesce("hits", F.lit(0)).alias("hits")
    )


#: A long list of rules: the built-in ones and one for each of a thousand customers under watch.
WATCHED = 1000
WATCH_RULES = tuple(Rule(f"customer_{n}", rf"\bo_custkey\s*=\s*{n}\b", "watch_list", "LOW", f"asks for customer {n}") for n in range(1, WATCHED + 1))


@query
def rule_index_hits(spark: SparkSession, sf: str) -> DataFrame:
    index = rule_index(spark, (*BUILTIN_RULES, *WATCH_RULES))
    return indexed_hits(query_log(spark, sf), index, ["id"]).select("id", "rule_no", "name", "severity")


@query
def doc_rule_index_hits(spark: SparkSession, sf: str) -> DataFrame:
    index = rule_index(spark, (*BUILTIN_RULES, *WATCH_RULES))
    return indexed_hits(texts(spark, sf, "documents"), index, ["doc_id"], "text").select("doc_id", "rule_no", "name")


def _scan_text(spark: SparkSession, sf: str, name: str, keys: list[str], text: str) -> DataFrame:
    return keyword_scan(texts(spark, sf, name), text).select(*keys, *_scan_columns())


@query
def doc_keyword_scan(spark: SparkSession, sf: str) -> DataFrame:
    return _scan_text(spark, sf, "documents", ["doc_id"], "text")


@query
def page_keyword_scan(spark: SparkSession, sf: str) -> DataFrame:
    return _scan_text(spark, sf, "pages", ["page_id"], "html")


@query
def conversation_keyword_scan(spark: SparkSession, sf: str) -> DataFrame:
    return _scan_text(spark, sf, "conversations", ["conv_id", "turn"], "text")


# ---- text and structure ------------------------------------------------------------------------


@query
def suspicious_patterns(spark: SparkSession, sf: str) -> DataFrame:
    found = with_suspicious_patterns(query_log(spark, sf))
    return found.select("id", *[num(f).alias(f) for f in PATTERN_LABELS], joined("patterns_found").alias("patterns_found"))


@query
def doc_suspicious_patterns(spark: SparkSession, sf: str) -> DataFrame:
    found = with_suspicious_patterns(texts(spark, sf, "documents"), "text")
    return found.select("doc_id", *[num(f).alias(f) for f in PATTERN_LABELS])


def _clean(df: DataFrame, key: str, sql_col: str = "sql") -> DataFrame:
    df = with_clean_sql(df, sql_col, "clean").withColumn("mask", F.expr(masked("clean")))
    return df.select(key, "clean", "mask", num(F.expr(well_formed("mask"))).alias("well_formed"))


@query
def clean_sql(spark: SparkSession, sf: str) -> DataFrame:
    return _clean(query_log(spark, sf), "id").drop("well_formed")


@query
def clean_sql_messy(spark: SparkSession, sf: str) -> DataFrame:
    return _clean(messy_log(spark, sf), "id")


@query
def doc_clean_sql(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = _clean(texts(spark, sf, "documents"), "doc_id", "text")
    return cleaned.select("doc_id", F.md5("clean").alias("clean_md5"), F.md5("mask").alias("mask_md5"), "well_formed")


@query
def page_clean_sql(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = _clean(texts(spark, sf, "pages"), "page_id", "html")
    return cleaned.select("page_id", F.md5("clean").alias("clean_md5"), F.md5("mask").alias("mask_md5"), "well_formed")


@query
def well_formed_counts(spark: SparkSession, sf: str) -> DataFrame:
    checked = _clean(query_log(spark, sf).drop("id").withColumnRenamed("tid", "id"), "id")
    return checked.groupBy(F.col("id").alias("tid"), "well_formed").agg(F.count(F.lit(1)).alias("n"))


def _skeleton_columns(name: str = "skeleton") -> list[Column]:
    out = []
    for field in SKELETON_FIELDS:
        value = F.col(f"{name}.{field}")
        if field in ("main_clauses", "clause_order"):
            value = F.array_join(value, ",")
        elif field.startswith("has_"):
            value = value.cast("int")
        out.append(value.alias(field))
    return out


@query
def skeleton(spark: SparkSession, sf: str) -> DataFrame:
    return with_structure(query_log(spark, sf)).select("id", num("well_formed").alias("well_formed"), *_skeleton_columns())


@query
def skeleton_messy(spark: SparkSession, sf: str) -> DataFrame:
    return with_structure(messy_log(spark, sf)).select("id", num("well_formed").alias("well_formed"), *_skeleton_columns())


@query
def tree_features(spark: SparkSession, sf: str) -> DataFrame:
    return with_structure(query_log(spark, sf)).select("id", *[F.col(f"tree.{f}").alias(f) for f in TREE_FEATURES])


def _with_gold(spark: SparkSession, sf: str, structure: bool = True) -> DataFrame:
    return join_gold(query_log(spark, sf), gold_queries(spark, sf), structure=structure)


@query
def gold_join(spark: SparkSession, sf: str) -> DataFrame:
    return _with_gold(spark, sf, structure=False).select("id", "expected_sql")


@query
def gold_join_hot(spark: SparkSession, sf: str) -> DataFrame:
    """A third of all rows ask one question, spread over every database; the gold side is not broadcast."""
    popular = "Which orders are open?"
    log = query_log(spark, sf).withColumn("question", F.when(F.col("id") % 3 == 0, F.lit(popular)).otherwise(F.col("question")))
    gold = gold_queries(spark, sf)
    open_orders = gold.select("db_id").distinct().select(
        "db_id", F.lit(popular).alias("question"), F.concat(F.lit("SELECT * FROM orders -- "), F.col("db_id")).alias("gold_sql")
    )
    return join_gold(log, gold.unionByName(open_orders), spread=True).select("id", "expected_sql")


@query
def nearest_clean(spark: SparkSession, sf: str) -> DataFrame:
    """For each toxic query the clean query of the same database that is nearest in structure."""
    log = query_log(spark, sf)
    clean = log.where("toxic = 0").select("db_id", F.col("sql").alias("gold_sql"))
    found = nearest_gold(log.where("toxic = 1"), clean)
    return found.select("id", "nearest_sql", r6("nearest_similarity").alias("nearest_similarity"))


@query
def tree_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return with_alignment(_with_gold(spark, sf), expected_col="expected_sql", structured=True).select(
        "id", r6("tree_similarity").alias("tree_similarity")
    )


@query
def alignment_check(spark: SparkSession, sf: str) -> DataFrame:
    found = check_alignment(_with_gold(spark, sf), expected_col="expected_sql", structured=True).select("id", "alignment.*")
    return found.select(
        "id",
        r6("alignment_score").alias("alignment_score"),
        r6("tree_similarity").alias("tree_similarity"),
        joined("anomaly_indicators").alias("anomaly_indicators"),
        F.col("skeleton_analysis.generated.query_type").alias("generated_type"),
        F.col("skeleton_analysis.expected.query_type").alias("expected_type"),
    )


@query
def skeleton_consistency(spark: SparkSession, sf: str) -> DataFrame:
    found = with_alignment(_with_gold(spark, sf), expected_col="expected_sql", structured=True).select("id", "consistency.*")
    matches = [c for c in found.columns if c.endswith("_match")]
    return found.select(
        "id",
        *[num(c).alias(c) for c in matches],
        joined("inconsistencies").alias("inconsistencies"),
        r6("consistency_score").alias("consistency_score"),
    )


# ---- policy ------------------------------------------------------------------------------------


def _policy(checked: DataFrame, *keys: str) -> DataFrame:
    return checked.select(
        *keys,
        num("violation_detected").alias("violation_detected"),
        *[F.array_join(f"policy_checks.{f}", "; ").alias(f) for f in FAMILIES],
        joined("violations", "; ").alias("violations"),
        r6("risk_score").alias("risk_score"),
    )


@query
def policy_strict(spark: SparkSession, sf: str) -> DataFrame:
    return _policy(check_boundaries(query_log(spark, sf)), "id")


@query
def policy_lenient(spark: SparkSession, sf: str) -> DataFrame:
    return _policy(check_boundaries(query_log(spark, sf), strict=False), "id")


@query
def policy_extra_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return _policy(check_boundaries(query_log(spark, sf), extra_patterns=EXTRA_PATTERNS), "id")


@query
def page_policy(spark: SparkSession, sf: str) -> DataFrame:
    return _policy(check_boundaries(texts(spark, sf, "pages"), "html"), "page_id")


@query
def policy_report_log(spark: SparkSession, sf: str) -> DataFrame:
    report = policy_report(check_boundaries(query_log(spark, sf)), "sql", "id")
    return report.select(
        "id",
        "sql_query",
        "violations_count",
        r6("risk_score").alias("risk_score"),
        "risk_level",
        joined("violations", "; ").alias("violations"),
        joined("recommendations", "; ").alias("recommendations"),
    )


def _enforced(level: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return enforce_policy(query_log(spark, sf), level=level).select(
            "id",
            num("allowed").alias("allowed"),
            "policy_level",
            joined("violations", "; ").alias("violations"),
            r6("risk_score").alias("risk_score"),
            "action",
        )

    return run


for _level in ("strict", "medium", "lenient"):
    REGISTRY[f"policy_enforce_{_level}"] = _enforced(_level)


@query
def policy_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    enforced = enforce_policy(query_log(spark, sf), level="strict")
    part = F.when(F.col("allowed"), F.lit("allowed")).otherwise(F.lit("quarantine")).alias("part")
    return enforced.groupBy(part, "attack").agg(F.count(F.lit(1)).alias("n"))


# ---- fused verdict -----------------------------------------------------------------------------


def _verdict(scored: DataFrame, *keys: str) -> DataFrame:
    return scored.select(
        *keys,
        "action",
        num("is_toxic").alias("is_toxic"),
        r6("overall_risk_score").alias("overall_risk_score"),
        num("keyword_flagged").alias("keyword_flagged"),
        r6("keyword_risk_score").alias("keyword_risk_score"),
        joined("keyword_matched_rules").alias("keyword_matched_rules"),
        joined("keyword_attack_types").alias("keyword_attack_types"),
        "keyword_recommendation",
        num("ast_parsed").alias("ast_parsed"),
        r6("ast_alignment_score").alias("ast_alignment_score"),
        joined("ast_suspicious_patterns").alias("ast_suspicious_patterns"),
        F.array_join("reasons", "; ").alias("reasons"),
    )


@query
def fused_default(spark: SparkSession, sf: str) -> DataFrame:
    return _verdict(score(query_log(spark, sf)), "id")


@query
def fused_eval(spark: SparkSession, sf: str) -> DataFrame:
    return _verdict(score(query_log(spark, sf), config=EVALUATION), "id")


@query
def fused_with_gold(spark: SparkSession, sf: str) -> DataFrame:
    return _verdict(score(_with_gold(spark, sf), expected_col="expected_sql", structured=True), "id")


@query
def fused_actions(spark: SparkSession, sf: str) -> DataFrame:
    scored = score(query_log(spark, sf))
    return scored.groupBy("action", "attack").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("overall_risk_score")).alias("mean_risk")
    )


@query
def fused_batch_keys(spark: SparkSession, sf: str) -> DataFrame:
    log = query_log(spark, sf).withColumnRenamed("sql", "generated").drop("question")
    return batch_score(log, sql_key="generated", nlq_key="asked").select("id", "asked", "action")


@query
def fused_null_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every query of the log, and for each one a row without text."""
    log = query_log(spark, sf)
    empty = log.withColumns({"id": -F.col("id"), "sql": F.lit(None).cast("string")})
    return _verdict(score(log.unionByName(empty)), "id").drop("reasons", "ast_alignment_score")


@query
def doc_fused(spark: SparkSession, sf: str) -> DataFrame:
    return _verdict(score(texts(spark, sf, "documents"), "text"), "doc_id").drop("ast_alignment_score")


@query
def verdict_explain_log(spark: SparkSession, sf: str) -> DataFrame:
    return verdict_explain(score(query_log(spark, sf))).select("id", "explanation")


@query
def custom_detectors(spark: SparkSession, sf: str) -> DataFrame:
    detectors = {
        "n_commas": lambda sql: F.length(sql) - F.length(F.replace(sql, F.lit(","), F.lit(""))),
        "is_long": lambda sql: (F.length(sql) > 80).cast("int"),
    }
    return with_detectors(query_log(spark, sf), detectors).select("id", "n_commas", "is_long")


# ---- evaluation --------------------------------------------------------------------------------


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    return normalise_corpus(as_corpus(query_log(spark, sf)))


def _evaluate(spark: SparkSession, sf: str, store: bool = False) -> ev.Evaluation:
    """Reports read one aggregate and score once anyway; results with a row for each query are stored. Their
    folder stays for the caller, who has yet to read them."""
    return ev.run_evaluation(_corpus(spark, sf), store=store)


def _rounded_metrics() -> list[Column]:
    return [r6(m).alias(m) for m in ev.METRICS] + [F.col(c) for c in ("tp", "fp", "tn", "fn")]


def _rounded_stats(stats: DataFrame, *by: str) -> DataFrame:
    return stats.select(*by, "n_total", "n_toxic", "n_clean", r6("pct_toxic").alias("pct_toxic"), r6("pct_clean").alias("pct_clean"))


@query
def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_stats(_evaluate(spark, sf).stats)


@query
def split(spark: SparkSession, sf: str) -> DataFrame:
    return ev.stratified_split(_corpus(spark, sf)).select("id", "toxic", "split")


@query
def split_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_stats(_evaluate(spark, sf).split_stats, "split")


@query
def doc_split(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("label", num(F.col("n_chars") % 10 == 0))
    return ev.stratified_split(docs, "doc_id", "label", 0.7, 0.1, seed=7).select("doc_id", "label", "split")


@query
def confusion_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = _evaluate(spark, sf).metrics
    return m.select("split", "kind", *_rounded_metrics())


@query
def sweep_curve(spark: SparkSession, sf: str) -> DataFrame:
    curve = _evaluate(spark, sf).curve.filter("split = 'val'")
    return curve.select(r6("threshold").alias("threshold"), *_rounded_metrics())


def _best(df: DataFrame) -> DataFrame:
    return df.select("split", r6("threshold").alias("threshold"), *_rounded_metrics())


@query
def sweep_best(spark: SparkSession, sf: str) -> DataFrame:
    return _best(_evaluate(spark, sf).best)


@query
def oracle_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return _best(_evaluate(spark, sf).oracle)


def _exact(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct scores are told apart at six places, as everywhere in these results."""
    rows = _evaluate(spark, sf).rows.select("split", "label", r6("score").alias("score"))
    return ev.exact_curve(rows)


@query
def exact_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return _exact(spark, sf).select("split", r6("threshold").alias("threshold"), *_rounded_metrics())


@query
def exact_best(spark: SparkSession, sf: str) -> DataFrame:
    best = ev.exact_best(_exact(spark, sf))
    return best.select("split", r6("threshold").alias("threshold"), *_rounded_metrics(), r6("auc").alias("auc"))


@query
def doc_exact_best(spark: SparkSession, sf: str) -> DataFrame:
    """Risk scores of documents against the toxic label, per language."""
    rows = evaluation_rows(score(labelled_documents(spark, sf), "query", config=EVALUATION))
    curve = ev.exact_curve(rows.withColumn("score", r6("score")), ["db_id"])
    return ev.exact_best(curve, ["db_id"]).select("db_id", r6("threshold").alias("threshold"), *_rounded_metrics(), r6("auc").alias("auc"))


@query
def grouped_split(spark: SparkSession, sf: str) -> DataFrame:
    return ev.grouped_split(_corpus(spark, sf)).select("id", "question", "split")


@query
def apply_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return _evaluate(spark, sf, store=True).rows.select("id", "split", r6("score").alias("score"), "pred_sweep", "pred_hard")


@query
def eval_slim_rows(spark: SparkSession, sf: str) -> DataFrame:
    return slim_rows(_evaluate(spark, sf, store=True).rows, "id").withColumn("score", r6("score"))


@query
def eval_csv_rows(spark: SparkSession, sf: str) -> DataFrame:
    return csv_rows(_evaluate(spark, sf, store=True).rows, "id")


@query
def overfit_gap(spark: SparkSession, sf: str) -> DataFrame:
    gap = _evaluate(spark, sf).gap
    return gap.select(
        "metric", r6("val").alias("val"), r6("test").alias("test"), r6("gap").alias("gap"), num("possible_overfit").alias("possible_overfit")
    )


@query
def evaluation_report(spark: SparkSession, sf: str) -> DataFrame:
    report = _evaluate(spark, sf).report
    return report.select(
        F.col("config.random_seed").alias("random_seed"),
        r6("config.best_threshold_from_val").alias("best_threshold"),
        r6("config.test_ratio").alias("test_ratio"),
        F.col("train.n").alias("n_train"),
        r6("train.sweep.f1").alias("train_f1"),
        F.col("validate.n").alias("n_val"),
        r6("validate.sweep.f1").alias("val_f1"),
        r6("validate.hard.f1").alias("val_hard_f1"),
        F.col("test.n").alias("n_test"),
        r6("test.sweep_with_val_threshold.f1").alias("test_f1"),
        r6("test.hard.accuracy").alias("test_hard_accuracy"),
        r6("test.sweep_oracle.threshold").alias("oracle_threshold"),
    )


def _eval_rows(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation_rows(score(_corpus(spark, sf), "query", config=EVALUATION))


@query
def detection_by_attack(spark: SparkSession, sf: str) -> DataFrame:
    found = ev.detection_by_attack(_eval_rows(spark, sf))
    return found.withColumn("detection_rate", r6("detection_rate"))


@query
def ablation(spark: SparkSession, sf: str) -> DataFrame:
    return ev.ablation(_eval_rows(spark, sf)).select("variant", *_rounded_metrics())


@query
def security_metrics(spark: SparkSession, sf: str) -> DataFrame:
    found = ev.security_metrics(ev.compute_metrics(_eval_rows(spark, sf), "label", "pred_hard"))
    return found.select(*[r6(c).alias(c) for c in ("asr", "tpr", "fnr", "fpr")])


@query
def bootstrap_by_db(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals of the metrics of the hard decision in every database."""
    found = ev.bootstrap_intervals(_eval_rows(spark, sf), by=["db_id"])
    return found.select("db_id", "metric", *[r6(c).alias(c) for c in ("estimate", "low", "high")])


@query
def hard_metrics_by_db(spark: SparkSession, sf: str) -> DataFrame:
    return ev.compute_metrics(_eval_rows(spark, sf), "label", "pred_hard", ["db_id"]).select("db_id", *_rounded_metrics())


@query
def doc_sweep_curve(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluation_rows(score(labelled_documents(spark, sf), "query", config=EVALUATION))
    curve = ev.sweep_curve(ev.outcome_cube(rows, by=()), by=())
    return curve.select(r6("threshold").alias("threshold"), *_rounded_metrics())


# ---- stream ------------------------------------------------------------------------------------


def _event_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream of queries from a file source: event_id, ts, sql."""
    batch = table(spark, sf, "events")
    events = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    cores = spark.sparkContext.defaultParallelism
    if batch.rdd.getNumPartitions() < cores:
        events = events.repartition(cores)
    rows = [(i, t) for i, (t, _, _) in enumerate(TEMPLATES)]
    templates = F.broadcast(spark.createDataFrame(rows, "tid INT, template STRING"))
    return events.join(templates, F.col("event_id") % len(TEMPLATES) == F.col("tid")).select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.replace(
            F.replace("template", F.lit("{c}"), F.col("user_id").cast("string")), F.lit("{k}"), F.col("event_id").cast("string")
        ).alias("sql"),
    )


def _guarded(spark: SparkSession, queries: DataFrame, **options) -> DataFrame:
    """What the guard wrote of a stream, read back; the files of the run are deleted."""
    out = shared_dir(spark, "stream_guard")
    start_guard(queries, f"{out}/rows", f"{out}/checkpoint", available_now=True, **options).awaitTermination()
    scored = spark.read.parquet(f"{out}/rows")
    kept = checkpointed(scored.select("event_id", r6("overall_risk_score").alias("overall_risk_score"), "action"))
    delete(spark, out)
    return kept


@query
def stream_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Score an event stream of queries through a file source and read back what the guard wrote."""
    return _guarded(spark, _event_queries(spark, sf).drop("ts"))


@query
def stream_replay(spark: SparkSession, sf: str) -> DataFrame:
    """The same from a source that sends every event twice; each is scored once."""
    twice = _event_queries(spark, sf).unionByName(_event_queries(spark, sf))
    return _guarded(spark, twice, once_by=["event_id"], event_time="ts", delay="2 hours")


# ---- statistics that merge ---------------------------------------------------------------------


def _log_sketch(spark: SparkSession, sf: str) -> DataFrame:
    """Queries, questions and the length of a query, by month."""
    log = query_log(spark, sf, ["o_orderdate"]).withColumns({"month": F.date_format("o_orderdate", "yyyy-MM"), "length": F.length("sql")})
    return sketch(log, ["month"], distinct=["sql", "question"], quantiles=["length"])


@query
def corpus_sketch(spark: SparkSession, sf: str) -> DataFrame:
    return _log_sketch(spark, sf)


@query
def corpus_sketch_merged(spark: SparkSession, sf: str) -> DataFrame:
    """The months stored, some of them a second time, read back and merged by year."""
    path = shared_dir(spark, "sketch")
    months = checkpointed(_log_sketch(spark, sf))
    store(months, path, ["month"])
    store(months.where("month < '1997'"), path, ["month"])
    years = merge(stored(spark, path).withColumn("year", F.substring(F.col("month").cast("string"), 1, 4)), ["year"])
    counts = distinct_counts(years, ["year"]).select("year", F.concat("column", F.lit("_distinct")).alias("what"), F.round("distinct", 3).alias("value"))
    lengths = quantile_values(years, [0.0, 0.5, 0.9, 0.99, 1.0], ["year"])
    shown = F.concat("column", F.lit("_"), F.col("share").cast("string"))
    kept = checkpointed(counts.unionByName(lengths.select("year", shown.alias("what"), F.col("value").cast("double").alias("value"))))
    delete(spark, path)
    return kept


@query
def doc_sketch(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct texts and the middle and long lengths of every source."""
    docs = texts(spark, sf, "documents").select("source", "text", F.length("text").alias("length"))
    held = checkpointed(sketch(docs, ["source"], distinct=["text"], quantiles=["length"]))
    lengths = quantile_values(held, [0.5, 0.9], ["source"]).groupBy("source").pivot("share", [0.5, 0.9]).agg(F.first("value"))
    lengths = lengths.select("source", F.col("`0.5`").alias("middle"), F.col("`0.9`").alias("long"))
    counts = distinct_counts(held, ["source"]).select("source", F.round("distinct", 3).alias("texts"))
    return counts.join(lengths, counts["source"].eqNullSafe(lengths["source"])).select(counts["source"], "texts", "middle", "long")


# ---- further signals ---------------------------------------------------------------------------


@query
def entropy(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf, "documents")
    return docs.select(
        "doc_id",
        r6(signals.char_entropy(F.col("text"))).alias("char_entropy"),
        r6(signals.token_entropy(F.col("text"))).alias("token_entropy"),
    )


@query
def query_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return query_log(spark, sf).select(
        "id",
        r6(signals.char_entropy(F.col("sql"))).alias("char_entropy"),
        r6(signals.token_entropy(F.col("sql"))).alias("token_entropy"),
    )


@query
def nlq_divergence(spark: SparkSession, sf: str) -> DataFrame:
    sql, nlq = F.col("sql"), F.col("question")
    return query_log(spark, sf).select(
        "id", r6(signals.length_ratio(sql, nlq)).alias("length_ratio"), r6(signals.keyword_overlap(sql, nlq)).alias("overlap")
    )


@query
def clean_divergence(spark: SparkSession, sf: str) -> DataFrame:
    """Divergence of every query from the tokens of the clean ones, with the join by token spread."""
    log = query_log(spark, sf)
    found = corpus_divergence(log, token_model(log.where("toxic = 0")), ["id"], spread=True)
    return found.select("id", r6("divergence").alias("divergence"), r6("unknown").alias("unknown"))


@query
def char_triggers(spark: SparkSession, sf: str) -> DataFrame:
    flags = signals.char_triggers(F.col("html"))
    return texts(spark, sf, "pages").select("page_id", *[num(c).alias(n) for n, c in flags.items()])


@query
def doc_char_triggers(spark: SparkSession, sf: str) -> DataFrame:
    flags = signals.char_triggers(F.col("text"))
    return texts(spark, sf, "documents").select("doc_id", *[num(c).alias(n) for n, c in flags.items()])


@query
def cosine_alignment(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"), F.col("label").alias("next_label"))
    similarity = signals.cosine(F.col("embedding"), F.col("other"))
    return e.join(nxt, "vec_id").select(
        "vec_id",
        num(F.col("label") == F.col("next_label")).alias("same_label"),
        F.round(similarity, 5).alias("cosine"),
        num(similarity >= signals.STANDARD.semantic_align).alias("aligned"),
    )


def _nearest_vectors(spark: SparkSession, sf: str, **how) -> DataFrame:
    e = table(spark, sf, "embeddings")
    asked = e.where("vec_id % 20 = 0").select("vec_id", "embedding")
    found = find_nearest_vector(asked, e.select("vec_id", "embedding"), size=64, same_table=True, **how)
    return found.select("vec_id", "nearest_id", r6("nearest_cosine").alias("nearest_cosine"))


@query
def nearest_vector(spark: SparkSession, sf: str) -> DataFrame:
    """For each vector whose id is divisible by 20 the nearest of all others, exactly."""
    return _nearest_vectors(spark, sf, exact=True)


@query
def nearest_vector_bands(spark: SparkSession, sf: str) -> DataFrame:
    """The same by hyperplane bands. Neighbours in this table are far apart, some at a cosine of 0.32; the chance to
    find one is set at 0.99, since the share found of a few queries scatters around it."""
    return _nearest_vectors(spark, sf, similarity=0.3, recall=0.99)


@query
def overall_score(spark: SparkSession, sf: str) -> DataFrame:
    """The weighted score from alignment, word overlap, policy risk and the share of character triggers."""
    df = with_alignment(query_log(spark, sf))
    df = check_boundaries(df)
    sql = F.col("sql")
    triggers = sum(num(c) for c in signals.char_triggers(sql).values()) / F.lit(3.0)
    df = df.withColumns({"semantic": signals.keyword_overlap(sql, F.col("question")), "stealth": triggers})
    parts = [F.col(c) for c in ("alignment_score", "semantic", "risk_score", "stealth")]
    df = df.withColumn("overall", signals.overall_score(*parts))

    def rule(config: signals.OverallConfig) -> Column:
        return num(
            signals.is_anomaly(
                F.col("overall"), F.col("alignment_score"), F.col("semantic"), F.col("violation_detected"), F.col("stealth"), config
            )
        )

    return df.select(
        "id",
        r6("overall").alias("overall"),
        rule(signals.STANDARD).alias("anomaly"),
        rule(signals.LENIENT).alias("anomaly_lenient"),
        rule(signals.STRICT).alias("anomaly_strict"),
    )

