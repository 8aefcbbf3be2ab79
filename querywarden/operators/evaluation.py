"""Evaluation of verdicts on a labelled corpus.

Everything after scoring is read from one small aggregate, the outcome cube: rows counted by
(split, label, threshold bucket, hard prediction).  Its size does not depend on the data, so the
sweep, all metrics and the gap analysis cost one pass over the scored rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from ..sources.storage import delete, materialize
from .skew import running_sums, spread_join
from .verdict import EVALUATION, VerdictConfig, evaluation_rows, score

# Fixed values of the evaluation protocol.
SEED = 42
TRAIN_RATIO = 0.60
VAL_RATIO = 0.20
STEPS = 100
GAP_LIMIT = 0.05

METRICS = ("precision", "recall", "f1", "accuracy")


# ---- corpus statistics and split ---------------------------------------------------------------


def corpus_stats(df: DataFrame, label_col: str = "toxic", by: Sequence[str] = ()) -> DataFrame:
    """Rows, toxic rows and the rest, with percentages; per group if ``by`` is given."""
    toxic = F.count_if(F.col(label_col) == 1)
    n = F.count(F.lit(1))
    return df.groupBy(*by).agg(
        n.alias("n_total"),
        toxic.alias("n_toxic"),
        (n - toxic).alias("n_clean"),
        (ratio(toxic, n) * 100).alias("pct_toxic"),
        (ratio(n - toxic, n) * 100).alias("pct_clean"),
    )


def stratified_split(
    df: DataFrame,
    id_col: str = "id",
    label_col: str = "toxic",
    train_ratio: float = TRAIN_RATIO,
    val_ratio: float = VAL_RATIO,
    seed: int = SEED,
    hex_digits: int = 4,
) -> DataFrame:
    """Add ``split``: exact train/val/test sizes within each class, order drawn from a seeded hash.

    Ids must be unique.  Labels other than 0 and 1 belong to no split and are dropped.

    No global sort: rows are counted per hash prefix (16**hex_digits of them per class), the
    running sum of those counts shows which prefixes hold the two cut points, only the rows of
    these prefixes are ranked, and the whole corpus is then compared with the cut keys (at most
    one row per class) in a map-only pass.
    """
    if not train_ratio + val_ratio < 1.0:
        raise ValueError("train_ratio + val_ratio must be below 1")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"))
    in_class = df.filter(F.col(label_col).isin(0, 1))
    hashed = in_class.select(F.col(label_col).alias("_label"), key.alias("_key"), F.col(id_col).alias("_id"))
    hashed = hashed.withColumn("_prefix", F.substring("_key", 1, hex_digits))

    counts = hashed.groupBy("_label", "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("_label").orderBy("_prefix")
    whole = Window.partitionBy("_label")
    counts = counts.withColumns({"_before": F.sum("_n").over(order) - F.col("_n"), "_size": F.sum("_n").over(whole)})
    n_train = F.floor(F.col("_size") * F.lit(float(train_ratio)))
    n_val = F.floor(F.col("_size") * F.lit(float(val_ratio)))
    # _cut is the 0-based rank of the first row that no longer belongs to the part before it.
    cuts = counts.withColumn("_cut", F.explode(F.array(n_train, n_train + n_val)))
    cuts = cuts.filter((F.col("_before") <= F.col("_cut")) & (F.col("_cut") < F.col("_before") + F.col("_n")))
    cuts = cuts.select("_label", "_prefix", "_before", "_cut").distinct()

    # Two cut points for each of two classes: at most four rows.
    near = hashed.join(F.broadcast(cuts), ["_label", "_prefix"])
    rank = F.row_number().over(Window.partitionBy("_label", "_cut").orderBy("_key", "_id")) - 1
    bounds = (
        near.withColumn("_rank", F.col("_before") + rank)
        .filter(F.col("_rank") == F.col("_cut"))
        .groupBy("_label")
        .agg(
            F.min(F.struct("_cut", "_key", "_id")).alias("_val_from"),
            F.max(F.struct("_cut", "_key", "_id")).alias("_test_from"),
        )
    )
    place = F.struct(key.alias("_key"), F.col(id_col).alias("_id"))

    def reached(bound: str) -> Column:
        return place >= F.struct(F.col(f"{bound}._key").alias("_key"), F.col(f"{bound}._id").alias("_id"))

    split = F.when(reached("_test_from"), F.lit("test")).when(reached("_val_from"), F.lit("val")).otherwise(F.lit("train"))
    joined = in_class.join(F.broadcast(bounds), F.col(label_col) == F.col("_label"), "left")
    return joined.withColumn("split", split).drop("_label", "_val_from", "_test_from")


def grouped_split(
    df: DataFrame,
    group_col: str = "question",
    train_ratio: float = TRAIN_RATIO,
    val_ratio: float = VAL_RATIO,
    seed: int = SEED,
) -> DataFrame:
    """Add ``split`` so that all rows of a group are in one part: no question is both trained and tested on.

    Groups stand in the order of a seeded hash; a group belongs to the part in which its first row falls, so
    a part's size misses its share by less than the largest group.  NULL is a group of its own.  The running
    sums over the groups are taken in two passes, and a group may hold any number of rows.
    """
    if not train_ratio + val_ratio < 1.0:
        raise ValueError("train_ratio + val_ratio must be below 1")
    group, key = "_group", "_key"
    # The length tells NULL from the empty text, and joins need keys that are not NULL.
    own = df.withColumn(group, F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")))
    sized = own.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    sized = sized.withColumn(key, F.md5(F.concat(F.lit(f"{seed}:"), F.col(group)).cast("binary")))
    placed = running_sums(sized, [key, group], ["n"])
    first = F.col("sum_n") - F.col("n")
    n_train = F.floor(F.col("all_n") * F.lit(float(train_ratio)))
    n_val = F.floor(F.col("all_n") * F.lit(float(val_ratio)))
    split = F.when(first < n_train, F.lit("train")).when(first < n_train + n_val, F.lit("val")).otherwise(F.lit("test"))
    return spread_join(own, placed.select(group, split.alias("split")), [group]).drop(group)


# ---- confusion counts and metrics --------------------------------------------------------------


def confusion(label: Column, pred: Column, n: Column) -> dict[str, Column]:
    """The four counts as aggregates of ``n``; a label other than 0/1 counts as a miss."""

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0))

    tp, fp, tn = (label == 1) & pred, (label == 0) & pred, (label == 0) & ~pred
    return {"tp": total(tp), "fp": total(fp), "tn": total(tn), "fn": total(~F.coalesce(tp | fp | tn, F.lit(False)))}


def with_metrics(df: DataFrame) -> DataFrame:
    """Add precision, recall, f1 and accuracy to a frame with tp, fp, tn and fn."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    p, r = F.col("precision"), F.col("recall")
    df = df.withColumns(
        {
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "accuracy": ratio(tp + tn, tp + tn + fp + fn),
        }
    )
    return df.withColumn("f1", F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0)))


def compute_metrics(df: DataFrame, label_col: str, pred_col: str, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and metrics of a 0/1 prediction column."""
    counts = confusion(F.col(label_col), F.col(pred_col) == 1, F.lit(1))
    return with_metrics(df.groupBy(*by).agg(*[c.alias(n) for n, c in counts.items()]))


# ---- confidence intervals ----------------------------------------------------------------------


REPLICATES = 200
#: Percent.
CONFIDENCE = 95


def _poisson_borders() -> list[str]:
    """Four-digit hexadecimal numbers: a uniform one reaches k of them with the probability that a Poisson
    variable of mean 1 reaches k."""
    borders, below, share = [], 0.0, math.exp(-1)
    for k in range(1, 9):
        below += share
        share /= k
        if (border := math.floor(below * 65536)) < 65536:
            borders.append(f"{border:04x}")
    return borders


def bootstrap_weights(id_col: str, replicates: int, seed: int) -> Column:
    """How often each replicate draws a row: an array of Poisson weights read off digests of the row's id, so
    they are the same in every run and however the rows are partitioned."""
    drawn = " + ".join(f"CAST(substring(d, 4 * j + 1, 4) >= '{b}' AS INT)" for b in _poisson_borders())
    digests = f"transform(sequence(0, {(replicates - 1) // 8}), k -> md5(encode(concat('{seed}:', CAST(`{id_col}` AS STRING), ':', CAST(k AS STRING)), 'UTF-8')))"
    return F.expr(f"slice(flatten(transform({digests}, d -> transform(sequence(0, 7), j -> {drawn}))), 1, {replicates})")


def bootstrap_intervals(
    rows: DataFrame,
    id_col: str = "id",
    label_col: str = "label",
    pred_col: str = "pred_hard",
    by: Sequence[str] = (),
    replicates: int = REPLICATES,
    seed: int = SEED,
) -> DataFrame:
    """For each group of ``by`` and metric the estimate and the bounds of its bootstrap interval (the order
    statistics of the replicates).

    One pass: a row is taken once for each digest, whose eight weights are summed per (by, label, prediction,
    digest), so what is shuffled does not grow with the rows.  The weights are those of ``bootstrap_weights``.
    Ids must be unique and not NULL.
    """
    digest, block = "_digest", "_block"
    taken = rows.select(*by, F.col(label_col).alias("_label"), (F.col(pred_col) == 1).alias("_pred"), F.col(id_col).cast("string").alias("_id"))
    taken = taken.withColumn(block, F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // 8))))
    drawn = taken.withColumn(digest, F.expr(f"md5(encode(concat('{seed}:', _id, ':', CAST({block} AS STRING)), 'UTF-8'))"))
    borders = _poisson_borders()

    def weight(j: int) -> str:
        part = f"substring({digest}, {4 * j + 1}, 4)"
        steps = " ".join(f"WHEN {part} < '{b}' THEN {k}" for k, b in enumerate(borders))
        return f"CASE WHEN {digest} IS NULL THEN NULL {steps} ELSE {len(borders)} END"

    sums = [F.sum(F.expr(weight(j))).alias(f"_w{j}") for j in range(8)]
    cells = drawn.groupBy(*by, "_label", "_pred", block).agg(F.count(F.lit(1)).alias("_all"), *sums)
    # Replicate 0 is the sample itself.
    weights = [F.struct((8 * F.col(block) + j + 1).alias("r"), F.col(f"_w{j}").alias("n")) for j in range(8)]
    whole = F.struct(F.when(F.col(block) == 0, 0).otherwise(replicates + 1).alias("r"), F.col("_all").alias("n"))
    counted = cells.select(*by, "_label", "_pred", F.explode(F.array(whole, *weights)).alias("_cell"))
    counted = counted.select(*by, "_label", "_pred", F.col("_cell.r").alias("_replicate"), F.col("_cell.n").alias("_n")).where(F.col("_replicate") <= replicates)
    counts = confusion(F.col("_label"), F.col("_pred"), F.col("_n"))
    each = with_metrics(counted.groupBy(*by, "_replicate").agg(*[c.alias(n) for n, c in counts.items()]))
    low = max(1, (100 - CONFIDENCE) * replicates // 200)
    high = replicates + 1 - low
    metric = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS]))
    long = each.select(*by, "_replicate", metric.alias("m")).select(*by, "_replicate", "m.metric", "m.value")
    ordered = F.sort_array(F.collect_list(F.when(F.col("_replicate") > 0, F.col("value"))))
    estimate = F.max(F.when(F.col("_replicate") == 0, F.col("value")))
    found = long.groupBy(*by, "metric").agg(estimate.alias("estimate"), ordered.alias("_values"))
    return found.select(*by, "metric", "estimate", F.col("_values")[low - 1].alias("low"), F.col("_values")[high - 1].alias("high"))


# ---- threshold sweep ---------------------------------------------------------------------------


def thresholds_below(score_col: Column) -> Column:
    """How many of the thresholds 0.00, 0.01 … 1.00 are strictly below the score.

    The product may round to a neighbouring step, so the steps around it are compared exactly.
    """
    base = F.floor(score_col * F.lit(float(STEPS))) - 1
    near = sum(
        (((base + d).cast("double") / F.lit(float(STEPS))) < score_col).cast("long") for d in range(1, 3)
    ) + ((base.cast("double") / F.lit(float(STEPS))) < score_col).cast("long")
    return F.greatest(F.lit(0), F.least(F.lit(STEPS + 1), base + near)).cast("int")


def outcome_cube(rows: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """Rows counted by (by…, label, threshold bucket, hard prediction): combined map-side, tiny."""
    return rows.groupBy(*by, "label", thresholds_below(F.col("score")).alias("bucket"), "pred_hard").agg(
        F.count(F.lit(1)).alias("n")
    )


def sweep_curve(cube: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """Counts and metrics at each of the 101 thresholds; a row is positive where score > threshold."""
    stepped = cube.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(STEPS))))
    counts = confusion(F.col("label"), F.col("bucket") > F.col("step"), F.col("n"))
    curve = stepped.groupBy(*by, "step").agg(*[c.alias(n) for n, c in counts.items()])
    return with_metrics(curve).withColumn("threshold", F.col("step") / F.lit(float(STEPS)))


POINT = ("step", "threshold", "f1", "precision", "recall", "accuracy", "tp", "fp", "tn", "fn")


def best_threshold(curve: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """The point with the highest f1 per group; the smallest threshold wins ties."""
    point = F.min_by(F.struct(*POINT), F.struct((-F.col("f1")).alias("f"), F.col("step").alias("s")))
    return curve.groupBy(*by).agg(point.alias("best")).select(*by, "best.*")


def exact_curve(rows: DataFrame, by: Sequence[str] = ("split",), score_col: str = "score", label_col: str = "label") -> DataFrame:
    """Counts and metrics at every distinct score as threshold; a row is positive where score > threshold.

    Rows are combined per score first; the running sums over the scores are taken in two passes over range
    partitions, so no task sees more than its range.  Scores are distinct per group of ``by``.  Rows without a
    score belong to no threshold.  Labels other than 0 and 1 count as misses, as elsewhere.
    """
    label, score = F.col(label_col), F.col(score_col)
    kinds = {"pos": label == 1, "neg": label == 0, "odd": ~F.coalesce(label.isin(0, 1), F.lit(False))}
    sums = [F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(n) for n, c in kinds.items()]
    per = rows.where(score.isNotNull()).groupBy(*by, score.alias("threshold")).agg(*sums)
    curve = running_sums(per, ["threshold"], list(kinds), by)
    counts = {
        "tp": F.col("all_pos") - F.col("sum_pos"),
        "fp": F.col("all_neg") - F.col("sum_neg"),
        "tn": F.col("sum_neg"),
        "fn": F.col("sum_pos") + F.col("all_odd"),
    }
    return with_metrics(curve.withColumns(counts))


def exact_best(curve: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """Per group the threshold with the highest f1 (the smallest of equals), its metrics, and the area under
    the ROC curve (NULL where a class is missing); equal scores count half."""
    point = F.struct("threshold", "f1", "precision", "recall", "accuracy", "tp", "fp", "tn", "fn")
    best = F.min_by(point, F.struct((-F.col("f1")).alias("f"), "threshold")).alias("best")
    # Of a score's negatives, every positive above is a right order and every positive at it half of one.
    twice = F.sum((F.col("neg") * (2 * F.col("tp") + F.col("pos"))).cast("decimal(38,0)")).cast("double")
    pairs = F.max("all_pos").cast("double") * F.max("all_neg").cast("double")
    found = curve.groupBy(*by).agg(best, F.when(pairs > 0, twice / (2 * pairs)).alias("auc"))
    return found.select(*by, "best.*", "auc")


def best_of_split(curve: DataFrame, split: str) -> DataFrame:
    """The best point of one split as a one-row frame.

    Picked by a conditional aggregate: a filter would be pushed down to the scoring, and the plan
    would no longer share the cube with the other reports.
    """
    picked = best_threshold(curve).agg(F.max(F.when(F.col("split") == split, F.struct(*POINT))).alias("best"))
    return picked.select(F.lit(split).alias("split"), "best.*")


def apply_threshold(rows: DataFrame, best: DataFrame) -> DataFrame:
    """Add ``pred_sweep`` from a one-row frame with the chosen ``threshold``."""
    chosen = F.coalesce(best.select("threshold").scalar(), F.lit(0.0))
    return rows.withColumn("pred_sweep", (F.col("score") > chosen).cast("int"))


def split_metrics(cube: DataFrame, best: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """Metrics per split for the swept threshold (``sweep``) and the action (``hard``), from the cube alone."""
    step = F.coalesce(best.select("step").scalar(), F.lit(0))
    cube = cube.withColumn("pred_sweep", F.col("bucket") > step)
    kinds = F.array(
        F.struct(F.lit("sweep").alias("kind"), F.col("pred_sweep").alias("pred")),
        F.struct(F.lit("hard").alias("kind"), (F.col("pred_hard") == 1).alias("pred")),
    )
    both = cube.select("*", F.inline(kinds))
    counts = confusion(F.col("label"), F.col("pred"), F.col("n"))
    return with_metrics(both.groupBy(*by, "kind").agg(*[c.alias(n) for n, c in counts.items()]))


def overfit_gap(metrics: DataFrame) -> DataFrame:
    """val − test per metric at the swept threshold, flagged beyond 0.05 either way."""
    # No filter: it would be pushed below the cube, which the threshold could then not share.
    def of(split: str, metric: str) -> Column:
        return F.max(F.when((F.col("kind") == "sweep") & (F.col("split") == split), F.col(metric)))

    wide = metrics.agg(
        F.array(
            *[
                F.struct(F.lit(m).alias("metric"), of("val", m).alias("val"), of("test", m).alias("test"))
                for m in ("f1", "precision", "recall", "accuracy")
            ]
        ).alias("m")
    )
    rows = wide.select(F.inline("m"))
    gap = F.col("val") - F.col("test")
    return rows.withColumns({"gap": gap, "possible_overfit": F.abs(gap) > F.lit(GAP_LIMIT)})


# ---- further reports ---------------------------------------------------------------------------


def detection_by_attack(rows: DataFrame, attack_col: str = "attack", pred_col: str = "pred_hard") -> DataFrame:
    """Rows, detected rows and detection rate per attack type."""
    detected = F.count_if(F.col(pred_col) == 1)
    n = F.count(F.lit(1))
    return rows.groupBy(F.col(attack_col).alias("attack_type")).agg(
        n.alias("n"), detected.alias("detected"), ratio(detected, n).alias("detection_rate")
    )


def ablation(rows: DataFrame, flag_threshold: float = EVALUATION.flag_threshold) -> DataFrame:
    """Metrics with the keyword risk alone, the structural risk alone and the fused risk.

    A row counts as detected from the flag threshold on.  One pass: all counts in one aggregate.
    """
    variants = {"keyword_only": "keyword_risk_score", "structure_only": "ast_risk_score", "fused": "score"}
    aggs = [
        F.struct(
            F.lit(name).alias("variant"),
            *[c.alias(n) for n, c in confusion(F.col("label"), F.col(col) >= F.lit(flag_threshold), F.lit(1)).items()],
        )
        for name, col in variants.items()
    ]
    return with_metrics(rows.agg(F.array(*aggs).alias("v")).select(F.inline("v")))


def security_metrics(metrics: DataFrame) -> DataFrame:
    """Attack success rate (missed attacks), true and false positive rate and false negative rate."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return metrics.withColumns(
        {"asr": ratio(fn, tp + fn), "tpr": ratio(tp, tp + fn), "fnr": ratio(fn, tp + fn), "fpr": ratio(fp, fp + tn)}
    )


# ---- end to end --------------------------------------------------------------------------------


class Evaluation:
    """The frames of one evaluation run, built when first asked for; only ``rows`` grows with the corpus.

    All of them read the stored rows, if there are any: ``close`` deletes these, after the last use of a frame.
    """

    def __init__(self, corpus: DataFrame, scored: DataFrame, settings: tuple[int, float, float], path: str | None = None):
        self.corpus, self.scored, self.settings, self.path = corpus, scored, settings, path

    def close(self) -> None:
        if self.path is not None:
            delete(self.corpus.sparkSession, self.path)
            self.path = None

    @cached_property
    def stats(self) -> DataFrame:
        return corpus_stats(self.corpus)

    @cached_property
    def split_stats(self) -> DataFrame:
        return corpus_stats(self.scored, "label", by=["split"])

    @cached_property
    def cube(self) -> DataFrame:
        return outcome_cube(self.scored)

    @cached_property
    def curve(self) -> DataFrame:
        return sweep_curve(self.cube)

    @cached_property
    def best(self) -> DataFrame:
        """The operating point chosen on ``val``: the only one applied anywhere."""
        return best_of_split(self.curve, "val")

    @cached_property
    def oracle(self) -> DataFrame:
        """The point that would have been best on ``test``, for reference only."""
        return best_of_split(self.curve, "test")

    @cached_property
    def metrics(self) -> DataFrame:
        return split_metrics(self.cube, self.best)

    @cached_property
    def gap(self) -> DataFrame:
        return overfit_gap(self.metrics)

    @cached_property
    def rows(self) -> DataFrame:
        return apply_threshold(self.scored, self.best)

    @cached_property
    def report(self) -> DataFrame:
        return report_row(self.metrics, self.best, self.oracle, *self.settings)


def run_evaluation(
    corpus: DataFrame,
    id_col: str = "id",
    config: VerdictConfig = EVALUATION,
    seed: int = SEED,
    train_ratio: float = TRAIN_RATIO,
    val_ratio: float = VAL_RATIO,
    store: bool = True,
) -> Evaluation:
    """Split, score, choose the threshold on ``val`` only, apply it everywhere and report.

    ``corpus`` has the columns of ``read_corpus`` plus a unique id, named by ``id_col``.  With ``store`` the
    scored rows are written once to the shared folder and read back, so no later step scores again; the caller
    ends with ``close``.
    """
    if id_col not in corpus.columns:
        raise ValueError(f"the corpus has no column {id_col!r}: name a field with unique ids by id_col")
    parts = stratified_split(corpus, id_col, "toxic", train_ratio, val_ratio, seed)
    scored, path = evaluation_rows(score(parts, "query", config=config), id_col=id_col), None
    if store:
        scored, path = materialize(scored, "scored_rows")
    return Evaluation(corpus, scored, (seed, train_ratio, val_ratio), path)


def report_row(
    metrics: DataFrame,
    best: DataFrame,
    oracle: DataFrame,
    seed: int = SEED,
    train_ratio: float = TRAIN_RATIO,
    val_ratio: float = VAL_RATIO,
) -> DataFrame:
    """One row with the nested report: config, train, validate and test."""
    shown = ("precision", "recall", "f1", "accuracy", "tp", "fp", "tn", "fn")
    swept = F.struct("threshold", "f1", "precision", "recall", "tp", "fp", "tn", "fn")

    def of(split: str, kind: str) -> Column:
        return F.max(F.when((F.col("split") == split) & (F.col("kind") == kind), F.struct(*shown)))

    def size(split: str) -> Column:
        total = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
        return F.coalesce(F.max(F.when((F.col("split") == split) & (F.col("kind") == "hard"), total)), F.lit(0))

    threshold = best.select("threshold").scalar()
    return metrics.agg(
        F.struct(
            F.lit(seed).alias("random_seed"),
            F.lit(train_ratio).alias("train_ratio"),
            F.lit(val_ratio).alias("val_ratio"),
            F.lit(round(1.0 - train_ratio - val_ratio, 2)).alias("test_ratio"),
            threshold.alias("best_threshold_from_val"),
        ).alias("config"),
        F.struct(size("train").alias("n"), of("train", "sweep").alias("sweep"), of("train", "hard").alias("hard")).alias(
            "train"
        ),
        F.struct(
            size("val").alias("n"), best.select(swept).scalar().alias("sweep"), of("val", "hard").alias("hard")
        ).alias("validate"),
        F.struct(
            size("test").alias("n"),
            of("test", "sweep").alias("sweep_with_val_threshold"),
            of("test", "hard").alias("hard"),
            oracle.select(swept).scalar().alias("sweep_oracle"),
        ).alias("test"),
    )
