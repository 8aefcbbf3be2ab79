"""Sketches: merged parts against the whole, estimates against exact values."""

import math
import random

import pytest
from pyspark.sql import functions as F
from querywarden.operators.sketches import distinct_counts, merge, quantile_values, sketch, store, stored

SHARES = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    out = [(i % 5, f"q{rng.randrange(30000)}", int(math.exp(rng.uniform(0, 20))) * rng.choice((1, 1, -1))) for i in range(40000)]
    return out + [(None, None, None), (4, None, 0), (None, "", 63), (1, "é", 64), (2, "x", -(2**62))]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "day int, text string, size long").repartition(8)


def cells(df):
    return sorted((r.column, r.kind, r.bucket, r.value) for r in df.select("column", "kind", "bucket", "value").collect())


def test_merged_parts_equal_the_whole(frame):
    whole = sketch(frame, distinct=["text"], quantiles=["size"])
    assert cells(merge(sketch(frame, ["day"], distinct=["text"], quantiles=["size"]))) == cells(whole)


def test_distinct_within_the_error(frame, rows):
    for shown in ([r for r in rows if r[0] == 3], rows):
        held = frame.where("day = 3") if shown is not rows else frame
        exact = len({r[1] for r in shown if r[1] is not None})
        assert distinct_counts(sketch(held, distinct=["text"])).first()["distinct"] == pytest.approx(exact, rel=4 * 1.04 / 64)


def test_quantiles_within_the_step(frame, rows):
    ordered = sorted(r[2] for r in rows if r[2] is not None)
    got = quantile_values(sketch(frame, quantiles=["size"]), SHARES).collect()
    assert len(got) == len(SHARES)
    for r in got:
        exact = ordered[max(math.ceil(r.share * len(ordered)), 1) - 1]
        assert r.n == len(ordered) and abs(r.value - exact) <= abs(exact) / 64 and (abs(exact) >= 64 or r.value == exact)


def test_a_part_stored_twice_counts_once(spark, frame, tmp_path):
    path = str(tmp_path / "days")
    days = sketch(frame, ["day"], distinct=["text"], quantiles=["size"])
    store(days.where("day < 3"), path, ["day"])
    store(days.where("day >= 2 OR day IS NULL"), path, ["day"])
    store(days.where("day = 1"), path, ["day"])
    assert cells(merge(stored(spark, path))) == cells(sketch(frame, distinct=["text"], quantiles=["size"]))


def test_a_part_stays_small(spark):
    day = spark.range(400000).select(F.col("id").cast("string").alias("text"), (F.col("id") * F.col("id")).alias("size"))
    held = sketch(day, distinct=["text"], quantiles=["size"])
    assert held.where("kind = 'distinct'").count() <= 4096 and held.where("kind = 'quantile'").count() < 1300
    assert distinct_counts(held).first()["distinct"] == pytest.approx(400000, rel=4 * 1.04 / 64)


def test_empty(spark, frame):
    none = sketch(frame.limit(0), ["day"], distinct=["text"], quantiles=["size"])
    assert none.count() == 0 and distinct_counts(none).count() == 0 and quantile_values(none, SHARES).count() == 0
    with pytest.raises(ValueError):
        sketch(frame)
