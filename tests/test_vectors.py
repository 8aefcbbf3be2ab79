"""The nearest vector: the exact way and the bands against all pairs."""

import math
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from querywarden.operators import vectors as search
from querywarden.operators.vectors import band_plan, nearest_vector

SIZE = 16


def all_pairs(queries, gold, same):
    """{query id: (cosine of nine decimals, id)} by brute force."""

    def unit(v):
        if v is None or len(v) != SIZE or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.asarray(v, float) / max(map(abs, v))
        return v / np.linalg.norm(v)

    held = sorted(((i, u) for i, v in gold if i is not None and (u := unit(v)) is not None), key=lambda x: x[0])
    ids, units = np.array([i for i, _ in held]), np.array([u for _, u in held])
    out = {}
    for i, v in queries:
        u = unit(v) if i is not None else None
        mine = np.ones(len(ids), bool) if not same else ids != i
        if u is None or not mine.any():
            out[i] = (None, None)
            continue
        cosines = np.round(units[mine] @ u, 9)
        out[i] = (float(cosines.max()), int(ids[mine][cosines.argmax()]))
    return out


def vectors(n, seed):
    """Families around a few centres, copies, multiples and opposites."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, SIZE))
    rows = (centres[rng.integers(0, 12, n)] + 0.25 * rng.standard_normal((n, SIZE))).tolist()
    rows += [rows[0]] * 150 + [[2 * x for x in rows[1]], [-x for x in rows[2]]]
    return list(enumerate(rows))


def odd(first):
    zero, whole = [0.0] * SIZE, [1.0] * SIZE
    held = [zero, None, [], whole[:-1], [*whole[:-1], None], [*whole[:-1], math.nan], [*whole[:-1], math.inf], [1e200] * SIZE, [-1e-200] * SIZE]
    return [(first + k, v) for k, v in enumerate(held)]


def answers(spark, queries, gold, **how):
    kind = "vec_id long, embedding array<double>"
    asked = spark.createDataFrame(queries, kind).withColumn("nearest", F.lit("own")).repartition(4)
    found = nearest_vector(asked, spark.createDataFrame(gold, kind).repartition(4), SIZE, **how)
    assert found.columns == ["vec_id", "embedding", "nearest", "nearest_id", "nearest_cosine"]
    rows = found.collect()
    assert len(rows) == len(queries)
    return {r.vec_id: (r.nearest_cosine, r.nearest_id) for r in rows}


def equal(got, expected):
    assert got.keys() == expected.keys()
    for i, (cosine, j) in expected.items():
        assert got[i][1] == j and (cosine is None and got[i][0] is None or got[i][0] == pytest.approx(cosine, abs=2e-9)), (i, got[i], cosine, j)


@pytest.mark.parametrize("block_bytes", [8 << 20, 40 * SIZE * 8])
def test_exact_is_that_of_all_pairs(spark, block_bytes):
    gold = [*vectors(400, 1), *odd(9000), (None, [1.0] * SIZE)]
    for queries, same in ((gold, True), ([*vectors(150, 2), *odd(-50)], False)):
        equal(answers(spark, queries, gold, exact=True, same_table=same, block_bytes=block_bytes), all_pairs(queries, gold, same))


def test_bands_find_near_ones(spark):
    gold = [*vectors(1200, 3), *odd(9000)]
    expected = all_pairs(gold, gold, True)
    got = answers(spark, gold, gold, similarity=0.8, recall=0.95, same_table=True)
    near = [i for i, (c, _) in expected.items() if c is not None and c >= 0.8]
    assert len(near) > 800 and sum(got[i][1] == expected[i][1] for i in near) >= 0.95 * len(near)
    assert all(got[i][1] is None or got[i][0] <= expected[i][0] + 2e-9 for i in expected)
    assert all(got[i][1] is None for i, (c, _) in expected.items() if c is None)


def test_one_bucket_may_hold_most_rows(spark):
    """With the broadcast off; the rows of the hot bucket are dealt over salts."""
    rng = np.random.default_rng(4)
    gold = list(enumerate((np.ones(SIZE) + 1e-3 * rng.standard_normal((1500, SIZE))).tolist()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        queries = gold[::20]
        equal(answers(spark, queries, gold, similarity=0.8, same_table=True), all_pairs(queries, gold, True))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bands_grow_with_the_table_and_never_pair_all(spark):
    plans = [band_plan(64 << k, 0.65, 0.95) for k in range(1, 16)]
    assert [bits for bits, _ in plans] == list(range(1, 16))
    # The share of the table that a query meets, repeats included, falls from two bits on.
    shares = [bands * (1 + bits) / 2**bits for bits, bands in plans[1:]]
    assert shares == sorted(shares, reverse=True) and shares[-1] < 0.03
    frame = spark.createDataFrame(vectors(50, 5), "vec_id long, embedding array<double>")
    for exact in (True, False):
        plan = nearest_vector(frame, frame, SIZE, exact=exact)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_registered_bands_reach_their_recall(spark, sf):
    from querywarden.plans.queries import REGISTRY

    exact = {r.vec_id: r.nearest_id for r in REGISTRY["nearest_vector"](spark, sf).collect()}
    bands = {r.vec_id: r.nearest_id for r in REGISTRY["nearest_vector_bands"](spark, sf).collect()}
    assert bands.keys() == exact.keys() and sum(bands[i] == exact[i] for i in exact) >= 0.9 * len(exact)


def test_empty_tables_and_bounds(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    one = spark.createDataFrame([(1, [1.0] * SIZE)], "vec_id long, embedding array<double>")
    for exact in (True, False):
        assert nearest_vector(none, one, SIZE, exact=exact).count() == 0
        assert nearest_vector(one, none, SIZE, exact=exact).first()["nearest_id"] is None
        assert nearest_vector(one, one, SIZE, exact=exact).first()["nearest_id"] == 1
        assert nearest_vector(one, one, SIZE, exact=exact, same_table=True).first()["nearest_id"] is None
    with pytest.raises(ValueError):
        nearest_vector(one, one, SIZE, recall=1.0)


def test_a_part_finds_the_best_of_its_buckets(monkeypatch):
    monkeypatch.setattr(search, "CHUNK_ROWS", 70)
    monkeypatch.setattr(search, "PRODUCT", 16)
    size, bits, bands, seed = 8, 5, 4, 3
    units = np.random.default_rng(1).standard_normal((300, size))
    units /= np.linalg.norm(units, axis=1)[:, None]
    ids = np.random.default_rng(2).permutation(300).astype(np.int64)
    asked = np.arange(0, 300, 6)
    own = np.where(asked % 4 == 0, ids[asked], -1)
    shared = SimpleNamespace(value=(asked, asked * 10, own, units[asked]))
    parts = [pa.RecordBatch.from_arrays([pa.array(ids[a : a + 50]), pa.array(units[a : a + 50].tolist())], names=["lo", "unit"]) for a in range(0, 300, 50)]
    got = {}
    for batch in search._within_bands(shared, size, bits, bands, seed)(iter(parts)):
        got |= {h: (c, found) for h, _, c, found in zip(*(x.to_pylist() for x in batch.columns), strict=True)}
    planes = np.random.default_rng(seed).standard_normal((bands, size, bits))
    sides = np.stack([units @ planes[b] > 0 for b in range(bands)])
    for q, held in zip(asked.tolist(), own.tolist(), strict=True):
        met = [g for g in range(300) if ids[g] != held and any((sides[b, q] != sides[b, g]).sum() <= 1 for b in range(bands))]
        best = max(((round(float(units[q] @ units[g]) * 10**9), -int(ids[g])) for g in met), default=None)
        assert (best is None) == (q not in got)
        if best is not None:
            assert abs(got[q][0] - best[0]) <= 1 and got[q][1] == -best[1]
