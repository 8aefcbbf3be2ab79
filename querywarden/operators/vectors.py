"""The gold vector nearest by cosine, for questions that are given as vectors.

Vectors of one direction form a class; of a class only its two smallest ids travel, however many copies it has.

The query classes go in blocks of bounded size to all gold classes, which are read once for each block and never
shuffled; a maximum keeps the best of all tasks, and each block's answers are stored before the next one starts.

*Bands* (`nearest_vector`): random hyperplanes cut space into buckets.  A gold class has one bucket key for each band;
a query asks for its own bucket and those across one plane.  A task sorts both by key, band by band, and takes the
cosines of a bucket's candidates in full, as one matrix product.
Keys get one bit more with every doubling of the gold classes, so that a bucket does not grow with the data, and the
number of bands is what finds a pair of the stated cosine with the stated chance.

*Exact* (`exact=True`): each query class against each gold class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.storage import checkpointed
from .skew import spread_join

#: Gold classes in a bucket, about.
BUCKET = 64
MAX_BITS = 30
#: Bytes of the query vectors of one block.
BLOCK_BYTES = 8 << 20
#: Gold classes that a task sorts into buckets at a time, and cosines of one matrix product, about.
CHUNK_ROWS = 1 << 16
PRODUCT = 4 << 20
#: Cosines are compared as whole numbers of this many parts.
_PARTS = 10**9
#: No id, where none is needed.
_NONE = -(2**63)
_FOUND = "h long, lo long, c long, id long"


def band_plan(classes: int, similarity: float, recall: float) -> tuple[int, int]:
    """(bits of a key, number of bands): the planes of one band all but one agree on a pair of that cosine with
    chance p, and 1 - (1 - p)^bands is at least ``recall``."""
    if not (0 < recall < 1 and -1 < similarity < 1):
        raise ValueError("recall lies between 0 and 1, similarity between -1 and 1")
    bits = min(max(round(math.log2(max(classes, 1) / BUCKET)), 1), MAX_BITS)
    if bits == 1:  # the bucket and its one neighbour are all there is
        return 1, 1
    agree = 1 - math.acos(similarity) / math.pi
    p = agree**bits + bits * agree ** (bits - 1) * (1 - agree)
    return bits, max(math.ceil(math.log(1 - recall) / math.log1p(-p)), 1)


def _with_unit(df: DataFrame, vector_col: str, size: int) -> DataFrame:
    """Add ``_unit``, the vector divided by its length, or NULL where it has no direction."""

    def once(value: Column, use) -> Column:
        """``use`` of a value that is computed once and not for each element."""
        return F.transform(F.array(value), use)[0]

    vec = F.col(vector_col).cast("array<double>")
    sound = (F.size(vec) == size) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    largest = F.aggregate(vec, F.lit(0.0), lambda acc, x: F.greatest(acc, F.abs(x)))

    def scaled(most: Column) -> Column:
        return F.when(most > 0, F.transform(vec, lambda x: x / most))

    def unit(own: Column) -> Column:
        return once(F.sqrt(F.aggregate(own, F.lit(0.0), lambda acc, x: acc + x * x)), lambda norm: F.transform(own, lambda x: x / norm))

    return df.withColumn("_unit", F.when(sound, once(largest, lambda most: once(scaled(most), unit))))


def _units(df: DataFrame, id_col: str, vector_col: str, size: int) -> DataFrame:
    """id and unit of the rows that have both."""
    held = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("vector"))
    return _with_unit(held, "vector", size).select("id", F.col("_unit").alias("unit")).where("id IS NOT NULL AND unit IS NOT NULL")


def _classes(units: DataFrame) -> DataFrame:
    """unit, lo and second (or NULL): the two smallest ids of each direction. Tasks hand on two rows of each at most."""
    place = F.row_number().over(Window.partitionBy("unit").orderBy("id"))
    two = units.withColumn("place", place).where("place <= 2")
    return two.groupBy("unit").agg(F.min("id").alias("lo"), F.max(F.when(F.col("place") == 2, F.col("id"))).alias("second"))


def _bucket_keys(units: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """The bucket key of each unit vector in one band."""
    return (units @ planes > 0) @ (1 << np.arange(planes.shape[1], dtype=np.int64))


#: 2^63 and 2^64 as decimals.
_HALF, _WIDE = f"cast({2**63}BD AS decimal(20,0))", f"cast({2**64}BD AS decimal(20,0))"


def _best(pairs: DataFrame) -> DataFrame:
    """h, lo, c, found: of the candidates (h, lo, c, id) of each query class the largest c, then the smallest id.

    Both are packed into one decimal, whose maximum is combined before the shuffle without a sort."""
    best = pairs.groupBy("h", "lo").agg(F.max(F.expr(f"cast(c + {_PARTS + 1} AS decimal(11,0)) * {_WIDE} + ({_HALF} - cast(id AS decimal(20,0)))")).alias("best"))
    best = best.withColumn("high", F.expr(f"(best - 1) div {_WIDE}"))
    rest = F.expr(f"cast({_HALF} - (best - cast(high AS decimal(11,0)) * {_WIDE}) AS long)")
    return best.select("h", "lo", (F.col("high") - (_PARTS + 1)).alias("c"), rest.alias("found"))


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids and units of about ``CHUNK_ROWS`` gold classes, by id."""

    def whole(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.concatenate([np.asarray(b.column(0)) for b in held])
        order = np.argsort(ids, kind="stable")
        return ids[order], np.concatenate([np.asarray(b.column(1).flatten()).reshape(-1, size) for b in held])[order]

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= CHUNK_ROWS:
            yield whole(held)
            held, n = [], 0
    if held:
        yield whole(held)


def _answers(h: np.ndarray, lo: np.ndarray, top: np.ndarray, held: np.ndarray) -> Iterator[pa.RecordBatch]:
    met = top > np.iinfo(np.int64).min
    for a in range(0, int(met.sum()), 20_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[met][a : a + 20_000]) for x in (h, lo, top, held)], names=["h", "lo", "c", "id"])


def _within_bands(shared, size: int, bits: int, bands: int, seed: int):
    """The best gold class of a part for each query of the block, of those it meets in a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, lo, own, units = shared.value
        none = np.iinfo(np.int64).min
        top, held = np.full(len(h), none), np.zeros(len(h), np.int64)
        planes = np.random.default_rng(seed).standard_normal((bands, size, bits))
        masks = np.array([0, *(1 << b for b in range(bits))], np.int64)
        for ids, rows in _chunks(batches, size):
            for band in range(bands):
                keys = _bucket_keys(rows, planes[band])
                by_key = np.argsort(keys, kind="stable")
                places, gold = ids[by_key], rows[by_key]
                found, begin = np.unique(keys[by_key], return_index=True)
                end = np.append(begin[1:], len(keys))
                probes = (_bucket_keys(units, planes[band])[:, None] ^ masks).ravel()
                asking = np.argsort(probes, kind="stable")
                probes = probes[asking]
                asking //= len(masks)
                first, last = np.searchsorted(probes, found, "left"), np.searchsorted(probes, found, "right")
                for g in np.flatnonzero(last > first).tolist():
                    other, there = gold[begin[g] : end[g]].T, places[begin[g] : end[g]]
                    step = max(PRODUCT // len(there), 1)
                    for a in range(first[g], last[g], step):
                        q = asking[a : min(a + step, last[g])]
                        c = np.rint(units[q] @ other * _PARTS).astype(np.int64)
                        c[own[q][:, None] == there] = none  # its own class is no answer
                        at = c.argmax(axis=1)  # the smallest id of the best
                        c, met = c[np.arange(len(q)), at], there[at]
                        better = (c > top[q]) | (c == top[q]) & (c > none) & (met < held[q])
                        top[q[better]], held[q[better]] = c[better], met[better]
        yield from _answers(h, lo, top, held)

    return run


def _against(shared, size: int):
    """The best gold class of a part for each query of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, lo, own, units = shared.value
        top = np.full(len(h), np.iinfo(np.int64).min)
        held = np.zeros(len(h), np.int64)
        for batch in batches:
            ids = np.asarray(batch.column(0))
            order = np.argsort(ids, kind="stable")
            ids, rows = ids[order], np.asarray(batch.column(1).flatten()).reshape(-1, size)[order]
            if not len(ids):
                continue
            step = max((4 << 20) // len(ids), 1)
            for a in range(0, len(h), step):
                part = units[a : a + step]
                c = np.rint(part @ rows.T * 10**9).astype(np.int64)
                place = np.minimum(np.searchsorted(ids, own[a : a + step]), len(ids) - 1)
                own_class = np.flatnonzero(ids[place] == own[a : a + step])  # is no answer
                c[own_class, place[own_class]] = np.iinfo(np.int64).min
                at = c.argmax(axis=1)  # the smallest id of the best
                c, found = c[np.arange(len(c)), at], ids[at]
                better = (c > top[a : a + step]) | (c == top[a : a + step]) & (found < held[a : a + step])
                top[a : a + step] = np.where(better, c, top[a : a + step])
                held[a : a + step] = np.where(better, found, held[a : a + step])
        yield from _answers(h, lo, top, held)

    return run


def _by_blocks(asked: DataFrame, index: DataFrame, size: int, block_bytes: int, search) -> DataFrame:
    spark = asked.sparkSession
    blocks = max(-(-asked.count() * size * 8 // block_bytes), 1)
    out = None
    for b in range(blocks):
        rows = asked.where(F.pmod("h", F.lit(blocks)) == b).select("h", "lo", F.coalesce("own", F.lit(_NONE)).alias("own"), "unit").toArrow()
        if not len(rows):
            continue
        units = np.asarray(rows["unit"].combine_chunks().flatten()).reshape(-1, size)
        shared = spark.sparkContext.broadcast((*[rows[n].to_numpy() for n in ("h", "lo", "own")], units))
        found = index.select("lo", "unit").mapInArrow(search(shared), _FOUND)
        found = checkpointed(_best(found))
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "h long, lo long, c long, found long") if out is None else out


def nearest_vector(
    queries: DataFrame,
    gold: DataFrame,
    size: int,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    similarity: float = 0.65,
    recall: float = 0.95,
    exact: bool = False,
    same_table: bool = False,
    seed: int = 42,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Add ``nearest_id`` and ``nearest_cosine``: of the gold rows the one with the largest cosine (of nine decimals), the
    smallest id among equals.

    By bands the nearest one is found with a chance of at least ``recall`` if its cosine is at least ``similarity``,
    and less often if it is smaller (a query that meets no bucket gets NULL); ``exact`` always finds it.
    ``same_table``: a query's own id is not its neighbour.

    Vectors of another length than ``size``, with a NULL, NaN or infinite component or of length zero have no neighbour and are
    none; nor has or is a row without an id.  Ids are whole numbers, one for each row of gold.  Other columns are kept.
    """
    index = checkpointed(_classes(_units(gold, id_col, vector_col, size)))
    classes = _units(queries, id_col, vector_col, size).groupBy("unit").agg(F.min("id").alias("lo"))
    own = index.select("unit", F.col("lo").alias("own"), "second")
    asked = checkpointed(classes.withColumn("h", F.xxhash64("unit")).join(own, "unit", "left"))
    if exact:
        best = _by_blocks(asked, index, size, block_bytes, lambda shared: _against(shared, size))
    else:
        bits, bands = band_plan(index.count(), similarity, recall)
        best = _by_blocks(asked, index, size, block_bytes, lambda shared: _within_bands(shared, size, bits, bands, seed))
    answers = asked.join(best, ["h", "lo"], "left").select(F.col("unit").alias("_unit"), *[F.col(n).alias(f"_{n}") for n in ("own", "second", "c", "found")])

    # Rows without a direction share one stand-in that no direction equals.
    kept = [F.col(f"`{c}`") for c in queries.columns]
    rows = _with_unit(queries.withColumn("_id", F.col(f"`{id_col}`").cast("long")), f"`{vector_col}`", size)
    rows = rows.withColumn("_unit", F.coalesce(F.when(F.col("_id").isNotNull(), F.col("_unit")), F.array().cast("array<double>")))
    twin = F.when(F.col("_own") == F.col("_id"), F.col("_second")).otherwise(F.col("_own")) if same_table else F.col("_own")
    joined = spread_join(rows, answers, ["_unit"]).withColumn("_twin", twin)
    by_twin = F.col("_twin").isNotNull() & (F.coalesce("_c", F.lit(-_PARTS - 1)) < _PARTS)
    nearest = F.when(by_twin, F.col("_twin")).otherwise(F.least("_found", F.when(F.col("_c") >= _PARTS, F.col("_twin"))))
    cosine = F.when(by_twin, F.lit(1.0)).otherwise(F.col("_c") / F.lit(float(_PARTS)))
    return joined.select(*kept, nearest.alias("nearest_id"), cosine.alias("nearest_cosine"))
