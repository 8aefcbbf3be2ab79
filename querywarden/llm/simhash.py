"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: 64 bits over the XXH64 (seed 42) of the word shingles of the text with A-Z in lower case;
bit i is set if it is set in over half of the hashes, repeats included.

Links: two fingerprints link if they differ in at most `radius` bits. The 64 bits are cut in radius + 1
bands; two linked fingerprints agree in one band at least, so comparing within the groups that share a
band's value finds every link. Groups are cut in blocks of bounded size and every pair of blocks is a task's
unit of work, so a group of any size is spread over the cluster. Within a unit the fingerprints are stored as
bit planes, 64 of them to a machine word; a plane's differences are added to vertical counters by
carry-save logic, and machine words in which every distance exceeds the radius are abandoned.

A unit returns only a spanning forest of its links, which has the same components as all of them.

A null text counts as empty; texts without a word have fingerprint zero and link like any other.
Rows are compared by their text, whatever their ids: unlike rows that share an id, or have none, stay apart. A null
id never names a component unless the component has no other. An empty table gives an empty one. Other columns
are ignored, except to choose between rows of one id and text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querywarden.llm.base import arrow_column, checkpointed, fresh, ship
from querywarden.llm.components import components

BITS = 64
#: Fingerprints of a block; a unit compares two blocks at most.
BLOCK = 4096
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The fingerprint as an unsigned integer. bytes.lower and bytes.split know ASCII alone."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = list(accumulate(map(len, words), lambda total, size: total + size + 1))
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts, ends[min(shingle, len(words)) - 1 :], strict=True)], "<u8")
    counts = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64).view(np.int64))


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def planes(values: np.ndarray) -> np.ndarray:
    """Row p holds bit p of every value, 64 values to a machine word."""
    width = -(-len(values) // BITS) * BITS
    rows = np.zeros((BITS, width), np.uint8)
    rows[:, : len(values)] = _bits(values).T
    return np.packbits(rows, axis=1, bitorder="little").view("<u8")


def _exceeds(counters: list[np.ndarray], limit: int) -> np.ndarray:
    """Lanes whose vertical counter is over the limit."""
    over, same = np.zeros_like(counters[0]), np.full_like(counters[0], _ONES)
    for k in reversed(range(len(counters))):
        if limit >> k & 1:
            same &= counters[k]
        else:
            over |= same & counters[k]
            same &= ~counters[k]
    return over


def within(left: np.ndarray, right: np.ndarray, radius: int, order: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of left and right that differ in at most `radius` of the bits in `order` (and beyond)."""
    sliced, masks = planes(right), np.where(_bits(left) == 1, _ONES, np.uint64(0)).astype(np.uint64)
    q, w = (x.ravel() for x in np.indices((len(left), sliced.shape[1])))
    counters = [np.zeros(len(q), np.uint64) for _ in range(radius.bit_length())]
    over = np.zeros(len(q), np.uint64)
    over[w == sliced.shape[1] - 1] = ~np.uint64(0) << np.uint64((len(right) - 1) % BITS) << np.uint64(1)
    for step, p in enumerate(order, 1):
        carry = sliced[p][w] ^ masks[q, p]
        for k, held in enumerate(counters):
            counters[k], carry = held ^ carry, held & carry
        over |= carry
        if step % 4 == 0 or step == len(order):
            over |= _exceeds(counters, radius)
            alive = over != _ONES
            if not alive.any():
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            if alive.sum() < 0.7 * len(alive):
                q, w, over, counters = q[alive], w[alive], over[alive], [c[alive] for c in counters]
    hit = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, lane = np.nonzero(hit)
    return q[row], w[row] * BITS + lane


def _forest(count: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links a[i] – b[i]."""
    parent, out = list(range(count)), []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = x, y
        while parent[rx] != rx:
            parent[rx] = rx = parent[parent[rx]]
        while parent[ry] != ry:
            parent[ry] = ry = parent[parent[ry]]
        if rx != ry:
            parent[rx] = ry
            out.append((x, y))
    return out


def bands_of(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of radius + 1 bands."""
    edges = [round(i * BITS / (radius + 1)) for i in range(radius + 2)]
    return [(low, high - low) for low, high in zip(edges, edges[1:], strict=False)]


def _unit_links(band: int, first_block: int, second_block: int, blocks: np.ndarray, values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    low, width = bands_of(radius)[band]
    order = [p for p in range(BITS) if not low <= p < low + width]
    sides = (values, values) if first_block == second_block else (values[blocks == first_block], values[blocks == second_block])
    left, right = (side.view(np.uint64) for side in sides)
    out = []
    for start in range(0, len(left), 512):
        a, b = within(left[start : start + 512], right, radius, order)
        a = a + start
        if first_block == second_block:
            a, b = a[a < b], b[a < b]
            joined = sides[0]
        else:
            b, joined = b + len(left), np.concatenate(sides)
        out += [(int(joined[x]), int(joined[y])) for x, y in _forest(len(joined), a, b)]
    return out


def links(fingerprints: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """fingerprints: one column of distinct signed 64-bit values. Returns (a, b): a spanning forest for each
    unit of work, together with the same components as all links."""
    ship(fingerprints)
    (name,) = fingerprints.columns
    cut = F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(name, low).bitwiseAND((1 << width) - 1).alias("value")) for i, (low, width) in enumerate(bands_of(radius))])
    rows = fingerprints.select(F.col(name).alias("fp"), F.explode(cut).alias("k")).select("fp", "k.band", "k.value")
    large = rows.groupBy("band", "value").agg(F.count("*").alias("n")).where(F.col("n") > block)
    blocks = F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    units = (
        rows.join(large, ["band", "value"], "left")
        .select("fp", "band", "value", blocks.alias("blocks"))
        .withColumn("block", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("band", "value", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp")
    )
    key = ["band", "value", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def close(unit: np.ndarray) -> list[tuple[int, int]]:
            return _unit_links(int(unit[0, 0]), int(unit[0, 2]), int(unit[0, 3]), unit[:, 4], unit[:, 5], radius) if len(unit) > 1 else []

        def table(found: list[tuple[int, int]]) -> pa.RecordBatch:
            a, b = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = np.column_stack([np.asarray(c.cast(pa.int64())) for c in batch.columns])
            if held and (held[-1][-1, :4] == now[0, :4]).all():
                held.append(now)
            else:
                held = [np.concatenate(held), now] if held else [now]
                found = close(held[0]) if len(held) > 1 else []
                if found:
                    yield table(found)
                held = held[-1:]
            now = np.concatenate(held)
            borders = np.flatnonzero((now[1:, :4] != now[:-1, :4]).any(axis=1)) + 1
            found = []
            for unit in np.split(now, borders)[:-1]:
                found += close(unit)
            if found:
                yield table(found)
            held = [now[borders[-1] :] if len(borders) else now]
        if held and (found := close(np.concatenate(held))):
            yield table(found)

    # A fixed number of partitions: the work is in the comparing, not in the bytes by which Spark would join them.
    parts = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return units.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """One row per row of docs: the id column, fingerprint (signed), label (a key of the component) and
    component_id, the component's smallest id."""
    ship(docs)
    rows = checkpointed(docs.select(F.col(id_col).alias("id"), arrow_column(_fingerprints, T.LongType())(F.col(text_col)).alias("fp")))
    # Both sides of each join are stored, so that Spark can split a component or fingerprint that most rows share.
    labelled = checkpointed(_labelled(checkpointed(rows.groupBy("fp").agg(F.min("id").alias("low"))), radius))
    lowest = checkpointed(labelled.groupBy("label").agg(F.min("low").alias("component_id")))
    named = checkpointed(labelled.select("fp", "label").join(lowest, "label"))
    return rows.join(named, "fp").select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "label", "component_id")


def _labelled(distinct: DataFrame, radius: int) -> DataFrame:
    """distinct: fp, low, one row per fingerprint. Adds label."""
    labels = components(links(distinct.select("fp"), radius))
    return distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """The documents, one row of each component: that with the smallest id, then the smallest hash of the text, then
    that of the whole row. All columns stay."""
    ship(docs)
    key, text_key, row_key, count = (fresh(docs, name) for name in ("kept_id", "kept_text", "kept_row", "kept_rows"))
    # Maps and variants cannot be hashed; rows that differ in them alone count as copies.
    hashable = [F.col(f"`{f.name}`") for f in docs.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    digest, whole = F.md5(F.col(text_col)), F.xxhash64(*hashable)
    rows = docs.select(F.col(id_col).alias("id"), digest.alias("digest"), whole.alias("whole"), arrow_column(_fingerprints, T.LongType())(F.col(text_col)).alias("fp"))
    copies = rows.groupBy("fp", "id", "digest", "whole").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "digest", "whole", "n"))
    distinct = checkpointed(copies.groupBy("fp").agg(first.alias("low")))
    lowest = _labelled(distinct, radius).groupBy("label").agg(F.min("low").alias("low"))
    kept = checkpointed(lowest.select(F.col("low.id").alias(key), F.col("low.digest").alias(text_key), F.col("low.whole").alias(row_key), F.col("low.n").alias(count)))
    found = docs.join(kept, F.col(id_col).eqNullSafe(F.col(key)) & digest.eqNullSafe(F.col(text_key)) & (whole == F.col(row_key)), "inner")
    once = found.where(F.col(count) == 1)
    repeated = found.where(F.col(count) > 1).dropDuplicates([key, text_key, row_key])
    return once.unionByName(repeated).select(*docs.columns)
