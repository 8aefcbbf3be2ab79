"""Near-duplicates by HyperMinHash registers: documents link if 100 * |A ∩ B| >= 80 * |A ∪ B| over their sets of
distinct word shingles (words with A-Z in lower case).

1. A document's shingle hashes fall into 160 buckets. A bucket keeps its smallest hash, compressed to 16 bits: the
   count of leading zeros and the next 10 bits (the mantissa). A bucket without a hash takes the register of the
   first filled one in an order fixed for each bucket, so that sets of any size fill every register and a register
   of two sets agrees with the probability of their similarity.
2. Equal sets become one representative, so copies cost one row each from here on.
3. 40 bands of 4 registers. Pairs at the similarity 0.8 miss all bands with probability (1 - 0.8^4)^40 < 1e-9.
4. Representatives of one band value are compared with the smallest of them (its pivot), which takes one row for
   each. The similarity estimate, (agreement - e) / (1 - e) with e the chance that different minima share a register,
   throws out pairs that lie 6 standard errors below the threshold; the rest is confirmed on the full sets.
5. The confirmed links join most of a group. Where a band value still holds several components, the rows outside
   the pivot's are compared with all others in blocks, first by registers, then on the full sets in the same block.
   A block returns a spanning forest of the links that join components, so no group's pairs are ever written.

A document without words (or text) has the empty set and links with nothing; with fewer words than a shingle, the
whole sequence is its one shingle. A component has the smallest id of its documents; a null id never names one
unless it has no other. Rows are compared by their text, whatever their ids; repeated rows are copies. An empty
table gives an empty one. Other columns are ignored. Sets are sets of 64-bit hashes; two shingles of a pair of
documents share one with a probability of about n² / 2^64. The full sets are fetched in a second pass over the texts
for the rows that a fixed-size filter (16 MB at most) lets through; beyond some ten million candidates the filter lets
through more than is needed, which costs shuffle but changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querywarden.llm.base import checkpointed, ship
from querywarden.llm.components import components
from querywarden.llm.hashing import mix, range_hashes, slices, window_hashes, word_hashes, words_of

#: Buckets, registers of a band, mantissa bits of a register.
BUCKETS, BAND, MANTISSA = 160, 4, 10
BANDS = BUCKETS // BAND
#: Standard errors that an estimate may lie below the threshold before a pair is given up.
ERRORS = 6
#: Rows of a block of comparisons; most bits of the filter for the second pass.
BLOCK, FILTER_BITS = 512, 1 << 27

#: Row i: the order in which bucket i looks for a register, itself first.
_ORDER = np.argsort(mix(np.arange(BUCKETS * BUCKETS, dtype=np.uint64) + np.uint64(1)).reshape(BUCKETS, BUCKETS) | np.uint64(1), axis=1)
_ORDER = np.column_stack([np.arange(BUCKETS), _ORDER])
_BAND_SALT = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(texts: pa.Array, size: int = 2) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of rows: the first row, the rows' set sizes, and their sorted distinct hashes one after the other."""
    for low, high, data, offsets in slices(texts):
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        words = words_of(data, offsets)
        hashes = word_hashes(words)
        windows, inside = window_hashes(words, hashes, size)
        count = np.diff(words.first)
        short = np.flatnonzero((count > 0) & (count < size))
        rows = np.concatenate([words.row[inside], short])
        values = np.concatenate([windows[inside], range_hashes(hashes, words.first[short], words.first[short + 1])])
        order = np.lexsort((values, rows))
        rows, values = rows[order], values[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
        yield low, np.bincount(rows[new], minlength=high - low), values[new]


def registers(sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """One row of registers for each set; rows of empty sets are zero."""
    out = np.zeros((len(sizes), BUCKETS), np.uint16)
    if not len(values):
        return out
    row = np.repeat(np.arange(len(sizes)), sizes)
    # The bucket grows with the hash, so the sorted hashes of a set come in runs of one bucket.
    bucket = ((values >> np.uint64(32)) * np.uint64(BUCKETS) >> np.uint64(32)).astype(np.int64)
    place = row * BUCKETS + bucket
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    least = np.minimum.reduceat(mix(values ^ np.uint64(0xA0761D6478BD642F)), first)
    bits = np.frexp(least.astype(np.float64))[1].astype(np.uint64)  # of the hash; it may round up to one more
    zeros = np.uint64(64) - np.minimum(bits, np.uint64(64))
    mantissa = least << np.minimum(zeros + np.uint64(1), np.uint64(63)) >> np.uint64(64 - MANTISSA)
    out.reshape(-1)[place[first]] = (np.minimum(zeros, np.uint64(62)) << np.uint64(MANTISSA)) + mantissa + np.uint64(1)
    for low in range(0, len(sizes), 128):
        part = out[low : low + 128]
        lacking = np.flatnonzero((part == 0).any(axis=1) & (sizes[low : low + 128] > 0))
        if len(lacking):
            donor = (part[lacking] != 0)[:, _ORDER].argmax(axis=2)
            part[lacking] = np.take_along_axis(part[lacking], _ORDER[np.arange(BUCKETS), donor], axis=1)
    return out


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The probability that the registers of two different minima agree, for sets of n and m shingles: they need
    the same number of leading zeros and then the same mantissa."""
    level = np.arange(62.0)
    upper, lower = 2.0**-level, 2.0 ** -(level + 1)

    def shares(size: np.ndarray) -> np.ndarray:
        held = np.maximum(size / BUCKETS, 1.0)[:, None]
        return (1 - lower) ** held - (1 - upper) ** held

    return (shares(n) * shares(m)).sum(axis=1) / (1 << MANTISSA)


def estimate(agreeing: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The similarity from the number of agreeing registers, corrected for chance agreement."""
    e = chance(n, m)
    return (agreeing / BUCKETS - e) / (1 - e)


def possible(agreeing: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether two sets may reach the threshold: by their sizes, and by the estimate with its error."""
    t = percent / 100
    small, large = np.minimum(n, m), np.maximum(n, m)
    error = np.sqrt(t * (1 - t) * (1 / BUCKETS + 1 / np.maximum(large, 1)))
    return (100 * small >= percent * large) & (estimate(agreeing, n, m) >= t - ERRORS * error)


def _mark(digest: bytes, row_id: str | None) -> int:
    return xxhash.xxh3_64_intdigest(digest + (row_id or "\0").encode()) - (1 << 63)


def _sketches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(id, text of the id, text) to (id, n, digest of the set, registers, mark)."""
    for batch in batches:
        names, texts = batch.column(1).to_pylist(), batch.column(2)
        for low, sizes, values in shingle_sets(texts, size):
            ends = np.cumsum(sizes)
            rows = registers(sizes, values)
            digests = [xxhash.xxh3_128_digest(values[e - n : e].tobytes()) if n else None for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(low, len(sizes)),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array([r.tobytes() if n else None for r, n in zip(rows, sizes.tolist(), strict=True)], pa.binary()),
                    pa.array([_mark(d, names[low + i]) if d else 0 for i, d in enumerate(digests)], pa.int64()),
                ],
                names=["id", "n", "digest", "registers", "mark"],
            )


def _matrix(column: pa.Array, dtype: type = np.uint16) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, registers) to (band, key, digest) for every band."""
    for batch in batches:
        for low in range(0, batch.num_rows, 2000):
            part = batch.slice(low, 2000)
            keys = mix(np.ascontiguousarray(_matrix(part.column(1))).view("<u8") ^ _BAND_SALT)
            columns = [
                pa.array(np.tile(np.arange(BANDS, dtype=np.int32), part.num_rows)),
                pa.array(keys.ravel().view(np.int64)),
                part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), BANDS))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["band", "key", "digest"])


def _estimated(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, n, m, registers of a, of b): the pairs that may link."""
    for batch in batches:
        if batch.num_rows:
            n, m = (np.asarray(batch.column(i)).astype(np.float64) for i in (2, 3))
            agreeing = (_matrix(batch.column(4)) == _matrix(batch.column(5))).sum(axis=1)
            yield batch.select([0, 1]).filter(pa.array(possible(agreeing, n, m, percent)))


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, set of a, set of b): the pairs that link."""
    for batch in batches:
        keep = []
        for left, right in zip(batch.column(2), batch.column(3), strict=True):
            a, b = np.frombuffer(left.as_py(), "<u8"), np.frombuffer(right.as_py(), "<u8")
            at = np.minimum(np.searchsorted(a, b), len(a) - 1)
            both = int((a[at] == b).sum())
            keep.append(100 * both >= percent * (len(a) + len(b) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gather rows sorted by (band, key, i, j) to one batch for each value of the four."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.column_stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(4)])
        starts = np.append(0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist()
        for low, high in zip(starts, [*starts[1:], len(key)], strict=True):
            if held and (key[low] != last).any():
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
            last = key[low]
    if held:
        yield pa.concat_batches(held)


def _hopeful(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Units of (band, key, i, j, side, label, digest, n, registers): the rows that may link across labels, each
    pair being looked at in the first band in which it agrees."""
    for unit in _units(batches):
        side, n = np.asarray(unit.column(4)), np.asarray(unit.column(7)).astype(np.float64)
        label = unit.column(5).dictionary_encode().indices.to_numpy()
        rows, band, wanted = _matrix(unit.column(8)), unit.column(0)[0].as_py(), np.zeros(len(side), bool)
        right = np.flatnonzero(side == 1)
        banded = rows[right].reshape(len(right), BANDS, BAND)[:, :band]
        for x in np.flatnonzero(side == 0):
            good = (label[right] != label[x]) & possible((rows[right] == rows[x]).sum(axis=1), np.full(len(right), n[x]), n[right], percent)
            good &= ~(banded == rows[x].reshape(BANDS, BAND)[:band]).all(axis=2).any(axis=1)
            if good.any():
                wanted[x] = True
                wanted[right[good]] = True
        if wanted.any():
            yield unit.filter(pa.array(wanted)).select(list(range(7)))


def common_counts(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """The sizes of all intersections of a left and a right set, as a product of membership matrices."""
    values, column, count = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    shared = count[column] > 1
    place = np.cumsum(count > 1) - 1
    row, column = row[shared], place[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float64)
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        held = np.zeros((len(left) + len(right), width), np.float32)
        held[row[a:b], column[a:b] - low] = 1
        out += held[: len(left)] @ held[len(left) :].T
    return out.astype(np.int64)


def _joining(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Units of (band, key, i, j, side, label, digest, set): a forest of the links that join two labels."""
    for unit in _units(batches):
        side, label = np.asarray(unit.column(4)), unit.column(5).dictionary_encode().indices.to_numpy()
        sets = [np.frombuffer(s, "<u8") for s in unit.column(7).to_pylist()]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            continue
        both = common_counts([sets[x] for x in left], [sets[y] for y in right])
        n = np.array([len(s) for s in sets])
        hit = (100 * both >= percent * (n[left][:, None] + n[right][None, :] - both)) & (label[left][:, None] != label[right][None, :])
        parent, digest, a, b = list(range(int(label.max()) + 1)), unit.column(6).to_pylist(), [], []
        for x, y in zip(*(i.tolist() for i in np.nonzero(hit)), strict=True):
            u, v = int(label[left[x]]), int(label[right[y]])
            while parent[u] != u:
                u = parent[u]
            while parent[v] != v:
                v = parent[v]
            if u != v:
                parent[u] = v
                a.append(digest[left[x]])
                b.append(digest[right[y]])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _filter_bits(marks: DataFrame) -> np.ndarray:
    """A Bloom filter of two bits for each mark, as an array of bytes of fixed size."""
    size = 1 << 16
    count = marks.count()
    while size < min(16 * count, FILTER_BITS):
        size *= 2
    bits = F.explode(F.array(*[F.shiftrightunsigned("mark", s).bitwiseAND(size - 1) for s in (0, 32)])).alias("bit")
    words = marks.select(bits).groupBy(F.shiftright("bit", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("bits"))
    out = np.zeros(size >> 6, np.int64)
    found = words.toArrow()
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out


def _full_sets(docs: DataFrame, row_id: Column, text: Column, marks: DataFrame, size: int) -> DataFrame:
    """(digest, set) of the rows whose mark is given, and perhaps of a few others."""
    bits = docs.sparkSession.sparkContext.broadcast(_filter_bits(marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value
        top = np.int64(len(held) * 64 - 1)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for low, sizes, values in shingle_sets(batch.column(1), size):
                ends = np.cumsum(sizes).tolist()
                digests, sets = [], []
                for i, (n, e) in enumerate(zip(sizes.tolist(), ends, strict=True)):
                    if not n:
                        continue
                    raw = values[e - n : e].tobytes()
                    digest = xxhash.xxh3_128_digest(raw)
                    mark = _mark(digest, names[low + i])
                    if all(held[b >> 6] >> (b & 63) & 1 for b in (mark & top, (mark % (1 << 64) >> 32) & top)):
                        digests.append(digest)
                        sets.append(raw)
                if digests:
                    yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], names=["digest", "set"])

    found = docs.select(row_id.cast("string").alias("name"), text.alias("text")).mapInArrow(run, "digest binary, `set` binary")
    return checkpointed(found.groupBy("digest").agg(F.first("set").alias("set")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, shingle: int = 2) -> DataFrame:
    """One row per row of docs: the id column, n_shingles, component_id, kept."""
    ship(docs)
    spark = docs.sparkSession
    row_id, text = F.col(id_col), F.col(text_col)
    kind = docs.select(row_id).schema[0].dataType.simpleString()
    rows = checkpointed(
        docs.select(row_id.alias("id"), row_id.cast("string").alias("name"), text.alias("text")).mapInArrow(
            lambda batches: _sketches(batches, shingle), f"id {kind}, n long, digest binary, registers binary, mark long"
        )
    )
    low = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "mark"))
    reps = checkpointed(
        rows.where("n > 0").groupBy("digest").agg(low.alias("low"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    )
    sketch = reps.select("digest", "n", "registers")
    bands = reps.select("digest", "registers").mapInArrow(_band_rows, "band int, key long, digest binary")
    shared = checkpointed(bands.groupBy("band", "key").agg(F.count("*").alias("size"), F.min("digest").alias("pivot")).where("size > 1"))
    members = checkpointed(bands.join(shared.select("band", "key", "pivot"), ["band", "key"]))

    star = members.where("digest <> pivot").select(F.col("pivot").alias("a"), F.col("digest").alias("b")).distinct()
    paired = star.join(sketch.select(F.col("digest").alias("b"), F.col("n").alias("m"), F.col("registers").alias("rb")), "b").join(
        sketch.select(F.col("digest").alias("a"), "n", F.col("registers").alias("ra")), "a"
    )
    hopeful = checkpointed(paired.select("a", "b", "n", "m", "ra", "rb").mapInArrow(lambda x: _estimated(x, percent), "a binary, b binary"))

    def sets_of(digests: DataFrame) -> DataFrame:
        marks = digests.distinct().join(reps.select("digest", F.col("low.mark").alias("mark")), "digest").select("mark")
        return _full_sets(docs, row_id, text, checkpointed(marks), shingle)

    sets = sets_of(hopeful.select(F.col("a").alias("digest")).unionByName(hopeful.select(F.col("b").alias("digest"))))
    both = hopeful.join(sets.select(F.col("digest").alias("b"), F.col("set").alias("sb")), "b").join(
        sets.select(F.col("digest").alias("a"), F.col("set").alias("sa")), "a"
    )
    links = checkpointed(both.select("a", "b", "sa", "sb").mapInArrow(lambda x: _confirmed(x, percent), "a binary, b binary"))
    labels = checkpointed(components(links))

    more = _across(members, sketch, labels, sets_of, percent)
    if more is not None:
        labels = checkpointed(components(links.unionByName(more)))
    labelled = reps.join(labels.withColumnRenamed("node", "digest"), "digest", "left").select("digest", F.col("low.nameless").alias("nameless"), F.col("low.id").alias("id"), F.coalesce("label", "digest").alias("label"))
    labelled = checkpointed(labelled)
    lowest = checkpointed(labelled.groupBy("label").agg(F.min(F.struct("nameless", "id")).alias("lowest")))
    named = checkpointed(labelled.select("digest", "label").join(lowest, "label").select("digest", F.col("lowest.id").alias("component_id")))
    out = rows.where("n > 0").select("id", "n", "digest").join(named, "digest").select("id", "n", "component_id")
    out = out.unionByName(rows.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _across(members: DataFrame, sketch: DataFrame, labels: DataFrame, sets_of, percent: int) -> DataFrame | None:
    """Links between different components that share a band value, or None if there is no candidate."""
    key = ["band", "key", "i", "j"]
    known = members.join(labels.withColumnRenamed("node", "digest"), "digest", "left").select(
        "band", "key", "digest", "pivot", F.coalesce("label", "digest").alias("label")
    )
    known = checkpointed(known)
    home = F.max(F.when(F.col("digest") == F.col("pivot"), F.col("label"))).alias("home")
    mixed = known.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), home, F.count("*").alias("size")).where("lo <> hi")
    mixed = checkpointed(mixed.select("band", "key", "home", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    rows = checkpointed(known.drop("pivot").join(mixed, ["band", "key"]))
    outside = rows.where("label <> home")
    parts = checkpointed(outside.groupBy("band", "key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")))

    def own(n: str) -> Column:
        return F.pmod(F.xxhash64("digest"), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    dealt = rows.join(parts, ["band", "key"])
    left = dealt.where("label <> home").withColumn("i", own("parts")).withColumn("j", every("blocks")).withColumn("side", F.lit(0))
    right = dealt.withColumn("j", own("blocks")).withColumn("i", every("parts")).withColumn("side", F.lit(1))
    units = left.unionByName(right).select(*key, "side", "label", "digest").join(sketch, "digest").select(*key, "side", "label", "digest", "n", "registers")
    schema = "band int, key long, i int, j int, side int, label binary, digest binary"
    count = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = units.repartition(count, *key).sortWithinPartitions(*key)
    hopeful = checkpointed(units.mapInArrow(lambda x: _hopeful(x, percent), schema))
    if hopeful.isEmpty():
        return None
    full = hopeful.join(sets_of(hopeful.select("digest")), "digest").select(*key, "side", "label", "digest", "set")
    full = full.repartition(count, *key).sortWithinPartitions(*key)
    return checkpointed(full.mapInArrow(lambda x: _joining(x, percent), "a binary, b binary"))
