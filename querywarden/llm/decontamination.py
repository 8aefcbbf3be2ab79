"""Benchmark decontamination: short test items inside long documents.

Text is compared by its lower-case runs of letters and digits, in shingles of five. A document is
contaminated by an item if it holds at least `threshold` of the item's distinct shingles.

Search: items are partitioned by their number of shingles (powers of two). In each partition an item's
MinHash sketch is its k smallest shingle hashes; with k = n - ceil(threshold * n) + 1 a document that
holds enough of the item's n shingles cannot miss all k, so the search loses nothing, however long
the document is. A document is probed only for partitions whose items it is long enough to hold. Every
candidate is then verified by comparing the shingles themselves.

Items are taken in blocks of bounded size, each of which is broadcast and held against all documents; the
documents are read once for each block and never shuffled.

An item of fewer than five words has one shingle of that length; an item without a word, or null, is in no
document; a null document has no shingle. Items with one id, or a null one, are items of their own; repeated documents are
reported each. Empty tables give an empty result. Other columns are ignored by the search.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from querywarden.llm.base import arrow_column, fresh, ship
from querywarden.llm.hashing import SLICE_BYTES, window_hashes, word_hashes, words_of

SHINGLE = 5
THRESHOLD = 0.8
#: Text of the items of one block, about; an item is never split.
BLOCK_BYTES = 4 << 20
_GAP = re.compile(r"[\W_]+")
#: Bits of the first, coarse test of a hash.
_COARSE = 22


def normalised(text: str | None) -> str:
    return _GAP.sub(" ", (text or "").lower()).strip()


def shingles(text: str, size: int) -> set[str]:
    words = text.split()
    return {" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


def _hashes(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `size` words, and the text of each."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    words = words_of(np.frombuffer(b"".join(parts), np.uint8), offsets)
    out, inside = window_hashes(words, word_hashes(words), size)
    return out[inside], words.row[inside]


class Partition(NamedTuple):
    """Items of one shingle length and one power of two of shingles: their sketches' hashes, sorted, and whose they are."""

    size: int
    least: int  # shingles that a document must have to hold any of the items
    coarse: np.ndarray
    hashes: np.ndarray
    owner: np.ndarray


class Index(NamedTuple):
    ids: list
    shingles: list[frozenset[str]]
    partitions: list[Partition]
    threshold: float

    @classmethod
    def of(cls, items: list[tuple[object, str | None]], threshold: float = THRESHOLD, shingle: int = SHINGLE) -> Index:
        ids, held, groups = [], [], {}
        for item, text in items:
            words = normalised(text).split()
            if not words:
                continue
            size = min(shingle, len(words))
            own = frozenset(shingles(" ".join(words), size))
            need = cls.need(len(own), threshold)
            hashes = np.sort(np.unique(_hashes([" ".join(words)], size)[0]))[: len(own) - need + 1]
            groups.setdefault((size, len(own).bit_length()), []).append((need, len(ids), hashes))
            ids.append(item)
            held.append(own)
        partitions = []
        for (size, _), members in sorted(groups.items()):
            hashes = np.concatenate([h for _, _, h in members])
            owner = np.concatenate([np.full(len(h), i) for _, i, h in members])
            order = np.argsort(hashes, kind="stable")
            coarse = np.zeros(1 << _COARSE, bool)
            coarse[hashes >> np.uint64(64 - _COARSE)] = True
            partitions.append(Partition(size, min(n for n, _, _ in members), coarse, hashes[order], owner[order]))
        return cls(ids, held, partitions, threshold)

    @staticmethod
    def need(n: int, threshold: float) -> int:
        return max(1, math.ceil(threshold * n - 1e-9))

    def candidates(self, texts: list[str]) -> list[set[int]]:
        """The items to verify, for each normalised text."""
        out: list[set[int]] = [set() for _ in texts]
        for size in dict.fromkeys(p.size for p in self.partitions):
            hashes, rows = _hashes(texts, size)
            counts = np.bincount(rows, minlength=len(texts))
            prefix = hashes >> np.uint64(64 - _COARSE)
            for part in (p for p in self.partitions if p.size == size):
                near = np.flatnonzero(part.coarse[prefix])
                near = near[counts[rows[near]] >= part.least]
                low, high = np.searchsorted(part.hashes, hashes[near], "left"), np.searchsorted(part.hashes, hashes[near], "right")
                for at, a, b in zip(near[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                    out[rows[at]].update(part.owner[a:b].tolist())
        return out

    def matches(self, texts: list[str | None]) -> Iterator[list[tuple[int, int, int]]]:
        """(item, shared shingles, shingles of the item) for each text, exactly."""
        plain = [normalised(t) for t in texts]
        low = 0
        while low < len(plain):
            high, size = low + 1, len(plain[low])
            while high < len(plain) and size + len(plain[high]) <= SLICE_BYTES:
                size += len(plain[high])
                high += 1
            for text, found in zip(plain[low:high], self.candidates(plain[low:high]), strict=True):
                by_size: dict[int, set[str]] = {}
                out = []
                for item in sorted(found):
                    own = self.shingles[item]
                    n = next(iter(own)).count(" ") + 1
                    if n not in by_size:
                        by_size[n] = shingles(text, n)
                    shared = len(own & by_size[n])
                    if shared >= self.need(len(own), self.threshold):
                        out.append((item, shared, len(own)))
                yield out
            low = high


def _blocks(items: DataFrame, id_col: str, text_col: str, threshold: float, block_bytes: int) -> Iterator[Index]:
    total = items.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    count = -(-total // block_bytes)
    for b in range(count):
        block = items.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(count)) == b) if count > 1 else items
        yield Index.of([tuple(r) for r in block.where(F.col(text_col).isNotNull()).select(id_col, text_col).toLocalIterator()], threshold)


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document and item that it holds: both ids, shared_shingles, item_shingles, containment."""
    ship(docs)
    kind = T.ArrayType(T.StructType([T.StructField("id", items.schema[item_id].dataType), T.StructField("shared", T.LongType()), T.StructField("total", T.LongType())]))
    arrow = pa.list_(pa.struct([("id", to_arrow_type(items.schema[item_id].dataType)), ("shared", pa.int64()), ("total", pa.int64())]))
    out = None
    for index in _blocks(items, item_id, item_text, threshold, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def found(texts: pa.Array, shared=shared) -> pa.Array:
            index = shared.value
            return pa.array([[{"id": index.ids[i], "shared": s, "total": n} for i, s, n in row] for row in index.matches(texts.to_pylist())], arrow)

        if not index.ids:
            continue
        hits = docs.select(F.col(id_col), F.explode(arrow_column(found, kind)(F.col(text_col))).alias("hit"))
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        empty = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("hit", kind.elementType)])
        out = docs.sparkSession.createDataFrame([], empty)
    return out.select(
        id_col, F.col("hit.id").alias(item_id), F.col("hit.shared").alias("shared_shingles"), F.col("hit.total").alias("item_shingles"),
        (F.col("hit.shared") / F.col("hit.total")).alias("containment"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that hold no item, with their own columns."""
    ship(docs)
    out = docs
    for index in _blocks(items, item_id, item_text, threshold, block_bytes):
        shared, flag = docs.sparkSession.sparkContext.broadcast(index), fresh(docs, "clean")

        def clean(texts: pa.Array, shared=shared) -> pa.Array:
            return pa.array([not row for row in shared.value.matches(texts.to_pylist())], pa.bool_())

        out = out.withColumn(flag, arrow_column(clean, T.BooleanType())(F.col(text_col))).where(F.col(flag)).drop(flag)
    return out
