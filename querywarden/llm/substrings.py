"""Substring dedup by repeated-phrase automata.

A window is `window` consecutive words of one document. Every word that a recurring window covers goes; a
window recurs if its words start anywhere else too, in the same document or another.

1. Every window is anchored at its minimizer, the phrase of `PHRASE` words with the smallest hash in it
   (leftmost on a tie). Equal windows have equal anchors, and neighbouring windows mostly share theirs, so a
   document becomes a list of segments, runs of windows with one anchor, a tenth of its windows.
2. Anchors that occur once cannot hold a recurring window and are dropped. Of the segments with a recurring
   anchor one copy each is kept, with its count and its words.
3. Segments are dealt to shards by anchor. A shard confirms the windows that recur, joins neighbouring ones
   to passages, compiles the passages to an Aho-Corasick automaton and streams its segments through it:
   each occurrence marks windows of its segment. As a segment only goes where its anchor's passages
   are, the work grows with the text and not with text times passages.
4. The marks go back to every occurrence of the segment, and from there to the documents.

Anchors with over `HOT` occurrences are not gathered in a shard: their windows are dealt out one by one,
by window, after windows that recur within one task have been settled there.

Segments and the windows of hot anchors are told apart by 128 bits of hashes; cold windows are compared by
their words.

A null text has no words. Documents are keyed by id; if an id is null or repeated, by a hash of id and text.
An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate, compress

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querywarden.llm.base import WORD, arrow_column, checkpointed, ship
from querywarden.llm.hashing import range_hashes, slices, window_hashes, word_hashes, words_of

WINDOW = 35
PHRASE = 5
HOT = 50_000
#: Words of the segments of one automaton, about.
SHARD_WORDS = 200_000
_WORD = re.compile(WORD)
_BITS = 6  # of the number of windows of a segment, at most WINDOW - PHRASE + 1


def segments(words, hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor) of every segment."""
    _, inside = window_hashes(words, hashes, window)
    starts = np.flatnonzero(inside)
    if not len(starts):
        return starts, starts, hashes[:0]
    grams, _ = window_hashes(words, hashes, PHRASE)
    seen = np.lib.stride_tricks.sliding_window_view(grams, window - PHRASE + 1)[starts]
    anchor = starts + seen.argmin(axis=1)
    begin = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (np.diff(starts) != 1)]))
    return starts[begin], np.diff(np.append(begin, len(starts))), grams[anchor[begin]]


def _scan(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for low, _, data, offsets in slices(batch.column(1)):
                words = words_of(data, offsets)
                hashes = word_hashes(words)
                first, count, anchor = segments(words, hashes, window)
                if not len(first):
                    continue
                row = words.row[first]
                at = (first - words.first[row]) << _BITS | count
                whole = range_hashes(hashes, first, first + count + window - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64)), keys.take(pa.array(row + low)), pa.array(at)], names=["anchor", "segment", "key", "at"]
                )

    return run


def _packed(texts: pa.Array) -> pa.Array:
    """Texts as they travel: compressed."""
    packer = zstandard.ZstdCompressor(level=7)
    return pa.array([None if t is None else packer.compress(t.encode("utf-8", "surrogatepass")) for t in texts.to_pylist()], pa.binary())


def _words(packed: bytes | None) -> list[str]:
    return _WORD.findall(zstandard.decompress(packed).decode("utf-8", "surrogatepass")) if packed else []


_ROW = pa.schema([("anchor", pa.int64()), ("w", pa.int64()), ("segment", pa.int64()), ("n", pa.int64()), ("mask", pa.int64()), ("words", pa.string())])


def _cut_out(window: int):
    """From (packed text, its segments) to rows for the shards. A cold segment is one row with its words; a hot
    one is a row for each window, with the window's hash in w and its bit in mask. n = 0: settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], tuple[int, int, bool]] = {}
        for batch in batches:
            out: list[tuple] = []
            for packed, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = _words(packed)
                for s in own:
                    first, count = s["at"] >> _BITS, s["at"] & (1 << _BITS) - 1
                    part = words[first : first + count + window - 1]
                    if not s["hot"]:
                        out.append((s["anchor"], 0, s["segment"], s["n"], 0, " ".join(part)))
                        continue
                    for i in range(count):
                        digest = hashlib.blake2b(" ".join(part[i : i + window]).encode("utf-8", "surrogatepass"), digest_size=8).digest()
                        w, bit = int.from_bytes(digest, "little", signed=True), 1 << i
                        before = seen.get((s["anchor"], w))
                        if before is None:
                            seen[s["anchor"], w] = (s["segment"], bit, s["n"] > 1)
                            out.append((s["anchor"], w, s["segment"], s["n"], bit, None))
                        else:  # this one recurs, and so does the first, which may not know it
                            out.append((s["anchor"], 0, s["segment"], 0, bit, None))
                            if not before[2]:
                                seen[s["anchor"], w] = (*before[:2], True)
                                out.append((s["anchor"], w, before[0], 2, before[1], None))
            if len(seen) > 500_000:
                seen.clear()
            for low in range(0, len(out), 20_000):
                columns = zip(*out[low : low + 20_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROW, strict=True)], schema=_ROW)

    return run


def located(groups: list[list[tuple[int, int, str]]], window: int) -> Iterator[tuple[int, int]]:
    """groups: the segments (id, count, words) of each anchor of a shard. Gives (id, mask of recurring windows)."""
    automaton = ahocorasick.Automaton()
    split, shared = [], []
    for group in groups:
        if len(group) == 1:  # the only words around a recurring anchor, so all of them recur
            segment, _, text = group[0]
            yield segment, (1 << (text.count(" ") + 2 - window)) - 1
            continue
        shared.append(group)
        counts: dict[str, int] = {}
        cut = []
        for _, n, text in group:
            ends = list(accumulate(map(len, text.split(" ")), lambda total, size: total + size + 1))
            begins = [0, *(e + 1 for e in ends[:-1])]
            own = [text[b:e] for b, e in zip(begins, ends[window - 1 :], strict=False)]
            for w in own:
                counts[w] = counts.get(w, 0) + n
            cut.append((begins, ends, own))
        for (_, _, text), (begins, ends, own) in zip(group, cut, strict=True):
            i = 0
            while i < len(own):
                if counts[own[i]] < 2:
                    i += 1
                    continue
                j = i
                while j + 1 < len(own) and counts[own[j + 1]] > 1:
                    j += 1
                passage = f" {text[begins[i] : ends[j + window - 1]]} "
                automaton.add_word(passage, j - i + 1)
                i = j + 1
        split.append(cut)
    if not len(automaton):
        return
    automaton.make_automaton()
    for group, cut in zip(shared, split, strict=True):
        for (segment, _, text), (_, ends, _) in zip(group, cut, strict=True):
            word_at = {e + 1: i for i, e in enumerate(ends)}  # places of " " in the framed text
            mask = 0
            for end, windows in automaton.iter(f" {text} "):
                last = word_at[end] - window + 1
                mask |= ((1 << windows) - 1) << (last - windows + 1)
            if mask:
                yield segment, mask


def _shards(window: int):
    """Rows sorted by anchor and w to (anchor, segment, mask)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        shard: list[list[tuple[int, int, str]]] = []
        anchors: list[int] = []
        size = 0
        open_window: list = [None, None, False]  # (anchor, w), its first row until it recurs, whether it does

        def settle() -> None:
            nonlocal size
            owner = {s[0]: a for a, group in zip(anchors, shard, strict=True) for s in group}
            out.extend((owner[segment], segment, mask) for segment, mask in located(shard, window))
            shard.clear()
            anchors.clear()
            size = 0

        def table() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["anchor", "segment", "mask"])
                out.clear()

        for batch in batches:
            for anchor, w, segment, n, mask, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if words is not None:
                    if not anchors or anchors[-1] != anchor:
                        if size > SHARD_WORDS:
                            settle()
                        anchors.append(anchor)
                        shard.append([])
                    shard[-1].append((segment, n, words))
                    size += len(words) // 6
                elif n == 0:
                    out.append((anchor, segment, mask))
                else:
                    if open_window[0] != (anchor, w):
                        open_window = [(anchor, w), (segment, mask), False]
                        recurs = n > 1
                    else:
                        recurs = True
                    if recurs:
                        if not open_window[2]:
                            out.append((anchor, *open_window[1]))
                        open_window[2] = True
                        out.append((anchor, segment, mask))
            yield from table()
        settle()
        yield from table()

    return run


def kept_words(packed: bytes | None, first: np.ndarray, mask: np.ndarray, window: int) -> tuple[list[str], int]:
    """The words that stay, and the number of all. mask: the recurring windows from word `first` on."""
    words = _words(packed)
    if not len(first):
        return words, len(words)
    mark, bit = np.nonzero(mask[:, None] >> np.arange(1 << _BITS) & 1)
    starts = first[mark] + bit
    n = len(words) + 1
    change = np.bincount(starts, minlength=n) - np.bincount(starts + window, minlength=n)
    return list(compress(words, (np.cumsum(change)[:-1] == 0).tolist())), len(words)


RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """One row per row of docs: the id column, n_words, n_removed and kept (the remaining words, joined by one
    blank)."""
    if not PHRASE <= window < PHRASE + (1 << _BITS) - 1:
        raise ValueError(f"window must be {PHRASE} to {PHRASE + (1 << _BITS) - 2} words")
    ship(docs)
    odd = docs.groupBy(id_col).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(id_col).isNull())
    by_id = dict(docs.dtypes)[id_col] in ("bigint", "int") and odd.isEmpty()
    # Ids that are no key give way to 128 bits of the id and the text: rows that agree in both are one text.
    whole = F.concat_ws("\x1f", F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("")), F.col(text_col))
    key = F.col(id_col).cast("long") if by_id else F.unhex(F.md5(F.encode(whole, "UTF-8")))
    rows = docs.select(key.alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = rows.select("key", "text").where(F.col("text").isNotNull()).mapInArrow(_scan(window), f"anchor long, segment long, key {'long' if by_id else 'binary'}, at long")

    recurring = found.groupBy("anchor").agg(F.count("*").alias("total")).where("total > 1")
    # Copies are merged before the join, so an anchor has a row for each distinct segment; those of one anchor
    # meet in one task, since the other side is an aggregate by anchor.
    distinct = found.groupBy("anchor", "segment").agg(F.count("*").alias("n"), F.min(F.struct("key", "at")).alias("one"))
    candidates = distinct.join(recurring, "anchor")
    by_doc = candidates.groupBy("one.key").agg(
        F.collect_list(F.struct(F.col("one.at").alias("at"), "anchor", "segment", "n", (F.col("total") > hot).alias("hot"))).alias("own")
    )
    packed = rows.select("key", "id", arrow_column(_packed, T.BinaryType())(F.col("text")).alias("packed"))
    texts = packed.select("key", "packed") if by_id else packed.groupBy("key").agg(F.first("packed").alias("packed"))
    parts = texts.join(by_doc, "key").select("packed", "own").mapInArrow(_cut_out(window), "anchor long, w long, segment long, n long, mask long, words string")
    marks = parts.repartition("anchor", "w").sortWithinPartitions("anchor", "w").mapInArrow(_shards(window), "anchor long, segment long, mask long")
    marks = checkpointed(marks.groupBy("anchor", "segment").agg(F.bit_or("mask").alias("mask")))

    placed = found.join(marks, ["anchor", "segment"]).select("key", "at", "mask")
    by_doc = (placed if by_id else placed.distinct()).groupBy("key").agg(F.collect_list(F.struct("at", "mask")).alias("marks"))

    @F.arrow_udf(RESULT)
    def result(texts: pa.Array, marks: pa.Array) -> pa.Array:
        out = []
        at, mask = (np.asarray(marks.values.field(f)) for f in ("at", "mask"))
        borders = np.asarray(marks.offsets)
        for text, low, high in zip(texts.to_pylist(), borders[:-1].tolist(), borders[1:].tolist(), strict=True):
            words, n = kept_words(text, at[low:high] >> _BITS, mask[low:high], window)
            out.append({"n_words": n, "n_removed": n - len(words), "kept": " ".join(words)})
        return pa.array(out, pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]))

    joined = packed.join(by_doc, "key", "left").select(F.col("id").alias(id_col), result.asNondeterministic()("packed", "marks").alias("r"))
    return joined.select(id_col, "r.n_words", "r.n_removed", "r.kept")
