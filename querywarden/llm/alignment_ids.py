"""Which tokens of two tokenizers stand for the same bytes, and how often a pair of ids does so in the corpus.

A: a byte-level BPE, applied to a blank and the text. B: a piece model that adds the blank itself. Where a token of
each ends at the same byte, a group ends; every A token of a group is linked with every B token of it.

The texts of a task are worked on in blocks of some 2 MB, with Arrow's own operations:

1. A text is cut at blanks between two printable characters. Both tokenizers put such a blank before the word and
   merge nothing across it, so a group ends there, and the ids and groups of a text are those of its stretches in
   turn. Stretches are dictionary-encoded; each distinct one of a block is encoded and aligned once.
2. The lists of ids are flattened with their parent indices; cumulative sums of the tokens' byte lengths, segmented
   by parent, give the tokens' ends.
3. A hash join on (parent, end) finds the ends of groups; cumulative sums of the ends number the groups.
4. Ids are counted in each group and joined by group, which gives the linked pairs with their multiplicity without
   writing out occurrences. Lists of them are taken for every stretch of a document, flattened again, and
   `Table.group_by` adds them up for each document and counts the block's documents that hold a pair.

Spark merges the blocks' document counts of each pair and marks the pairs with the highest count of their A id. Every
block gets back the counts of its own distinct pairs, once each, however many documents hold them; no vocabulary
or count is collected or broadcast.

A null or empty text, and one whose tokens of A or B do not spell a blank and the text, has no tokens: its numbers
are zero and its digest is the empty string. Repeated rows and rows without an id count as documents of their
own. An empty table gives an empty one. Other columns are ignored. One text with its tokens has to fit in a task.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from querywarden.llm.base import checkpointed, ship
from querywarden.llm.hashing import slices

#: Text bytes of a block; stretches that a task remembers, and the longest of them.
BLOCK_BYTES, CACHED, LONGEST = 2_000_000, 300_000, 40

_WORD = re.compile(r"[\w!-~]")
# A blank between two characters of which each is a letter, digit, underscore or printable ASCII.
_CUT = re.compile(r"(?<=[\w!-~]) (?=[\w!-~])")
NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def byte_alphabet() -> dict[str, int]:
    """The character that a byte-level vocabulary writes for each byte: printable Latin-1 stands for itself, the
    other bytes take the code points from 256 on, in turn."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """The bytes of every id, their number, and the id in decimal."""

    def __init__(self, entries: list[bytes]) -> None:
        self.bytes = entries
        self.lengths = np.array([len(e) for e in entries], np.int64)
        self.names = pa.array([str(i) for i in range(len(entries))])

    def spells(self, ids: np.ndarray, text: bytes) -> bool:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())) == text


class Tokenizers:
    """Both tokenizers with a store of the ids of stretches seen before."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.byte, self.piece = Tokenizer.from_file(byte_path), sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.byte.encode_special_tokens = True
        alphabet = byte_alphabet()
        with open(byte_path, encoding="utf-8") as f:
            special = {t["id"] for t in json.load(f)["added_tokens"]}
        entries = [b""] * self.byte.get_vocab_size(with_added_tokens=True)
        for token, i in self.byte.get_vocab(with_added_tokens=True).items():
            entries[i] = token.encode() if i in special else bytes(alphabet[c] for c in token)
        self.a = Vocabulary(entries)
        pieces = []
        for i in range(self.piece.get_piece_size()):
            piece = self.piece.id_to_piece(i)
            pieces.append(bytes([int(piece[3:5], 16)]) if self.piece.is_byte(i) else piece.replace("▁", " ").encode())
        self.b = Vocabulary(pieces)
        self.known: dict[str, tuple[np.ndarray, np.ndarray, bool]] = {}

    def _encode(self, text: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """Ids of a blank and the text, and whether both tokenizers spell it."""
        a = np.array(self.byte.encode(" " + text, add_special_tokens=False).ids, np.int32)
        b, whole = np.array(self.piece.encode(text), np.int32), b" " + text.encode()
        return a, b, self.a.spells(a, whole) and self.b.spells(b, whole)

    def _together(self, stretches: list[str]) -> list[tuple[np.ndarray, np.ndarray, bool]]:
        """The same for stretches that may stand one after the other, by one call."""
        a, b, good = self._encode(" ".join(stretches))
        if not good:
            return [self._encode(s) for s in stretches]
        ends = np.cumsum([len(s.encode()) + 1 for s in stretches])[:-1]
        parts = [np.split(ids, np.searchsorted(np.cumsum(v.lengths[ids]), ends) + 1) for ids, v in ((a, self.a), (b, self.b))]
        return [(x, y, True) for x, y in zip(*parts, strict=True)]

    def lists(self, stretches: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids of A and B of each stretch (without its blank), and whether both spell it."""
        new = [s for s in stretches if s not in self.known]
        if len(self.known) + len(new) > CACHED:
            self.known.clear()
            new = stretches
        plain = [s for s in new if len(s) <= LONGEST and _WORD.match(s[0]) and _WORD.match(s[-1])]
        found = {}
        for low in range(0, len(plain), 500):
            part = plain[low : low + 500]
            found.update(zip(part, self._together(part), strict=True))
        found.update((s, self._encode(s)) for s in new if s not in found)
        self.known.update((s, v) for s, v in found.items() if len(s) <= LONGEST)
        rows = [found.get(s) or self.known[s] for s in stretches]
        a, b, good = zip(*rows, strict=True) if rows else ((), (), ())
        return list(a), list(b), np.array(good, bool)


def _sizes_to_offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())


def _list_array(values: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(values) if values else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(_sizes_to_offsets([len(v) for v in values]), pa.array(flat, pa.int32()))


class _Side:
    """The tokens of the stretches by one tokenizer: ids, stretch, and end within the stretch."""

    def __init__(self, vocabulary: Vocabulary, lists: pa.ListArray) -> None:
        self.vocabulary, self.ids, self.parent = vocabulary, pc.list_flatten(lists), pc.list_parent_indices(lists)
        self.count = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        total = pc.cumulative_sum(pa.array(vocabulary.lengths).take(self.ids))
        before = np.concatenate([[0], np.asarray(total)])[np.cumsum(self.count) - self.count]
        self.end = pc.subtract(total, pa.array(before, pa.int64()).take(self.parent))

    def table(self, place: str) -> pa.Table:
        return pa.table({"parent": self.parent, "end": self.end, place: pa.array(np.arange(len(self.ids)))})

    def group(self, ends: np.ndarray) -> np.ndarray:
        """The group of every token, groups being counted through all stretches."""
        flag = np.zeros(len(self.ids), np.int64)
        flag[ends] = 1
        self.groups = np.cumsum(flag) - flag
        return self.groups

    def counted(self, name: str) -> pa.Table:
        found = pa.table({"group": pa.array(self.groups), name: self.ids}).group_by(["group", name], use_threads=False).aggregate([([], "count_all")])
        return found.rename_columns({"count_all": f"m_{name}"})

    def spelled(self, n: int) -> pa.Array:
        offsets = _sizes_to_offsets(np.bincount(self.groups, minlength=n))
        return pc.binary_join(pa.ListArray.from_arrays(offsets, self.vocabulary.names.take(self.ids)), ",")


def aligned(tokenizers: Tokenizers, texts: list[str | None]) -> tuple[dict[str, np.ndarray], list[str], pa.Table, np.ndarray]:
    """Of each text the counts and the digest of its groups; a table (doc, pair, m) of its linked pairs; and the
    distinct pairs of all texts, as A id times 2^32 plus B id."""
    n = len(texts)
    parts = pa.array([_CUT.split(t) if t else [] for t in texts], pa.list_(pa.string()))
    doc, flat = pc.list_parent_indices(parts), pc.list_flatten(parts).dictionary_encode()
    lists_a, lists_b, good = tokenizers.lists(flat.dictionary.to_pylist())
    # A stretch that is misspelled has no common last end, so its tokens must not run into the next group.
    lists_a, lists_b = ([ids if fine else ids[:0] for ids, fine in zip(lists, good.tolist(), strict=True)] for lists in (lists_a, lists_b))
    a, b = _Side(tokenizers.a, _list_array(lists_a)), _Side(tokenizers.b, _list_array(lists_b))
    ends = a.table("at_a").join(b.table("at_b"), ["parent", "end"], join_type="inner", use_threads=False)
    at = np.sort(ends["at_a"].to_numpy())
    groups, group_parent = len(at), np.asarray(a.parent)[at]
    links = np.bincount(a.group(at), minlength=groups)[:groups] * np.bincount(b.group(ends["at_b"].to_numpy()), minlength=groups)[:groups]
    joined = a.counted("a").join(b.counted("b"), "group", join_type="inner", use_threads=False)
    m = pc.multiply(joined["m_a"], joined["m_b"]).to_numpy()
    distinct, pair = np.unique((joined["a"].to_numpy().astype(np.int64) << 32) | joined["b"].to_numpy(), return_inverse=True)
    parent = group_parent[joined["group"].to_numpy()] if groups else np.zeros(0, np.int64)
    order = np.argsort(parent, kind="stable")
    size = len(lists_a)
    per_stretch = _sizes_to_offsets(np.bincount(parent, minlength=size))
    pairs, times = (pa.ListArray.from_arrays(per_stretch, pa.array(x[order].astype(np.int64))) for x in (pair, m))

    shown = pc.binary_join_element_wise(a.spelled(groups), b.spelled(groups), "|")
    n_groups = np.bincount(group_parent, minlength=size)
    lines = pc.binary_join(pa.ListArray.from_arrays(_sizes_to_offsets(n_groups), shown), ";")
    n_links = np.zeros(size, np.int64)
    np.add.at(n_links, group_parent, links)

    # From the stretches to the documents, without those that either tokenizer misspells.
    bad = np.zeros(n, bool)
    bad[np.asarray(doc)[~good[np.asarray(flat.indices)]]] = True
    keep = pa.array(~bad[np.asarray(doc)])
    doc, stretch = doc.filter(keep), flat.indices.filter(keep)
    owner, chosen = np.asarray(doc), np.asarray(stretch)

    def total(each: np.ndarray) -> np.ndarray:
        return np.bincount(owner, each[chosen], minlength=n).astype(np.int64)

    counts = {"n_a": total(a.count), "n_b": total(b.count), "n_groups": total(n_groups), "n_links": total(n_links)}
    stretches = np.bincount(owner, minlength=n)
    whole = pc.binary_join(pa.ListArray.from_arrays(_sizes_to_offsets(stretches), lines.take(stretch)), ";")
    digests = [hashlib.sha256(line.as_buffer()).hexdigest() if some else "" for line, some in zip(whole, stretches.tolist(), strict=True)]
    taken = pairs.take(stretch)
    held = pa.table({"doc": doc.take(pc.list_parent_indices(taken)), "pair": pc.list_flatten(taken), "m": pc.list_flatten(times.take(stretch))})
    held = held.group_by(["doc", "pair"], use_threads=False).aggregate([("m", "sum")]).rename_columns({"m_sum": "m"})
    return counts, digests, held, distinct


def _packed(pair: np.ndarray, m: np.ndarray) -> bytes:
    """Places in the block's list of pairs, as differences, and multiplicities, compressed."""
    order = np.argsort(pair)
    raw = np.concatenate([np.diff(pair[order], prepend=0), m[order]]).astype("<u4").tobytes()
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.decompress(data[4:], int.from_bytes(data[:4], "little"), codec="zstd", asbytes=True)
    step, m = np.frombuffer(raw, "<u4").astype(np.int64).reshape(2, -1)
    return np.cumsum(step), m


def _blocks(batches: Iterator[pa.RecordBatch], byte_path: str, piece_path: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(id, text) to a row for each text and, without an id, one for each block: its distinct pairs with the number
    of its documents that hold them."""
    tokenizers, block = Tokenizers(byte_path, piece_path), TaskContext.get().partitionId() << 32
    for batch in batches:
        for low, high, _, _ in slices(batch.column(1), BLOCK_BYTES):
            counts, digests, pairs, listed = aligned(tokenizers, batch.column(1).slice(low, high - low).to_pylist())
            doc, pair, m = (pairs[c].to_numpy() for c in ("doc", "pair", "m"))
            # The block's list of pairs: those of documents that are spelled, with the number of documents.
            tally = pairs.group_by("pair", use_threads=False).aggregate([([], "count_all")]).sort_by("pair")
            distinct, held = listed[tally["pair"].to_numpy()], tally["count_all"].to_numpy()
            place = np.searchsorted(tally["pair"].to_numpy(), pair)
            order = np.argsort(doc, kind="stable")
            borders = np.searchsorted(doc[order], np.arange(high - low + 1))
            packed = [_packed(place[o], m[o]) if len(o) else None for o in (order[s:e] for s, e in zip(borders, borders[1:], strict=False))]
            n = high - low + 1
            none = pa.nulls(1, schema.field("id").type)
            columns = [
                pa.array([block] * n, pa.int64()),
                pa.array([False] * (n - 1) + [True]),
                pa.concat_arrays([batch.column(0).slice(low, n - 1), none]),
                *(pa.array(np.append(counts[c], 0), pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")),
                pa.array([*digests, None], pa.string()),
                pa.array([*packed, None], pa.binary()),
                *(pa.array([None] * (n - 1) + [x], pa.list_(pa.int32())) for x in ((distinct >> 32).astype(np.int32), (distinct & 0xFFFFFFFF).astype(np.int32), held.astype(np.int32))),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
            block += 1


def _looked_up(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """The texts of a block with the counts of its pairs: (place, count, best)."""
    count, best = np.zeros(counts.num_rows, np.int64), np.zeros(counts.num_rows, np.int64)
    place = counts["place"].to_numpy()
    count[place], best[place] = counts["count"].to_numpy(), counts["best"].to_numpy()
    sums, bests = [], []
    for held in docs["pairs"].to_pylist():
        at, m = _unpacked(held) if held else (np.zeros(0, np.int64),) * 2
        sums.append(int((count[at] * m).sum()))
        bests.append(int((best[at] * m).sum()))
    own = docs.select(["id", "n_a", "n_b", "n_groups", "n_links"])
    own = own.append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))
    return own.append_column("groups_sha256", docs["groups_sha256"])


def token_alignment(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id column, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    ship(docs)
    field = docs.select(F.col(id_col).alias("id")).schema[0]
    numbers = "n_a long, n_b long, n_groups long, n_links long"
    schema = f"block long, listing boolean, id {field.dataType.simpleString()}, {numbers}, groups_sha256 string, pairs binary, a array<int>, b array<int>, docs array<int>"
    names = [f.name for f in T._parse_datatype_string(schema)]
    kinds = [pa.int64(), pa.bool_(), None, *[pa.int64()] * 4, pa.string(), pa.binary(), *[pa.list_(pa.int32())] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.schema([(n, k or batch.schema[0].type) for n, k in zip(names, kinds, strict=True)])
            yield from _blocks(_chain(batch, batches), byte_path, piece_path, own)

    stored = checkpointed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema))
    listed = stored.where("listing").select("block", F.posexplode(F.arrays_zip("a", "b", "docs")).alias("place", "p"))
    listed = listed.select("block", "place", "p.a", "p.b", "p.docs")
    counts = listed.groupBy("a", "b").agg(F.sum("docs").alias("count"))
    best = (F.col("count") == F.max("count").over(Window.partitionBy("a"))).cast("long")
    counts = checkpointed(counts.withColumn("best", best))
    back = listed.select("block", "place", "a", "b").join(counts, ["a", "b"]).select(F.col("block").alias("of"), "place", "count", "best")
    texts = stored.where(~F.col("listing")).drop("listing", "a", "b", "docs")
    found = texts.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(
        lambda left, right: _looked_up(left, right), f"id {field.dataType.simpleString()}, {numbers}, n_best long, count_sum long, groups_sha256 string"
    )
    return found.withColumnRenamed("id", id_col)


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest
