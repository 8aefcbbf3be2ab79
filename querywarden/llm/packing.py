"""Hierarchical packing of tokenised documents into windows of several lengths.

Each task packs the documents of its own partition; nothing is shuffled, so no key can be hot and a lost
executor costs only its own partitions. In a task:

1. A document's ids are its tokens and the end id. Whole windows of the longest tier are cut off first.
2. The rest is routed to a tier: the shortest window that holds it.
3. Tiers are packed from the longest: the longest rest opens a window of its tier, and the gap is filled with
   the longest rests of shorter tiers that fit. If none fits, one is cut to close the gap and what
   remains of it is routed again. So every window is full.
4. What is left when the partition ends fills windows that are shorter powers of two, which need no padding.
5. Windows of a tier are dealt to step groups of equal token count in turns (there and back) by their
   attention cost, the sum of squared piece lengths.

A null text counts as empty: it has the end id alone. A null id and repeated rows are packed like any other row.
An empty table gives no row. Other columns are ignored. Memory is bounded by `pool_tokens`, the longest
text and the word cache. The result depends on how the input is partitioned; every result is a valid packing.
"""

from __future__ import annotations

import gc
import os
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querywarden.llm.base import ship

TIERS = (512, 1024, 2048, 4096)
END_ID = 2
#: Words whose ids a task remembers at most; then it starts afresh.
CACHED_WORDS = 1_800_000
#: Tokens of unpacked rests that a task holds before it packs.
POOL_TOKENS = 4_000_000
#: Tokens of a step group.
STEP_TOKENS = 32_768

FIELDS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")


class WordCache:
    """Ids of a text from the ids of its stretches between blanks and line ends. The tokenizer drops white
    space and no token reaches across it, so the ids of a text are those of its stretches in turn.

    A stretch is known by a number; the ids of all known stretches lie in one array, from which those of a
    text are gathered at once.

    A stretch of letters with final punctuation is two of the tokenizer's words. New runs of letters are
    encoded many at a time and told apart by the tokens that end a word. A character beyond ASCII counts as a
    letter only if the tokenizer takes it for one (not so a letter that becomes two characters in lower case)."""

    FINAL = ".,;:!?%$#*&)"
    #: Stretches whose ids are gathered at a time.
    BLOCK = 1 << 16

    def __init__(self, path: str, limit: int = CACHED_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.letters: set[str] = set()
        self.others: set[str] = set()
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.runs: dict[str, bytes] = {"": b""}
        self.pool, self.filled = np.zeros(1 << 16, "<u4"), 0
        self.border = np.zeros(1 << 16, np.int64)  # stretch i has pool[border[i] : border[i + 1]]

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _one_word(self, run: str) -> bool:
        """Whether the tokenizer takes a run beyond ASCII for letters alone: each character is tried once."""
        for c in set(run) - self.letters - self.others:
            alone = self.ends_word[self._encode(f"{c}{c}.")].sum() == 2
            (self.letters if c.isalpha() and alone else self.others).add(c)
        return self.others.isdisjoint(run)

    def _learn(self, words: list[str]) -> None:
        runs, new, cut = self.runs, {}, []
        for word in words:
            run = word if word.isalpha() else word.rstrip(self.FINAL)
            final = word[len(run) :]
            if run.isascii() and (run.isalpha() or not run):
                run = run.lower()
            elif run.isascii() or not self._one_word(run):
                if word not in runs:
                    runs[word] = self._encode(word).tobytes()
                cut += word, ""
                continue
            if final not in runs:
                runs[final] = self._encode(final).tobytes()
            if run not in runs:
                new[run] = None
            cut += run, final
        new = list(new)
        for low in range(0, len(new), 1000):
            block = new[low : low + 1000]
            ids = self._encode(" ".join(block))
            ends = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
            raw, at = ids.tobytes(), 0
            for run, end in zip(block, ends, strict=True):
                runs[run] = raw[4 * at : 4 * end]
                at = end
        parts = [runs[part] for part in cut]
        ids = np.frombuffer(b"".join(parts), "<u4")
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)).reshape(-1, 2).sum(axis=1) // 4
        first, total = len(self.known), self.filled + len(ids)
        self.pool = self._room(self.pool, total)
        self.border = self._room(self.border, first + len(words) + 1)
        self.pool[self.filled : total] = ids
        self.border[first + 1 : first + len(words) + 1] = self.filled + np.cumsum(sizes)
        self.filled = total
        self.known.update(zip(words, range(first, first + len(words)), strict=True))

    @staticmethod
    def _room(values: np.ndarray, n: int) -> np.ndarray:
        return values if n <= len(values) else np.concatenate([values, np.zeros(max(n, len(values) // 2), values.dtype)])

    def _gathered(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words in turn, and the number of ids of each."""
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            self._learn(list(dict.fromkeys(words[i] for i in missing)))
            at[missing] = [self.known[words[i]] for i in missing]
        first = self.border[at]
        sizes = self.border[at + 1] - first
        ends = np.cumsum(sizes)
        return self.pool[np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1])], sizes

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.known) + len(self.runs) > self.limit:
            self.forget()
        if not texts:
            return
        words = " ".join(texts).replace("\n", " ").split(" ")
        found = [self._gathered(words[low : low + self.BLOCK]) for low in range(0, len(words), self.BLOCK)]
        ids, sizes = (np.concatenate(part) for part in zip(*found, strict=True))
        stretches = np.cumsum([text.count(" ") + text.count("\n") + 1 for text in texts])
        ends = np.concatenate([[0], np.cumsum(sizes)[stretches - 1]]).tolist()
        for low, high in zip(ends, ends[1:], strict=False):
            yield ids[low:high].tobytes()


@cache
def word_cache(path: str) -> WordCache:
    """One for each Python process."""
    return WordCache(path)


class Rest(NamedTuple):
    """A stretch of a document that has no window yet."""

    doc: object
    start: int
    ids: bytes
    doc_tokens: int

    def cut(self, n: int) -> tuple[Rest, Rest]:
        return Rest(self.doc, self.start, self.ids[: 4 * n], self.doc_tokens), Rest(self.doc, self.start + n, self.ids[4 * n :], self.doc_tokens)


class Packer:
    """Packs the rests of one task. `windows` collects (tier, pieces); every piece is (doc, start, length,
    crc, doc_tokens)."""

    def __init__(self, tiers: tuple[int, ...], pool_tokens: int) -> None:
        self.tiers, self.longest, self.pool_tokens = tiers, tiers[-1], pool_tokens
        self.by_length: list[list[Rest]] = [[] for _ in range(self.longest)]
        self.filled = 0  # bit n is set if there is a rest of n tokens
        self.tokens = 0
        self.windows: list[tuple[int, list[tuple]]] = []

    def add(self, rest: Rest) -> None:
        n = len(rest.ids) // 4
        while n >= self.longest:
            head, rest = rest.cut(self.longest)
            self.windows.append((self.longest, [self._piece(head)]))
            n -= self.longest
        if n:
            self.by_length[n].append(rest)
            self.filled |= 1 << n
            self.tokens += n

    @staticmethod
    def _piece(rest: Rest) -> tuple:
        return rest.doc, rest.start, len(rest.ids) // 4, zlib.crc32(rest.ids), rest.doc_tokens

    def _take(self, n: int) -> Rest:
        rest = self.by_length[n].pop()
        if not self.by_length[n]:
            self.filled &= ~(1 << n)
        self.tokens -= n
        return rest

    def pack(self) -> None:
        """Fill windows until the rests do not fill another one."""
        while self.filled:
            first = self.filled.bit_length() - 1
            window = next(t for t in self.tiers if t >= first)
            if self.tokens < window:
                break
            held, gap = [self._take(first)], window - first
            while gap:
                fit = (self.filled & ((1 << (gap + 1)) - 1)).bit_length() - 1
                if fit > 0:
                    held.append(self._take(fit))
                    gap -= fit
                else:  # each rest is longer than the gap: cut the shortest
                    over = self.filled >> (gap + 1)
                    head, tail = self._take(gap + 1 + (over & -over).bit_length() - 1).cut(gap)
                    held.append(head)
                    self.add(tail)
                    gap = 0
            self.windows.append((window, [self._piece(r) for r in held]))

    def finish(self) -> None:
        """Windows that are powers of two, for what `pack` has left."""
        self.pack()
        while self.tokens:
            window = 1 << (min(self.tokens, self.longest).bit_length() - 1)
            held, gap = [], window
            while gap:
                rest = self._take(self.filled.bit_length() - 1)
                if len(rest.ids) > 4 * gap:
                    rest, tail = rest.cut(gap)
                    self.add(tail)
                held.append(rest)
                gap -= len(rest.ids) // 4
            self.windows.append((window, [self._piece(r) for r in held]))


def _stepped(windows: list[tuple[int, list[tuple]]], step_tokens: int, first_group: int) -> tuple[list[tuple[int, int, list[tuple]]], int]:
    """(tier, step group, pieces) for all windows, and the next free group."""
    out = []
    by_tier: dict[int, list[list[tuple]]] = {}
    for tier, pieces in windows:
        by_tier.setdefault(tier, []).append(pieces)
    for tier in sorted(by_tier):
        own = sorted(by_tier[tier], key=lambda pieces: -sum(p[2] ** 2 for p in pieces))
        groups = -(-len(own) // max(1, step_tokens // tier))
        for i, pieces in enumerate(own):
            turn, at = divmod(i, groups)
            out.append((tier, first_group + (groups - 1 - at if turn % 2 else at), pieces))
        first_group += groups
    return out, first_group


def _runs(texts: list[str], budget: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Cut a batch in runs of about `budget` characters."""
    low = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= budget:
            yield low, i + 1
            low, size = i + 1, 0
    if low < len(texts):
        yield low, len(texts)


def pack(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS,
    end_id: int = END_ID, pool_tokens: int = POOL_TOKENS, step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """One row per piece: the id column, start and length in the document's ids, ids_crc32, doc_tokens,
    sequence_id, offset in the sequence, tier (the sequence's length) and step_group. vocabulary: a path of
    a tokenizers file that every executor can read."""
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(tiers):
        raise ValueError("tiers must be ascending powers of two")
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(f, T.LongType()) for f in FIELDS]])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, packer = word_cache(vocabulary), Packer(tiers, pool_tokens)
        base = TaskContext.get().partitionId() << 40
        sequence = group = 0

        def rows(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            nonlocal sequence, group
            stepped, group = _stepped(packer.windows, step_tokens, group)
            packer.windows, out = [], []
            for tier, step, pieces in stepped:
                at = 0
                for doc, start, length, crc, doc_tokens in pieces:
                    out.append((doc, start, length, crc, doc_tokens, base + sequence, at, tier, base + step))
                    at += length
                sequence += 1
            if out:
                first, *rest = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(first, kind), *[pa.array(c, pa.int64()) for c in rest]], names=[id_col, *FIELDS])

        kind = None
        gc.disable()  # nothing here refers to itself, and passes over the cache's millions of entries are slow
        try:
            for batch in batches:
                kind = batch.schema.field(0).type
                docs_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
                for low, high in _runs(texts):
                    for doc, ids in zip(docs_ids[low:high], cache.ids(texts[low:high]), strict=True):
                        packer.add(Rest(doc, 0, ids + end, len(ids) // 4 + 1))
                    if packer.tokens > pool_tokens:
                        packer.pack()
                        yield from rows(kind)
            packer.finish()
            if packer.windows:
                yield from rows(kind)
        finally:  # the worker goes on to other tasks, also after an error or a LIMIT
            gc.enable()

    ship(docs)
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
