"""How far the sources of a language differ in their words, over run-length columns.

A term's column entry in a group (language, source) is its smoothed probability p, an integer that depends on
the term's count in that group alone, so terms with equal counts everywhere have equal rows. The audit

1. counts terms per (language, source) in one pass over the texts, combined in the tasks;
2. keeps the terms that enough documents of the language hold, and writes each as its row of p over all sources;
3. reorders the vocabulary by that row, so equal entries stand together: equal rows become one row with a length,
   and a range partition of the ordered rows is a run of the vocabulary;
4. run-length encodes every source's column in each stretch, intersects the run boundaries of two columns, and
   adds f(p, q) times the length of each common run. f is symmetric, so a pair is computed once.

Sums over stretches are merged by Spark. Nothing is estimated: all numbers are integers.

A null text, language or source counts as the empty string. A text without terms still makes its group occur; a
language without kept terms gives pairs of value 0 and no term. Repeated rows count as often as they occur. An
empty table gives no row. Other columns are ignored. The result has one row per ordered pair of sources of a
language, so work and result grow with the square of the number of its sources (not of its rows).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from querywarden.llm.base import checkpointed, ship

#: The scale of probabilities, the documents that must hold a term, the ranks of the term report.
SCALE, LEAST_DOCS, TOP_TERMS = 1_000_000_000, 10, 10
#: Parts into which the terms of a language or source are dealt where a small table is joined to them.
PARTS = 64
#: Distinct terms that a task holds before it hands its counts on; text bytes beyond which words are streamed.
HELD_TERMS, LONG_TEXT = 400_000, 4_000_000

# Letters A-Z and every byte of a character beyond ASCII; bytes.lower changes A-Z alone.
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")


def _terms(text: str | None) -> Counter[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    return Counter(_TERM.findall(data) if len(data) < LONG_TEXT else (m.group() for m in _TERM.finditer(data)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to partial (lang, source, term, n, docs); a null term marks a group that occurs."""
    held: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            size = len(terms) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * size, pa.string()),
                    pa.array([source] * size, pa.string()),
                    pa.array([*(t.decode("utf-8", "replace") for t in terms), None], pa.string()),
                    pa.array([*(n[t] for t in terms), 0], pa.int64()),
                    pa.array([*(docs[t] for t in terms), 0], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = _terms(text)
            n, docs = held.setdefault((lang or "", source or ""), (Counter(), Counter()))
            n.update(found)
            docs.update(found.keys())
        if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
            yield from rows()
            held.clear()
    yield from rows()


def probability(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * size)), in integers of any size."""
    top = (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", top, (total + 2 * size).cast("decimal(20,0)")).cast("long") + 1


def term_divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _stretch(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """rows: distinct rows of p in vocabulary order, a column for each source; lengths: terms of each row.
    Returns the matrix of sums of f over all terms, filled above the diagonal."""
    n, width = rows.shape
    ends = np.concatenate([[0], np.cumsum(lengths)])
    borders = [np.concatenate([[0], np.flatnonzero(rows[1:, s] != rows[:-1, s]) + 1]) for s in range(width)]
    out = np.zeros((width, width), np.int64)
    for s in range(width):
        for t in range(s + 1, width):
            cuts = np.union1d(borders[s], borders[t])
            p, q = rows[cuts, s], rows[cuts, t]
            runs = ends[np.append(cuts[1:], n)] - ends[cuts]
            out[s, t] = ((p - q) ** 2 // (p + q) * runs).sum()
    return out


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, row, length) sorted by lang and row to partial (lang, a, b, value), a < b numbers of sources."""
    lang, total = None, np.zeros((0, 0), np.int64)

    def sums() -> pa.RecordBatch:
        a, b = np.triu_indices(len(total), 1)
        columns = [pa.array([lang] * len(a), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(total[a, b])]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "value"])

    for batch in batches:
        if not batch.num_rows:
            continue
        langs = batch.column(0).to_pylist()
        starts = [i for i in range(len(langs)) if i == 0 or langs[i] != langs[i - 1]]
        for low, high in zip(starts, [*starts[1:], len(langs)], strict=True):
            part = batch.slice(low, high - low)
            rows = np.asarray(part.column(1).flatten()).reshape(high - low, -1)
            if langs[low] != lang:
                if lang is not None:
                    yield sums()
                lang, total = langs[low], np.zeros((rows.shape[1],) * 2, np.int64)
            total += _stretch(rows, np.asarray(part.column(2)))
    if lang is not None:
        yield sums()


def _joined(terms: DataFrame, small: DataFrame, on: list[str], term: str) -> DataFrame:
    """Join a table of one row per language or source to the terms. Each of its rows is repeated for every part, so
    that the terms of a large language are never one task's, also where the join is not a broadcast and what
    follows would take over its partitioning."""
    part = F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")
    repeated = small.withColumn("dealt", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return terms.withColumn("dealt", part).join(repeated, [*on, "dealt"]).drop("dealt")


def source_audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank). Part `pair`: every other source of the language with the sum of f
    over all kept terms. Part `term`: the kept terms in which the source exceeds its language most."""
    ship(docs)
    counts = docs.select(lang_col, source_col, text_col).mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    per = checkpointed(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    listed = F.map_from_entries(F.collect_list(F.struct("source", "n")))
    kept = checkpointed(
        per.where(F.col("term").isNotNull())
        .groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), listed.alias("counts"))
        .where(F.col("docs") >= LEAST_DOCS)
        .drop("docs")
    )
    sums = kept.select("lang", F.explode("counts").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("size"), F.sum("n").alias("lang_total"))
    groups = checkpointed(
        per.where(F.col("term").isNull())
        .select("lang", "source")
        .join(sums, ["lang", "source"], "left")
        .join(sizes, "lang", "left")
        .fillna(0, ["total", "size", "lang_total"])
    )
    langs = checkpointed(groups.groupBy("lang", "size").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("sources")))

    # One row of p for each term, over all sources of its language in order; equal rows are one.
    entry = F.transform("sources", lambda s: probability(F.coalesce(F.try_element_at("counts", s["source"]), F.lit(0)), s["total"], F.col("size")))
    rows = _joined(kept, langs, ["lang"], "term").select("lang", entry.alias("row")).groupBy("lang", "row").agg(F.count("*").alias("length"))
    # Range borders come from a sample of the keys, so these are short: the first entries, then a hash.
    near = [F.col("row")[0], F.get("row", F.lit(1)), F.xxhash64("row")]
    ordered = rows.repartitionByRange("lang", *near).sortWithinPartitions("lang", "row")
    found = ordered.mapInArrow(_pair_sums, "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    numbered = langs.select("lang", F.posexplode("sources").alias("a", "s")).select("lang", "a", F.col("s.source").alias("source"))
    other = numbered.select("lang", F.col("a").alias("b"), F.col("source").alias("item"))
    pairs = numbered.join(other, "lang").where("a < b").join(found, ["lang", "a", "b"], "left").fillna(0, ["value"])
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = pairs.select("lang", both.alias("p"), "value").select("lang", "p.source", F.lit("pair").alias("part"), "p.item", "value")

    p, q = probability(F.col("n"), F.col("total"), F.col("size")), probability(F.col("lang_n"), F.col("lang_total"), F.col("size"))
    held = kept.select("lang", F.col("term").alias("item"), F.col("n").alias("lang_n"), F.explode("counts").alias("source", "n")).where("n > 0")
    terms = (
        _joined(held, groups, ["lang", "source"], "item")
        .select("lang", "source", F.lit("term").alias("part"), "item", p.alias("p"), q.alias("q"))
        .where("p > q")
        .select("lang", "source", "part", "item", term_divergence(F.col("p"), F.col("q")).alias("value"))
    )
    # A rank limit is applied in every task before the shuffle, so a source that holds most rows sends few.
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    top = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP_TERMS)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(top)
