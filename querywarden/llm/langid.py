"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: runs of letters in lower case with one blank between them, n-grams of one to three characters,
hashed to `BUCKETS`; log(1 + count) times the inverse document frequency, scaled to length one, and a
constant. Document frequencies come from all training documents. The weights are fitted by
follow-the-regularised-leader (FTRL-proximal) with elastic-net penalties on a sample of at most
`sample_rows` training documents, the same number of each language (all of those of a language that has
fewer), drawn by a hash of their id, so a rare language is learned at any size of the table; a seventh of the
sample is kept out of the fit and sets the temperature that calibrates the probabilities. If there are more
than `sample_rows` languages, the most frequent ones are learned.

A text that is null or has no letter gets `und` and score 0; so does every text if there is no training
document. Rows without a label are predicted and not learned from. Repeated rows count each. An empty
table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querywarden.llm.base import arrow_column, ship
from querywarden.llm.hashing import mix

BUCKETS = 1 << 14
SAMPLE_ROWS = 6000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.001, 3
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams of a whole text; None without a letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of other characters stays, as a blank
    chars = np.concatenate([[32], np.where(letter, points, 32)[keep], [32]]).astype(np.uint64)
    total = np.zeros(BUCKETS, np.int64)
    key = np.zeros(len(chars), np.uint64)
    for n in (1, 2, 3):
        key = key[: len(chars) - n + 1] * np.uint64(0x1000193) + chars[n - 1 :] + np.uint64(n)
        total += np.bincount((mix(key) >> np.uint64(50)).astype(np.int64), minlength=BUCKETS)
    return total


class Model(NamedTuple):
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets and the constant, by language
    temperature: float

    def features(self, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(total)
        value = np.log1p(total[at]) * self.idf[at]
        value /= np.sqrt(value @ value) or 1.0
        return np.append(at, BUCKETS), np.append(value, 1.0)

    def predict(self, text: str | None) -> tuple[str, float]:
        total = counts(text)
        if total is None or not self.languages:
            return UNKNOWN, 0.0
        at, value = self.features(total)
        p = softmax(value @ self.weights[at] / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max())
    return e / e.sum()


def fit(rows: list[tuple[str, str]], idf: np.ndarray) -> Model:
    """rows: (text, language), in the order in which they are learned."""
    blank = Model(sorted({lang for _, lang in rows}), idf, np.zeros((BUCKETS + 1, 1)), 1.0)
    data = [(blank.features(c), blank.languages.index(lang)) for text, lang in rows if (c := counts(text)) is not None]
    k = len(blank.languages)
    held, learned = data[::7], [d for i, d in enumerate(data) if i % 7]
    z, n, weights = (np.zeros((BUCKETS + 1, k)) for _ in range(3))
    for _ in range(EPOCHS):
        for (at, value), lang in learned:
            w, zs, ns = weights[at], z[at], n[at]
            error = softmax(value @ w)
            error[lang] -= 1
            g = value[:, None] * error
            grown = ns + g * g
            zs += g - (np.sqrt(grown) - np.sqrt(ns)) / ALPHA * w
            n[at], z[at] = grown, zs
            weights[at] = np.where(np.abs(zs) <= L1, 0.0, (np.sign(zs) * L1 - zs) / ((BETA + np.sqrt(grown)) / ALPHA + L2))
    if not held or not learned:
        return blank._replace(weights=weights)
    scores, truth = np.array([value @ weights[at] for (at, value), _ in held]), np.array([lang for _, lang in held])

    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), truth]))

    return blank._replace(weights=weights, temperature=min(np.geomspace(0.05, 20, 200), key=loss))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def drawn(known: DataFrame, sample_rows: int) -> DataFrame:
    """known: id, text, lang (not null). At most sample_rows rows (text, lang), the same quota of each language,
    those with the smallest hashes of the id, in the order of the hash."""
    sized = known.groupBy("lang").agg(F.count("*").alias("held")).orderBy(F.desc("held"), "lang").limit(sample_rows).collect()
    quota = sample_rows // max(1, len(sized))
    # Only a little more than the quota of a language is gathered, however many rows and tasks there are.
    wanted = quota + 6 * math.sqrt(quota) + 20
    cuts = [(r.lang, min(1 << 31, math.ceil(wanted / r.held * (1 << 31)))) for r in sized]
    allowed = F.broadcast(known.sparkSession.createDataFrame(cuts, "lang string, cut long"))  # sample_rows rows at most
    near = known.withColumn("place", F.xxhash64("id")).join(allowed, "lang").where(F.pmod("place", F.lit(1 << 31)) < F.col("cut"))
    order = ["place", "id", F.xxhash64("text")]
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= quota)
    return ranked.orderBy("place", "id", "lang", F.xxhash64("text")).limit(sample_rows).select("text", "lang")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """docs: the training documents; rows without a language are left out."""
    ship(docs)
    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                total = counts(text.as_py())
                if total is not None:
                    seen += total > 0
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, BUCKETS), pa.int64()), pa.array(np.append(n, seen))], names=["bucket", "docs"])

    found = known.select("text").mapInArrow(frequencies, "bucket long, docs long").groupBy("bucket").agg(F.sum("docs").alias("docs"))
    seen = {r.bucket: r.docs for r in found.collect()}  # BUCKETS + 1 rows at most
    idf = np.log((1 + seen.get(-1, 0)) / (1 + np.array([seen.get(b, 0) for b in range(BUCKETS)]))) + 1
    sample = drawn(known, sample_rows)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit([(r["text"], r["lang"]) for batch in batches for r in batch.to_pylist()], idf)
        yield pa.RecordBatch.from_arrays([pa.array([model.languages]), pa.array([model.weights.astype(np.float32).tobytes()]), pa.array([model.temperature])], names=["languages", "weights", "temperature"])

    models = [r for r in sample.coalesce(1).mapInArrow(learn, "languages array<string>, weights binary, temperature double").collect() if r.languages]
    if not models:
        return Model([], idf, np.zeros((BUCKETS + 1, 1)), 1.0)
    (row,) = models
    return Model(row.languages, idf, np.frombuffer(bytes(row.weights), np.float32).reshape(BUCKETS + 1, -1), row.temperature)


PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def identify(docs: DataFrame, model: Model, text_col: str = "text", name: str = "language") -> DataFrame:
    """Add a struct column (lang_pred, score); a column of that name is replaced."""
    shared = ship(docs).sparkSession.sparkContext.broadcast(model)

    def predicted(texts: pa.Array) -> pa.Array:
        rows = [shared.value.predict(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], names=PREDICTION.names)

    return docs.withColumn(name, arrow_column(predicted, PREDICTION)(F.col(text_col)))
