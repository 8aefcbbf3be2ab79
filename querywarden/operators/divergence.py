"""How far a query's words are from those of a clean corpus.

The corpus becomes a table of token counts.  A query's tokens are joined to it by token, and its divergence is
that of its own token distribution P from the smoothed one of the corpus Q, in bits:

    sum over its tokens of P(t) * log2(P(t) / Q(t)),  Q(t) = (count + 1) / (all counts + distinct tokens + 1)

A token that the corpus lacks has count 0.  Tokens that almost every query holds are keys with very many rows; the
join deals them over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import spread_join

TOKEN = "[a-z0-9_]+"
#: Characters of text whose tokens are one task's, about.
TASK_CHARS = 8 << 20


def _tokens(text_col: str):
    return F.expr(f"regexp_extract_all(lower(coalesce(`{text_col}`, '')), '{TOKEN}', 0)")


def token_model(clean: DataFrame, text_col: str = "sql") -> DataFrame:
    """(token, count): how often each token occurs in the corpus.  Days or parts are merged by adding counts."""
    return clean.select(F.explode(_tokens(text_col)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("count"))


def merge_models(*models: DataFrame) -> DataFrame:
    """One model from several."""
    first, *rest = models
    for m in rest:
        first = first.unionByName(m)
    return first.groupBy("token").agg(F.sum("count").alias("count"))


def _parts(df: DataFrame, text_col: str) -> int:
    """Tasks for the tokens of all texts: more with more text, so that a task's memory does not grow."""
    chars = df.agg(F.sum(F.length(text_col)).alias("n")).first().n or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // TASK_CHARS))


def corpus_divergence(df: DataFrame, model: DataFrame, keys: Sequence[str], text_col: str = "sql", spread: bool | None = None) -> DataFrame:
    """The keys of each text (unique, any type that can be grouped) with ``divergence`` and ``unknown``, the share of
    its tokens that the corpus lacks.  Both are NULL for a text without tokens."""
    keys = list(keys)
    parts = _parts(df, text_col)
    # Texts are dealt by key before they are taken apart: a task counts the tokens of its own texts, which are few.
    dealt = df.select(*keys, F.col(text_col).alias("_text")).repartition(parts, *keys)
    held = dealt.select(*keys, F.explode_outer(_tokens("_text")).alias("token")).groupBy(*keys, "token").agg(F.count("token").alias("_n"))
    held = held.withColumn("token", F.coalesce("token", F.lit("")))
    found = spread_join(held, model.withColumnRenamed("count", "_seen"), ["token"], spread=spread, parts=parts)
    known = model.agg((F.sum("count") + F.count(F.lit(1)) + 1).alias("size")).scalar()
    n, seen = F.col("_n"), F.coalesce("_seen", F.lit(0))
    # With N tokens in the text: sum n/N log2(n/N / q) = (sum n log2(n / q)) / N - log2(N).
    per = found.groupBy(*keys).agg(
        F.sum("_n").alias("_all"),
        F.sum(F.when(n > 0, n * F.log2(n / (seen + 1)))).alias("_bits"),
        F.sum(F.when(seen == 0, n).otherwise(0)).alias("_new"),
    )
    some = F.col("_all") > 0
    size = F.log2(F.coalesce(known, F.lit(1)).cast("double"))
    return per.select(
        *keys,
        F.when(some, F.col("_bits") / F.col("_all") - F.log2(F.col("_all").cast("double")) + size).alias("divergence"),
        F.when(some, F.col("_new") / F.col("_all")).alias("unknown"),
    )
