"""From raw documents to packed training windows: five stages, each on all that its predecessor kept.

    quality           documents that the newest quality policy rejects go
    near_duplicates   of each SimHash component the document with the smallest id stays
    decontamination   documents that hold a benchmark item go
    secrets           secrets are cut out of the texts; every document stays
    packing           the remaining documents as pieces of packed windows

All stages but the last return the columns of `documents`. The result has no SQL counterpart (fingerprints,
automata and tokenizer ids are not expressible), so the tests hold it against plain Python.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querywarden.llm import decontamination, packing, secrets, simhash
from querywarden.llm import quality as rules
from querywarden.llm.base import read_table, shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.apply_policy(docs, "v2")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secrets.redacted(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_items),
    ("secrets", secret_scan),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's documents are written to the shared folder and read again by the next one. The files stay
    there until their owner deletes the folder pipeline-<id>: the result reads the last of them."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs = read_table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{number}-{name}")
            docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
