"""From raw documents to packed training sequences, in five stages.

Each stage takes all that its predecessor kept; between stages the rows are written as Parquet to the shared
folder and read again. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylight.llm import decontaminate, jaccard, packing, phrases, quality
from quaylight.llm.queries import tokenizer
from quaylight.llm.shared import stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    A doc_id is rejected if one of its rows is; rows without a doc_id cannot be named, so they stay.
    """
    found = quality.rate_quality(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))
    rejected = found.where("not kept").select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti").select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies; of rows with equal doc_id and text one stays.

    Near copies share shingles of five words with a similarity of 0.8 or more.
    """
    found = jaccard.jaccard_groups(docs, percent=80, shingle=5)
    copies = found.where("component_id <> doc_id").select("doc_id").distinct()
    left = docs.join(copies, "doc_id", "left_anti").withColumn("__text", F.xxhash64("text"))
    return left.dropDuplicates(["doc_id", "__text"]).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a smaller doc_id has too are cut; a document of which nothing is left goes."""
    return phrases.without_repeats(docs, min_words=1)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut; a document that is mostly such a passage goes."""
    return decontaminate.strip_benchmark(docs, table(spark, sf_dir, "benchmark"))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: its sequence and its place there."""
    placed = packing.packed_documents(docs, tokenizer())
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("ngram_jaccard", keep_one_of_each),
    ("substring_dedup", cut_repeats),
    ("decontaminate", cut_benchmark),
    ("pack", pack_tokens),
]

#: The classifier, the tokenizer and the passage search are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
