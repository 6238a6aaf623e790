"""A corpus pipeline: language, near duplicates, benchmark leaks, mixture, shards.

Every stage takes what its predecessor kept; all but the last return the columns of documents. In every stage an empty table
gives an empty table, a text of any length is handled whole, and columns other than those of documents are carried along.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontamination, jaccard_join, langid, mixing, sharding
from millrace.session import shared_dir

SHARDS = 24


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts in no learned language.

    Null, empty and blank texts go; a null language teaches nothing; rows without an id and repeated rows are each judged.
    """
    return langid.accepted(docs, langid.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group linked by sets of five-word shingles with a similarity of 0.8 or more.

    A row without an id comes last; rows equal in id and text are one document; texts without words are linked with nothing.
    """
    return jaccard_join.deduplicate(docs, words=5, percent=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a twentieth of their words or more in windows of benchmark items, and cuts the windows from all others.

    Null texts have no words and stay; repeated rows and rows without an id are each judged; without a benchmark all stay.
    """
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "both", size_col="n_chars")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents, whole or in part, until their sources reach their targets.

    A null source is a source of its own; documents without words take none, and come with the whole repetitions; equal rows
    share one place in the order.
    """
    return mixing.repeated(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives every row its virtual slot and shard.

    A row without an id goes by its text; equal rows share a slot.
    """
    return sharding.assigned(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("mixture", mixture),
    ("shards", shards),
]

#: Hypervectors and component search have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
