"""The corpus pipeline: documents in, sharded training texts out.

Each stage reads what the one before it kept, written as Parquet and read again.

All stages take nulls in any column, empty and very long texts, repeated rows, an empty table,
and further columns of any names; all but the last return the columns of ``docs``. A null text
counts as an empty one, a null doc_id is an id of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ticketloom.llm import decontamination, mixing, quality, sharding, simhash
from ticketloom.llm.common import read
from ticketloom.session import scratch_dir, scratch_scope


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; empty texts are scored like any other."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays: the least doc_id, null last. All texts
    without words are one group, and so are repeated rows."""
    return simhash.simhash_dedup(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; a null or empty text holds none."""
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their targets: a row per document and pass that takes words of it. A
    text without words has none to take; a null source is a source like any other."""
    return mixing.mixed_documents(docs)


def shard_corpus(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets a shard and a slot by a uniform shuffle, repeated rows one each."""
    return sharding.shard_rows(docs)


STAGES = [
    ("quality classifier", filter_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources", mix_sources),
    ("sharding", shard_corpus),
]

#: The stages fit models and deal by pseudorandom permutations, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what a stage has stored for itself goes once it is written.

    No documents give no rows."""
    docs = read(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        path = scratch_dir(spark, f"stage-{n}")
        with scratch_scope(spark, f"work-{n}"):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
