"""The corpus pipeline: each stage reads what the one before kept, as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathmine.llm import decontaminate, mixing, sharding, simhash, toxicity
from pathmine.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: documents that the toxicity grammar rejects go. Null and empty texts stay; a text of any length is scored whole."""
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: of each group of fingerprints within 3 bits one document stays, that of the smallest id. Empty texts are one
    group; repeated rows and rows without an id are told apart by their text."""
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: documents that hold a benchmark item within its error budget go. Null and empty texts stay."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: domain shares flattened (power 0.7) by repeating scarce domains; every document stays at least once. Texts
    without words have the average domain."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"), size=None, least=1.0)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5: documents dealt to 16 shards by bytes. Null texts count one byte; repeated rows get places of their own."""
    return sharding.shard(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("mix_to_target_weights", mix_domains),
    ("sharding", deal_shards),
]

#: Learned weights, fingerprints and rates are not expressible in SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents`` in turn. Each writes its result as Parquet below the shared folder and the next
    reads that; extra columns pass through to the last stage; an empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
