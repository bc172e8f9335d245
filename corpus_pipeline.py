"""From raw documents to shards of a training mix.

Good documents, one of each near-duplicate group, without benchmark items, mixed to source targets (a document that the
mix takes twice is there twice), each with its shard. Stages keep all columns of documents, whatever their names, and
give no rows for an empty table; without labels, or without a benchmark, the stages that need them keep all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabq.llm import decontamination, jaccard_join, mixing, quality, sharding
from tabq.llm.common import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as good; null texts count as empty, equal texts go or stay alike, rows without an id too."""
    return quality.quality_filter(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity of 0.8 or more): that of the smallest id.

    Of rows that repeat an id and text one stays, and of rows without an id that repeat a text; texts without words stay.
    """
    return jaccard_join.one_of_each(docs, rule=jaccard_join.Rule(n=5, num=80, den=100))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; decided by each row's text, and null texts stay."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (0 to 3 times), by output shard in shuffled order; the null source is one of its own."""
    return mixing.mixed_rows(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard (a column `shard` is replaced); rows without an id share one."""
    return sharding.sharded_rows(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

# The quality model and the hash functions are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
