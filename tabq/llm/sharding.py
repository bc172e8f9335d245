"""Sharding by rendezvous hashing: a record goes to the shard whose weighted draw for its key is highest.

The draw depends on the key and that shard alone, so one more shard takes rows only into itself and each shard's
share follows its weight. Expressions only; the one shuffle moves a few numbers a row to give gapless slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SHARDS = 40
#: Rows of a shard are numbered in cells of about so many, so that no task orders a whole shard.
CELL_ROWS = 50_000


def _draw(key: Column, shard: Column, weights: list[float]) -> Column:
    u = (F.pmod(F.xxhash64(key, shard.cast("int")), F.lit(1 << 53)) + F.lit(0.5)) / F.lit(float(1 << 53))
    if len(set(weights)) == 1:
        return u
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), shard.cast("int") + 1)
    return -w / F.log(u) if weights else u


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Shard number of a string key; the later shard wins a tie of draws."""
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), lambda j: F.struct(_draw(key, j, weights).alias("d"), j.cast("int").alias("j"))))
    return best["j"]


def shard(docs: DataFrame, n_shards: int = SHARDS, key: str = "doc_id", text: str = "text", weights: list[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row.

    Null texts have size 16 and the checksum of the empty text. Rows with equal ids, and all rows without an id, share
    a shard; equal rows take neighbouring slots in any order. `weights` (one per shard) set the shares; the grown
    shard count adds one shard of mean weight. Other columns are not read; an empty table gives no rows.
    """
    weights = weights or [1.0] * n_shards
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    k = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    grown = [*weights, sum(weights) / len(weights)]
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), (F.octet_length(t) + 16).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), rendezvous(k, weights).alias("shard"), rendezvous(k, grown).alias("grown_shard"))
    cells = max(4, docs.count() // (n_shards * CELL_ROWS) + 1)
    rows = rows.withColumn("_hash", F.xxhash64(F.col("doc_id").cast("string"), "text_crc32", F.lit("slot"))).withColumn("_cell", F.pmod(F.col("_hash"), F.lit(cells)).cast("int"))
    counts = rows.groupBy("shard", "_cell").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    order = Window.partitionBy("shard", "_cell").orderBy("_hash", "doc_id", "text_crc32", "size")
    numbered = rows.withColumn("_at", F.row_number().over(order) - 1)
    return numbered.join(before, ["shard", "_cell"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_before") + F.col("_at")).cast("long").alias("slot"), "grown_shard")


def sharded_rows(docs: DataFrame, n_shards: int = SHARDS, key: str = "doc_id", weights: list[float] | None = None, column: str = "shard") -> DataFrame:
    """The rows of `docs`, all columns, with their shard in `column` (which replaces one of that name); no shuffle.

    Rows with equal ids, and all rows without an id, share a shard; texts are not read. An empty table gives no rows.
    """
    k = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    return docs.withColumn(column, rendezvous(k, weights or [1.0] * n_shards))


def op10_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
