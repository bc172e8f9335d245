"""Exact dedup by two passes of a Bloom filter: only rows whose hash may repeat are shuffled.

Pass 1 counts, up to two, how many rows fall on each of two slots per hash. A row can have an equal elsewhere only
if both its slots were hit twice. Pass 2 sends those rows through a shuffle on the full digest and lets all others
straight through. The filter's size follows the row count: beyond MAX_SLOTS it is made in slices of the hash, each over
its own rows, so that a worker never holds more than one slice and the filter stays as sparse at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, mixed, stored, table

#: Slots of the filter: one bit each once it is built, so at most 32 MB are sent to a worker.
MIN_SLOTS, MAX_SLOTS, SLOTS_PER_ROW, SEGMENT = 1 << 18, 1 << 28, 16, 1 << 16
#: A digest with over 1/HOT_SHARE of the shuffled rows is joined by broadcast; there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000


def _slots(h: np.ndarray, n_slots: int) -> list[np.ndarray]:
    mask = np.uint64(n_slots - 1)
    return [(mixed(h.view(np.uint64) + np.uint64(k)) & mask).astype(np.int64) for k in (1, 2)]


def _hits(n_slots: int):
    """Per task: for each segment the slots hit once and those hit twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = twice = np.empty(0, np.int64)
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False)
            pos, n = np.unique(np.concatenate(_slots(h, n_slots)), return_counts=True)
            seen = np.union1d(once, twice)
            twice = np.union1d(np.union1d(twice, pos[n > 1]), np.intersect1d(pos, seen))
            once = np.setdiff1d(np.union1d(seen, pos), twice)
        for level, pos in ((1, once), (2, twice)):
            seg, start = np.unique(pos // SEGMENT, return_index=True)
            parts = np.split((pos % SEGMENT).astype(np.uint16), start[1:]) if len(seg) else []
            if len(seg):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seg), pa.array([level] * len(seg), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())],
                    ["seg", "level", "slots"],
                )

    return run


def _merge(t: pa.Table) -> pa.Table:
    counts = np.zeros(SEGMENT, np.uint8)
    for level, slots in zip(t["level"].to_pylist(), t["slots"].to_pylist()):
        i = np.frombuffer(slots, np.uint16)
        counts[i] = np.minimum(counts[i] + level, 2)
    return pa.table({"seg": t["seg"][:1], "bits": pa.array([np.packbits(counts > 1).tobytes()], pa.binary())})


def repeated_filter(hashes: DataFrame, n_slots: int) -> bytes:
    """The bits of slots hit at least twice by the single long column of `hashes` (at most MAX_SLOTS / 8 bytes)."""
    parts = hashes.mapInArrow(_hits(n_slots), "seg long, level int, slots binary")
    merged = parts.groupBy("seg").applyInArrow(_merge, "seg long, bits binary")
    bits = np.zeros((n_slots // SEGMENT, SEGMENT // 8), np.uint8)
    for row in merged.collect():  # at most MAX_SLOTS / SEGMENT rows
        bits[row.seg] = np.frombuffer(row.bits, np.uint8)
    return bits.tobytes()


def _flag(bits, n_slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(bits.value, np.uint8)
        for b in batches:
            maybe = np.ones(b.num_rows, bool)
            for s in _slots(b.column(0).to_numpy(zero_copy_only=False), n_slots):
                maybe &= (held[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1 == 1
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(maybe)], ["doc_id", "digest", "maybe"])

    return run


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. Of equal texts the largest id stays; rows that repeat the staying id with the same
    text are the same document and are all marked kept. A group without any id keeps its rows (keep_id null). Other
    columns, whatever their names, are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(t).alias("h"), F.col(f"`{key}`").cast("long").alias("doc_id"), F.unhex(F.sha2(t.cast("binary"), 256)).alias("digest"))
    wanted, n_slots = SLOTS_PER_ROW * docs.count(), MIN_SLOTS
    slices = max(1, -(-wanted // MAX_SLOTS))
    while n_slots < min(MAX_SLOTS, wanted // slices):
        n_slots *= 2
    parts = [rows]
    if slices > 1:
        rows = stored(rows.withColumn("slice", F.pmod(F.xxhash64("h"), F.lit(slices)).cast("int")), by="slice")
        parts = [rows.filter(F.col("slice") == k).drop("slice") for k in range(slices)]
    flags = [part.mapInArrow(_flag(spark.sparkContext.broadcast(repeated_filter(part.select("h"), n_slots)), n_slots), "doc_id long, digest binary, maybe boolean") for part in parts]
    flagged = flags[0]
    for part in flags[1:]:
        flagged = flagged.unionByName(part)
    flagged = checkpointed(flagged)
    alone = flagged.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "digest")
    shared = flagged.filter("maybe").drop("maybe")
    groups = shared.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    total = shared.count()
    hot = groups.filter(F.col("group_size") * HOT_SHARE > F.lit(total)).filter("group_size > 1").collect()  # fewer than HOT_SHARE rows
    hot = F.broadcast(spark.createDataFrame(hot, groups.schema))
    cold = shared.join(hot.select("digest"), "digest", "left_anti")
    columns = ["doc_id", "keep_id", "group_size", "digest"]
    # few rows per digest are left, so grouping them again is even
    out = alone.unionByName(shared.join(hot, "digest").select(*columns)).unionByName(cold.join(groups, "digest").select(*columns))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
