"""Bounded, labelled training rows; everything else in the operators that learn covers all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_ids(labels: DataFrame, label: str, train: Column) -> DataFrame:
    """(doc_id, y) of the training labels; ids labelled twice count once (the largest label holds), null labels do not count."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).filter(train)
    return y.groupBy("doc_id").agg(F.max("y").alias("y"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int, seed: str) -> tuple[DataFrame, float]:
    """(doc_id, text, y) of at most `per_class` training documents of each class, and the training share of class 1.

    `train` is a condition on doc_id. The rows with the smallest seeded hash of the id are taken, so the sample does
    not depend on the partitioning. Ids labelled twice count once (the largest label holds); null labels do not count.
    """
    spark = docs.sparkSession
    y = labelled_ids(labels, label, train)
    counts = {r.y: r.n for r in y.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id", F.lit(seed))
    chosen = [r for k in (0, 1) for r in y.filter(F.col("y") == k).orderBy(order, "doc_id").limit(per_class).collect()]
    ids = F.broadcast(spark.createDataFrame([(r.doc_id, r.y) for r in chosen], "_id long, y int"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = texts.join(ids, texts["doc_id"] == ids["_id"]).drop("_id")
    return sample, counts.get(1, 0) / max(1, sum(counts.values()))
