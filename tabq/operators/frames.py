"""Operators on DataFrames that SQL text can't name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, take: list[str], tie: str | None = None, strict: bool = False) -> DataFrame:
    """Each left row with `take` of the right row of its group that is latest at or before it (before it, if strict).

    Union and a running last value: one shuffle on `by`, no pair is formed. Left rows without a match get nulls. Of right
    rows at one moment the largest `tie` counts.
    """
    names = left.columns
    body = F.struct(*[F.col(c) for c in take])
    r = right.select(*by, F.col(on), F.lit(1 if strict else 0).alias("_side"), F.col(tie).alias("_tie") if tie else F.lit(None).cast("long").alias("_tie"), body.alias("_right"), F.lit(None).cast(left.select(F.struct("*").alias("s")).schema["s"].dataType).alias("_left"))
    blank = F.lit(None).cast(r.schema["_right"].dataType)
    lf = left.select(*by, F.col(on), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(r.schema["_tie"].dataType).alias("_tie"), blank.alias("_right"), F.struct("*").alias("_left"))
    w = Window.partitionBy(*by).orderBy(on, "_side", F.col("_tie").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    out = r.unionByName(lf).withColumn("_last", F.last("_right", ignorenulls=True).over(w)).filter("_left IS NOT NULL")
    return out.select(*[F.col(f"_left.`{c}`").alias(c) for c in names], *[F.col(f"_last.`{c}`").alias(c) for c in take])


def groups_frame(df: DataFrame, partition: list[str], order: list, before: int | None, after: int | None):
    """(frame with peer numbers, window) for a GROUPS frame: `before` peer groups to `after` of them (None: unbounded)."""
    ranked = df.withColumn("_peer", F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
    lo = Window.unboundedPreceding if before is None else -before
    hi = Window.unboundedFollowing if after is None else after
    return ranked, Window.partitionBy(*partition).orderBy("_peer").rangeBetween(lo, hi)


def recursive_union(start: DataFrame, step, rounds: int = 10_000) -> DataFrame:
    """All rows reachable from `start` by `step` (a function of the newest rows), each once."""
    from ..session import checkpointed

    seen = fresh = checkpointed(start.distinct())
    for k in range(rounds):
        on = [F.col(f"n.`{c}`").eqNullSafe(F.col(f"s.`{c}`")) for c in seen.columns]
        fresh = checkpointed(step(fresh).toDF(*seen.columns).distinct().alias("n").join(seen.alias("s"), on, "left_anti"))
        if fresh.isEmpty():
            return seen
        seen = seen.unionByName(fresh)
        if k % 12 == 11:
            seen = checkpointed(seen)  # one scan again, in place of one a round
    raise ValueError(f"recursion did not end after {rounds} rounds")
