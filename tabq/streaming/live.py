"""Compat queries over streams, as a superset: each micro-batch is a relation that the engine queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine


def each_batch(stream: DataFrame, query: str, sink: Callable[[DataFrame, int], None], checkpoint: str, name: str = "t", once: bool = True) -> StreamingQuery:
    """Run `query` on every micro-batch, which it sees as `name`, and hand the result to `sink` with the batch's number.

    A batch that is run again after a failure has the same number, so a sink that overwrites by number is exact.
    """

    def run(batch: DataFrame, number: int) -> None:
        out = Engine(batch.sparkSession).register(name, batch).sql(query)
        if out is not None:
            sink(out, number)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
