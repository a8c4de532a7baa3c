"""The batch change plan, run on every micro-batch of a chunk folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docketry.operators.state import changes


def watch(spark: SparkSession, path: str, schema: str, known: Callable[[], DataFrame], key: str, then: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Call then(changed rows, batch number) for each batch of new files below path."""
    stream = spark.readStream.schema(schema).parquet(path)
    return (
        stream.writeStream.foreachBatch(lambda batch, number: then(changes(batch, known(), key), number))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
