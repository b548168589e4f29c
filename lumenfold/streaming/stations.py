"""Stations as they arrive: each new file of points goes through the batch plan; stations do not depend on each other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def follow(spark: SparkSession, source: str, sink: str, checkpoint: str, plan: Callable[[DataFrame], DataFrame], available_now: bool = True) -> StreamingQuery:
    """Reads Parquet point files from source as they come, applies plan to each batch and appends to sink.

    A batch that is run again after a failure overwrites its own folder, so no row comes twice.
    """
    schema = spark.read.parquet(source).schema

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream).start()
