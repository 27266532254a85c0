"""Streams of step events: windowed counts and running counters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def table_stream(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table's Parquet file or folder as a stream."""
    schema = spark.read.parquet(f"{path}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{path}/{name}.parquet*")


def windowed(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """A25 as a stream: events and sums by window and type, with a bound on lateness."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def running(steps: DataFrame) -> DataFrame:
    """E5 as a stream (columns key, action, delta, in the order of arrival): key and remaining after each batch of rows."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        left = state.get[0] if state.exists else 0
        for b in batches:
            for action, delta in zip(b.action, b.delta):
                left = delta if action == "keep" else left - abs(delta) if action == "remove" else left + delta if action in ("add", "extract") else left
        state.update((int(left),))
        yield pd.DataFrame({"key": [key[0]], "remaining": [int(left)]})

    return steps.groupBy("key").applyInPandasWithState(update, "key string, remaining long", "remaining long", "update", GroupStateTimeout.NoTimeout)


def append_csv(df: DataFrame, path: str, checkpoint: str):
    """An appending CSV sink; a restart goes on where it stopped."""
    return df.writeStream.format("csv").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
