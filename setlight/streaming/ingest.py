"""Incremental ingest with Structured Streaming: file streams, high-water marks, windows and state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery


def listen_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream of listens with an event time."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder).withColumn("at", F.timestamp_millis("ms"))


def fresh(stream: DataFrame, key: str, delay: str) -> DataFrame:
    """Rows of an id once within the watermark; rows older than it are dropped, as a cursor would."""
    return stream.withWatermark("at", delay).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, delay: str, size: str) -> DataFrame:
    """A9 as a stream: tumbling sums that are final once the watermark has passed."""
    known = F.when(F.col("duration_ms") > 0, F.col("duration_ms")).otherwise(0)
    sums = stream.withWatermark("at", delay).groupBy(F.window("at", size), "band_id").agg(F.sum(known).alias("duration_ms"), F.count("*").alias("listen_count"))
    return sums.select(F.col("window.start").alias("start_at"), "band_id", "duration_ms", "listen_count")


def append_to(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append each batch to a Parquet table, exactly once by the checkpoint; stops when all input is read."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def merge_batches(stream: DataFrame, checkpoint: str, merge) -> StreamingQuery:
    """Hand each batch to ``merge(batch, number)``, which must be idempotent; the checkpoint resumes after a failure."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Backoff(StatefulProcessor):
    """Empty checks in a row per band: a find resets them, an empty check adds one, up to three."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.misses = handle.getValueState("misses", "misses long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        misses = self.misses.get()[0] if self.misses.exists() else 0
        checks = pd.concat(list(rows)).sort_values("ms")
        for found in checks["found"]:
            misses = 0 if found else min(3, misses + 1)
        self.misses.update((misses,))
        yield pd.DataFrame({"band_id": [key[0]], "misses": [misses], "last_ms": [int(checks["ms"].max())]})

    def close(self) -> None:
        pass


def backoff_states(stream: DataFrame) -> DataFrame:
    """W4 over a stream of checks (band_id, ms, found); needs the RocksDB state store."""
    return stream.groupBy("band_id").transformWithStateInPandas(Backoff(), "band_id long, misses long, last_ms long", "Update", "None")
