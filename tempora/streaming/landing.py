"""Incremental ingestion: file streams into keyed tables, with a ledger and de-duplication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from tempora.sources.ledger import latest


def landing_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """New JSON payloads of a folder, each file once; the checkpoint is the cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def once_per_key(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """The first event of each key within the watermark: repeated deliveries go."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_load(stream: DataFrame, time: str, by: str, value: str, length: str, slide: str, late: str) -> DataFrame:
    """Sums of a sliding window per key; a window is final when the watermark has passed it."""
    windows = stream.withWatermark(time, late).groupBy(by, F.window(time, length, slide)).agg(F.count("*").alias("events"), F.sum(value).alias("total"))
    return windows.select(by, F.col("window.start").alias("window_from"), F.col("window.end").alias("window_to"), "events", "total")


def sessions(stream: DataFrame, time: str, by: str, gap: str, late: str) -> DataFrame:
    """Workouts out of raw events: runs of events of a key with no gap of that length."""
    found = stream.withWatermark(time, late).groupBy(by, F.session_window(time, gap)).agg(F.count("*").alias("events"))
    return found.select(by, F.col("session_window.start").alias("session_from"), F.col("session_window.end").alias("session_to"), "events")


def upsert_batch(path: str, keys: list[str], version: str, adapt: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer: each batch leaves its newest row of each key in a folder of its own.

    Nothing that is stored is read or rewritten, so a batch costs what it brings; a batch that runs again replaces its own
    folder. Readers take the newest row of each key (`current_table`), and `compact` bounds what they have to read."""

    def write(batch: DataFrame, number: int) -> None:
        new = adapt(batch) if adapt else batch
        latest(new, keys, [F.col(version)]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def current_table(spark: SparkSession, path: str, keys: list[str], version: str, schema: StructType) -> DataFrame:
    """The newest row of each key over all batches; of equal versions that of the later batch."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(path)
    return latest(rows, keys, [F.col(version), F.col("batch")]).drop("batch")


def compact(spark: SparkSession, path: str, target: str, keys: list[str], version: str, schema: StructType) -> None:
    """The current table as the first batch of a new path; the next stream run writes there, with a new checkpoint."""
    current_table(spark, path, keys, version, schema).write.mode("overwrite").parquet(f"{target}/batch=-1")


def ingest(stream: DataFrame, path: str, checkpoint: str, keys: list[str], version: str, adapt: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Start a run that takes what has landed, upserts it and ends: a scheduled micro-batch job.

    The table exists, empty, even before anything lands."""
    schema = (adapt(stream) if adapt else stream).schema
    stream.sparkSession.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/batch=-1")
    return stream.writeStream.foreachBatch(upsert_batch(path, keys, version, adapt)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
