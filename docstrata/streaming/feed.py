"""Incremental intake as Structured Streaming: high-water marks, overlapping windows, micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstrata.storage import scratch  # noqa: F401

OVERLAP_DAYS = 1
FIRST_DAYS = 7


def resume_since(watermark: Column, until: Column, explicit: Column | None = None, overlap: int = OVERLAP_DAYS, first: int = FIRST_DAYS) -> Column:
    """Where the next window starts: as told, else a day before the high-water mark, else a week before its end."""
    mark = F.date_sub(F.substring(watermark, 1, 10).cast("date"), overlap)
    start = F.coalesce(mark, F.date_sub(until, first))
    return start if explicit is None else F.coalesce(explicit, start)


def high_water(rows: DataFrame, by: str, at: str, failed_runs: DataFrame | None = None) -> DataFrame:
    """The latest time by source, without runs that failed validation."""
    if failed_runs is not None:
        rows = rows.join(failed_runs.select("run_id"), "run_id", "left_anti")
    return rows.groupBy(by).agg(F.max(at).alias("high_water"))


def read_files(spark: SparkSession, folder: str, schema: T.StructType, name: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the Parquet files of a folder that match ``name``; times without zone become UTC times."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return stream.select(*(F.col(f.name).cast("timestamp").alias(f.name) if f.dataType == T.TimestampNTZType() else F.col(f.name) for f in schema))


def once_each(stream: DataFrame, key: str, at: str, late: str = f"{OVERLAP_DAYS} day") -> DataFrame:
    """Each key once; state is kept no longer than the overlap, and what comes later than that is dropped."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def drain(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream over all that is there now into Parquet, and read that."""
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def micro_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], state: str, every: str | None = None):
    """Start handling batches; with ``every`` (say "900 seconds") for ever, else over what is there now.

    A batch is handled again after a failure, so ``handle`` must be idempotent: deterministic keys and merges.
    """
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", state)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()
