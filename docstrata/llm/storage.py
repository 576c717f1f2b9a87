"""Lineage cuts for the training-data operators, tables, and how many partitions and blocks to deal rows to.

An intermediate result is cut from its lineage by writing it as Parquet into the folder that the
cluster shares (``spark.checkpoint.dir``), so that a lost executor never loses the only copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docstrata.storage import _shuffles_dropped as shuffles_dropped
from docstrata.storage import _written, drop, intermediates, materialize, note, release, scratch, shared_dir

__all__ = ["_written", "drop", "input_bytes", "intermediates", "materialize", "note", "partitions_for", "release", "scan_blocks", "scratch", "shared_dir", "shuffle_partitions", "shuffles_dropped", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(spark: SparkSession, rows: int, most_rows: int = 2_000_000) -> int:
    """How many partitions to deal counted rows to: as many as for any shuffle, and more if they would hold more than ``most_rows`` each."""
    return max(shuffle_partitions(spark), -(-rows // most_rows))


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of ``df`` (file bytes for a scan); no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def scan_blocks(df: DataFrame, block_bytes: int) -> int:
    """How many blocks to deal ``df`` into: by its size, and two for each shuffle partition."""
    size = input_bytes(df)
    by_size = -(-size // block_bytes) if size < 1 << 60 else 0
    return int(max(2 * shuffle_partitions(df.sparkSession), by_size))
