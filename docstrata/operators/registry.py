"""Index versions: which is there, which is active, how many chunks each has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ensure_version(registry: DataFrame, row: DataFrame) -> DataFrame:
    """The registry with the version of ``row`` added if it lacks it."""
    return registry.unionByName(row.join(registry.select("index_version"), "index_version", "left_anti").select(*registry.columns))


def activate(registry: DataFrame, version: str, now: Column) -> DataFrame:
    """Exactly one version is active afterwards; an unknown name is an error when the rows are read."""
    # one row: how often the name is known
    known = registry.agg(F.count_if(F.col("index_version") == version).alias("_known"))
    checked = registry.join(F.broadcast(known)).where(F.when(F.col("_known") == 0, F.raise_error(F.lit(f"unknown index version {version}")).cast("boolean")).otherwise(True)).drop("_known")
    chosen = F.col("index_version") == version
    return checked.withColumn("is_active", chosen).withColumn("activated_at", F.when(chosen, now).otherwise(F.col("activated_at")))


def refresh_counts(registry: DataFrame, chunks: DataFrame) -> DataFrame:
    counts = chunks.groupBy("index_version").agg(F.count("*").alias("_n"))
    return registry.join(counts, "index_version", "left").withColumn("n_chunks", F.coalesce("_n", F.lit(0)).cast("long")).drop("_n")


def upsert(chunks: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` that the index lacks; what is there stays as it is."""
    return new.dropDuplicates(keys).join(chunks.select(*keys), keys, "left_anti")
