"""The marts over silver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id", "chunk_config_version").agg(F.count("*").alias("n_chunks"), F.count_if(F.col("chunk_type") == "table").alias("n_table_chunks"), F.sum("n_tokens").cast("long").alias("n_tokens"))


def dim_documents(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row for each ok document and chunk version (a null version where it has no chunk)."""
    return documents.where("status = 'ok'").join(chunk_stats(chunks), "doc_id", "left")


def fct_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    return chunks.join(documents.where("status = 'ok'").select("doc_id", "record_type"), "doc_id")


def docket_coverage(dim: DataFrame, version: str | None = None) -> DataFrame:
    """By docket. Sums go over all chunk versions unless one is named."""
    rows = dim.where(F.col("docket").isNotNull())
    if version:
        rows = rows.where(F.col("chunk_config_version") == version)
    return rows.groupBy("docket").agg(F.countDistinct("doc_id").alias("documents"), F.min("published_at").alias("first_filing"), F.max("published_at").alias("last_filing"), F.sum("n_chunks").alias("chunks"))


def pipeline_health(manifest: DataFrame, documents: DataFrame, quarantine: DataFrame) -> DataFrame:
    """What landed in each run and what came of it."""
    status = documents.select("record_key", "status").unionByName(quarantine.select("record_key", F.lit("quarantined").alias("status")))
    # one row per record in each of the two tables, so conditional counts need no distinct
    joined = manifest.select("run_id", "record_key", "bytes", "fetched_at").join(status.groupBy("record_key").pivot("status", ["ok", "duplicate", "quarantined"]).agg(F.count("status")), "record_key", "left")
    count = lambda c: F.count_if(F.col(c) > 0)
    grouped = joined.groupBy("run_id").agg(F.max("fetched_at").alias("fetched_at"), F.count("*").alias("landed"), F.sum("bytes").alias("bytes"), count("ok").alias("parsed_ok"), count("duplicate").alias("duplicates"), count("quarantined").alias("quarantined"))
    pending = F.col("landed") - F.col("parsed_ok") - F.col("duplicates") - F.col("quarantined")
    rate = F.round(F.col("quarantined") / F.nullif(F.col("landed").cast("double"), F.lit(0.0)), 4)
    return grouped.withColumn("pending_silver", pending).withColumn("quarantine_rate", rate)


def with_titles(quarantine: DataFrame, manifest: DataFrame) -> DataFrame:
    """Quarantine rows with the titles of their records."""
    return quarantine.join(manifest.select("record_key", "title"), "record_key", "left")


def document_search(documents: DataFrame, q: str, limit: int) -> DataFrame:
    """Ok documents with q in title or docket, whatever the case, newest first; the limit is held to 1..500."""
    needle = q.lower()
    hit = F.lower("title").contains(needle) | F.lower(F.coalesce("docket", F.lit(""))).contains(needle)
    return documents.where(F.col("status").eqNullSafe("ok") & hit).orderBy(F.desc_nulls_last("published_at"), "record_key").limit(max(1, min(500, limit)))
