"""From landed records to silver documents: duplicates, routing, incremental work lists, idempotent writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstrata.functions.text import text_hash

MIN_TEXT = 200


def first_seen(rows: DataFrame, key: str, order: list[str], value: str, out: str = "duplicate_of") -> DataFrame:
    """``out`` is the value of the first row with the same key, null on that row itself.

    The first row is an aggregate (combined before the shuffle), so a key with very many rows is no single sort.
    """
    first = rows.groupBy(key).agg(F.min_by(F.struct(*order, value), F.struct(*order)).alias("first"))
    joined = rows.join(first, key)
    same = F.struct(*order).eqNullSafe(F.struct(*(F.col(f"first.{c}").alias(c) for c in order)))
    return joined.withColumn(out, F.when(~same, F.col(f"first.{value}"))).drop("first")


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order: the latest copy, say."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def keepers(new: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """text_hash, keeper for (record_key, text_hash): an existing ok document, else the smallest new key."""
    rows = new.select("text_hash", "record_key", F.lit(1).alias("prio"))
    if existing is not None:
        rows = rows.unionByName(existing.where("status = 'ok'").select("text_hash", "record_key", F.lit(0).alias("prio")))
    return rows.groupBy("text_hash").agg(F.min(F.struct("prio", "record_key"))["record_key"].alias("keeper"))


def route(records: DataFrame, bad_keys: DataFrame, existing: DataFrame | None = None, min_text: int = MIN_TEXT) -> DataFrame:
    """Add doc_id, text_hash, duplicate_of, status (ok, duplicate, quarantined), stage and reason to manifest rows with a text.

    In this order: failed a check at intake; same bytes as an earlier record; too little text; same text
    but for case, digits and blanks as a document that is kept; ok.
    """
    # hash and length come first, so that the text itself takes part in no join unless the caller asks for it
    text = F.coalesce("text", F.lit(""))
    narrow = records.withColumn("text_hash", text_hash(text)).withColumn("_size", F.length(text))
    marked = narrow.join(bad_keys.select("record_key", F.lit(True).alias("_failed")).distinct(), "record_key", "left")
    usable = marked.where("_failed IS NULL")
    # equal bytes have equal hashes and lengths: one row for each content serves both kinds of duplicates
    contents = usable.groupBy("sha256").agg(F.min("record_key").alias("bytes_keeper"), F.min("text_hash").alias("_hash"), F.min("_size").alias("_length"))
    candidates = contents.where(F.col("_length") >= min_text).select(F.col("bytes_keeper").alias("record_key"), F.col("_hash").alias("text_hash"))
    same_bytes, short = F.col("record_key") != F.col("bytes_keeper"), F.col("_size") < min_text
    joined = marked.join(contents.select("sha256", "bytes_keeper"), "sha256", "left").join(keepers(candidates, existing), "text_hash", "left")
    same_text = F.col("record_key") != F.col("keeper")
    case = lambda bad, same, few, near, ok: F.when(F.col("_failed"), bad).when(same_bytes, same).when(short, few).when(same_text, near).otherwise(ok)
    null = F.lit(None).cast("string")
    return (
        joined.withColumn("doc_id", F.col("sha256"))
        .withColumn("status", case(F.lit("quarantined"), F.lit("duplicate"), F.lit("quarantined"), F.lit("duplicate"), F.lit("ok")))
        .withColumn("duplicate_of", case(null, F.col("bytes_keeper"), null, F.col("keeper"), null))
        .withColumn("stage", case(F.lit("bronze_validation"), null, F.lit("parse"), null, null))
        .withColumn("reason", case(F.lit("failed a check at intake"), null, F.concat(F.lit("only "), F.col("_size"), F.lit(" characters")), null, null))
        .drop("_failed", "_size", "bytes_keeper", "keeper")
    )


def outcome(routed: DataFrame, by: str) -> DataFrame:
    """Counts of each status and the share in quarantine."""
    count = lambda s: F.count_if(F.col("status") == s)
    grouped = routed.groupBy(by).agg(F.count("*").alias("landed"), count("ok").alias("parsed_ok"), count("duplicate").alias("duplicates"), count("quarantined").alias("quarantined"))
    return grouped.withColumn("quarantine_rate", F.round(F.col("quarantined") / F.nullif(F.col("landed").cast("double"), F.lit(0.0)), 4))


def todo(manifest: DataFrame, documents: DataFrame, quarantine: DataFrame, limit: int | None = None) -> DataFrame:
    """Records that no document and no quarantine row has yet; with a limit, the first by key."""
    done = documents.select("record_key").unionByName(quarantine.select("record_key"))
    rows = manifest.join(done, "record_key", "left_anti")
    return rows.orderBy("record_key").limit(limit) if limit else rows


def new_listings(listed: DataFrame, manifest: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Listed records that are not in the manifest, the first of each key."""
    return latest(listed.join(manifest.select(*keys), keys, "left_anti"), keys, order)


def missing_in_version(documents: DataFrame, chunks: DataFrame, version: str) -> DataFrame:
    """Ok documents without a chunk in the given chunk version."""
    have = chunks.where(F.col("chunk_config_version") == version).select("doc_id")
    return documents.where("status = 'ok'").join(have, "doc_id", "left_anti")


def backfill(rows: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """Fill ``column`` where it is null from ``values`` (key, column)."""
    other = values.select(key, F.col(column).alias("_v"))
    return rows.join(other, key, "left").withColumn(column, F.coalesce(column, "_v")).drop("_v").select(*rows.columns)
