"""Data-quality tests as queries of violating rows, and the checks of a landed batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REQUIRED = ["source", "source_id", "title", "url", "published_at", "extension", "object_uri", "sha256"]
MAGIC = {"pdf": "%PDF-", "htm": "<", "html": "<"}


def not_null(df: DataFrame, column: str, where: str = "true") -> DataFrame:
    return df.where(F.col(column).isNull() & F.expr(where))


def unique(df: DataFrame, *columns: str) -> DataFrame:
    """Combinations that occur more than once, with their count."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def accepted_values(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.where(~F.col(column).isin(values)).groupBy(column).agg(F.count("*").alias("n"))


def relationship(df: DataFrame, column: str, to: DataFrame, field: str) -> DataFrame:
    """Rows whose value is not null and has no parent."""
    return df.where(F.col(column).isNotNull()).join(to.select(F.col(field).alias(column)), column, "left_anti")


def matches_regex(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).rlike(pattern))


def documents_without_chunks(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, version) pairs of ok documents and chunk versions without a chunk.

    The versions are exploded from one collected list per partition-free aggregate instead of a
    cross join of tables: their number is that of configurations, not of rows.
    """
    versions = chunks.select("chunk_config_version").distinct().agg(F.sort_array(F.collect_list("chunk_config_version")).alias("versions"))
    # one row with a name for each configuration
    pairs = documents.where("status = 'ok'").join(F.broadcast(versions)).select("doc_id", F.explode("versions").alias("chunk_config_version"))
    return pairs.join(chunks.select("doc_id", "chunk_config_version"), ["doc_id", "chunk_config_version"], "left_anti")


def page_ranges(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    joined = chunks.join(documents.where("status = 'ok'").select("doc_id", "n_pages"), "doc_id")
    return joined.where("page_start < 1 OR page_end < page_start OR page_end > n_pages").select("chunk_id")


def suite(documents: DataFrame, chunks: DataFrame, manifest: DataFrame, most_tokens: int, fewest_tokens: int = 0) -> DataFrame:
    """rule, broken: how much breaks each rule of the silver tables, in one pass over each table.

    documents: doc_id, record_key, text_hash, status, n_pages; chunks, of one version or of more: chunk_config_version, chunk_id, doc_id, page_start, page_end,
    n_tokens; manifest: record_key. Chunks are counted by id and then by document, and documents meet the counts once; the verdicts are
    those of the single tests above. A null counts as one more value where values have to be unique.
    """
    bad_range = (F.col("page_start") < 1) | (F.col("page_end") < F.col("page_start"))
    bad_tokens = (F.col("n_tokens") <= fewest_tokens) | (F.col("n_tokens") > most_tokens)
    by_id = chunks.groupBy("chunk_config_version", "chunk_id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.count_if(bad_range).alias("ranges"), F.max("page_end").alias("last"), F.count_if(bad_tokens).alias("tokens"))
    by_doc = by_id.groupBy("doc_id").agg(F.sum("n").alias("chunks"), F.count_if(F.col("n") > 1).alias("repeated"), F.sum("ranges").alias("ranges"), F.max("last").alias("last"), F.sum("tokens").alias("tokens"), F.count_distinct("chunk_config_version").alias("versions"))
    known = manifest.select(F.col("record_key").alias("known_key")).distinct()
    docs = documents.select("doc_id", "record_key", "text_hash", "status", "n_pages", F.lit(True).alias("is_doc"))
    met = docs.join(by_doc, "doc_id", "full").join(known, F.col("record_key") == F.col("known_key"), "left").withColumn("is_doc", F.coalesce("is_doc", F.lit(False)))
    is_doc, ok = F.col("is_doc"), F.col("is_doc") & (F.col("status") == "ok")
    value = lambda c: F.coalesce(F.col(c), F.lit("\0"))
    total = lambda c, where=F.lit(True): F.coalesce(F.sum(F.when(where, F.col(c))), F.lit(0))
    counts = {
        "record_key is unique": F.count_if(is_doc) - F.count_distinct(F.when(is_doc, value("record_key"))),
        "one ok document for a text": F.count_if(ok) - F.count_distinct(F.when(ok, value("text_hash"))),
        "status is known": F.count_if(is_doc & ~F.col("status").isin("ok", "duplicate")),
        "n_pages of ok documents": F.count_if(ok & F.col("n_pages").isNull()),
        "documents have a record": F.count_if(is_doc & F.col("record_key").isNotNull() & F.col("known_key").isNull()),
        "chunk ids are unique": total("repeated"),
        "chunks have a document": total("chunks", ~is_doc & F.col("doc_id").isNotNull()),
        # without any chunk there is no version that could lack some
        "ok documents have chunks": F.when(total("chunks") > 0, F.count_if(ok & (F.coalesce("versions", F.lit(0)) < F.lit(1)))).otherwise(0),
        "page ranges": F.count_if(ok & ((F.col("ranges") > 0) | (F.col("last") > F.col("n_pages")))),
        "token bounds": total("tokens"),
    }
    one = met.agg(*(c.cast("long").alias(name) for name, c in counts.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.col(f"`{name}`").alias("broken")) for name in counts))).alias("r")).select("r.*")


def required_fields(fields: list[str] | None = None) -> Column:
    return reduce(lambda a, b: a | b, (F.col(c).isNull() | (F.col(c).cast("string") == "") for c in fields or REQUIRED))


def repeated_ids(rows: DataFrame, order: list[str]) -> DataFrame:
    """Second and later rows of an id."""
    w = Window.partitionBy("source", "source_id").orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n > 1").drop("_n")


def hash_differs(content: str = "content") -> Column:
    """True where the stored bytes are gone or do not have the recorded digest."""
    return F.col(content).isNull() | (F.sha2(F.col(content).cast("binary"), 256) != F.col("sha256"))


def signature_differs(head: str = "head") -> Column:
    """True where the first kilobyte, blanks aside, does not start as the extension says; unknown extensions pass."""
    start = F.regexp_replace(F.substring(F.col(head), 1, 1024), r"^\s+", "")
    wanted = F.create_map(*(F.lit(x) for kv in MAGIC.items() for x in kv))[F.col("extension")]
    return F.coalesce(~F.startswith(start, wanted), F.lit(False))


def size_outside(least: int = 1024, most: int = 52_428_800) -> Column:
    return ~F.col("bytes").between(least, most)


def size_differs() -> Column:
    return F.coalesce((F.col("size_hint") != 0) & (F.col("size_hint") != F.col("bytes")), F.lit(False))


def fetch_error_rate(counts: DataFrame, most: float = 0.2) -> DataFrame:
    """counts: n_ok, n_err. Passes when nothing was fetched."""
    total = F.col("n_ok") + F.col("n_err")
    rate = F.when(total > 0, F.col("n_err") / total).otherwise(0.0)
    return counts.withColumn("rate", F.round(rate, 6)).withColumn("passed", rate <= most)


def freshness(rows: DataFrame, now: Column, days: int = 14) -> DataFrame:
    """newest, age_days, passed; an empty batch passes."""
    newest = rows.agg(F.max("published_at").alias("newest"))
    return newest.withColumn("age_days", F.datediff(now, F.col("newest").cast("date"))).withColumn("passed", F.coalesce(F.col("age_days") <= days, F.lit(True)))


def volume(reports: DataFrame, ratio: float = 0.3, trailing: int = 10, least: int = 3) -> DataFrame:
    """Each report's ``listed`` against the mean of the reports before it that listed anything; few reports pass.

    One row per run: the window without a partition is over reports, not documents.
    """
    w = Window.orderBy("validated_at", "run_id").rowsBetween(-trailing, -1)
    counted = F.nullif(F.col("listed"), F.lit(0))
    out = reports.withColumn("n_before", F.count(counted).over(w)).withColumn("mean_before", F.avg(counted).over(w))
    passed = (F.col("n_before") < least) | (F.col("listed") >= F.col("mean_before") * ratio)
    return out.withColumn("passed", passed).withColumn("mean_before", F.round("mean_before", 6))


# The checks of a batch and their severity.
CHECKS = {
    "required_fields_not_null": "error",
    "unique_source_id": "error",
    "object_hash_matches_manifest": "error",
    "file_signature_matches_extension": "warn",
    "size_within_bounds": "warn",
    "download_size_matches_source": "warn",
    "fetch_error_rate": "error",
    "freshness": "warn",
    "volume_vs_trailing": "warn",
}


def failed_records(rows: DataFrame, order: list[str], least: int = 1024, most: int = 52_428_800) -> DataFrame:
    """(name, record_key) for each check that a record fails; ``content`` holds the stored bytes as text.

    One pass over the batch: the checks of a row are one array, and only repeated ids need a shuffle.
    """
    w = Window.partitionBy("source", "source_id").orderBy(*order)
    tests = {
        "required_fields_not_null": required_fields(["source", "source_id", "sha256"]),
        "unique_source_id": F.col("_n") > 1,
        "object_hash_matches_manifest": hash_differs(),
        "file_signature_matches_extension": signature_differs("content"),
        "size_within_bounds": size_outside(least, most),
        "download_size_matches_source": size_differs(),
    }
    failed = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items())))
    return rows.withColumn("_n", F.row_number().over(w)).select(F.explode(failed).alias("name"), "record_key")


def volume_now(listed: Column, reports: DataFrame, ratio: float = 0.3, trailing: int = 10, least: int = 3) -> DataFrame:
    """One row, passed: is ``listed`` no less than a share of the mean of the last reports? Those that listed nothing do not count; few reports pass."""
    last = reports.orderBy(F.desc("validated_at"), F.desc("run_id")).limit(trailing).where("listed > 0")
    return last.agg(((F.count("*") < least) | (listed >= F.avg("listed") * ratio)).alias("passed"))


def batch_report(rows: DataFrame, order: list[str], now: Column, fetch_errors: int = 0, stale_days: int = 14, reports: DataFrame | None = None, listed: int | None = None, **limits) -> DataFrame:
    """name, severity, n_failed, passed for each check. reports: those of earlier batches (validated_at, run_id, listed); ``listed``: records of this one, new or not.

    limits: min_bytes, max_bytes, max_error_rate, drop_ratio.
    """
    spark = rows.sparkSession
    counts = failed_records(rows, order, limits.get("min_bytes", 1024), limits.get("max_bytes", 52_428_800)).groupBy("name").agg(F.count("*").alias("n"))
    one = lambda df, name: df.select(F.lit(name).alias("name"), (~F.col("passed")).cast("long").alias("n"))
    rate = fetch_error_rate(rows.agg(F.count("*").alias("n_ok")).withColumn("n_err", F.lit(fetch_errors)), limits.get("max_error_rate", 0.2))
    single = one(rate, "fetch_error_rate").unionByName(one(freshness(rows, now, stale_days), "freshness"))
    if reports is not None:
        single = single.unionByName(one(volume_now(F.lit(listed), reports, limits.get("drop_ratio", 0.3)), "volume_vs_trailing"))
    values = ", ".join(f"('{n}', '{s}')" for n, s in CHECKS.items())
    checks = spark.sql(f"SELECT * FROM VALUES {values} AS checks(name, severity)")
    joined = checks.join(counts.unionByName(single), "name", "left")
    n = F.coalesce("n", F.lit(0))
    return joined.select("name", "severity", n.alias("n_failed"), (n == 0).alias("passed"))


def batch_status(report: DataFrame) -> DataFrame:
    """failed if an error failed, else warn if a warning did, else passed."""
    failed = lambda s: F.coalesce(F.bool_or(~F.col("passed") & (F.col("severity") == s)), F.lit(False))
    return report.agg(F.when(failed("error"), "failed").when(failed("warn"), "warn").otherwise("passed").alias("status"))


def to_quarantine(rows: DataFrame, order: list[str], **limits) -> DataFrame:
    """The records that fail any check."""
    return failed_records(rows, order, **limits).select("record_key").distinct()
