"""The lake's tables derived from the given tables, for Spark and, in the same words, for SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.functions.text import chunk_id
from docstrata.operators.silver import route

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name and, if there is one, the SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """documents as landed records. Every 97th has failed a check at intake."""
    docs = table(spark, d, "documents")
    number = F.lpad((F.col("doc_id") % 50).cast("string"), 4, "0")
    return docs.select(
        F.concat_ws(":", "source", "doc_id").alias("record_key"),
        "source",
        F.col("doc_id").cast("string").alias("source_id"),
        F.col("doc_id").cast("string").alias("doc_id"),
        F.concat(F.lit("Document "), "doc_id", F.lit(" Re: EB-2025-"), number).alias("title"),
        F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("EB-2025-"), number)).alias("docket"),
        F.concat(F.lit("https://example.org/"), "doc_id").alias("url"),
        F.col("lang").alias("record_type"),
        F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (F.col("doc_id") % 90).cast("int")), "yyyy-MM-dd").alias("published_at"),
        F.date_format(F.date_add(F.lit("2026-04-01").cast("date"), (F.col("doc_id") % 7).cast("int")), "yyyy-MM-dd").alias("fetched_at"),
        F.when(F.col("doc_id") % 20 == 0, "pdf").otherwise("txt").alias("extension"),
        F.sha2("text", 256).alias("sha256"),
        F.octet_length("text").cast("long").alias("bytes"),
        F.col("n_chars").alias("size_hint"),
        F.concat(F.lit("run-"), F.col("doc_id") % 7).alias("run_id"),
        (F.col("doc_id") % 97 == 3).alias("bad"),
        "text",
    )


MANIFEST = """manifest AS (SELECT source || ':' || doc_id AS record_key, source, doc_id::VARCHAR AS source_id, doc_id::VARCHAR AS doc_id,
  'Document ' || doc_id || ' Re: EB-2025-' || lpad((doc_id % 50)::VARCHAR, 4, '0') AS title,
  CASE WHEN doc_id % 5 <> 0 THEN 'EB-2025-' || lpad((doc_id % 50)::VARCHAR, 4, '0') END AS docket,
  'https://example.org/' || doc_id AS url, lang AS record_type,
  strftime(DATE '2026-01-01' + (doc_id % 90)::INTEGER, '%Y-%m-%d') AS published_at, strftime(DATE '2026-04-01' + (doc_id % 7)::INTEGER, '%Y-%m-%d') AS fetched_at,
  CASE WHEN doc_id % 20 = 0 THEN 'pdf' ELSE 'txt' END AS extension, sha256(text) AS sha256, strlen(text)::BIGINT AS bytes, n_chars AS size_hint,
  'run-' || (doc_id % 7) AS run_id, doc_id % 97 = 3 AS bad, text FROM documents)"""


def silver(spark: SparkSession, d: str) -> DataFrame:
    """All records with their status; ``n_pages`` counts ten lines to a page."""
    rows = manifest(spark, d)
    rows = rows.withColumn("n_pages", F.ceil(F.size(F.split("text", "\n")) / 10))
    routed = route(rows, rows.where("bad").select("record_key")).drop("doc_id")
    return routed.withColumn("doc_id", F.col("source_id"))


SILVER = (
    MANIFEST
    + r""", first_bytes AS (SELECT sha256, min(record_key) AS bytes_keeper FROM manifest WHERE NOT bad GROUP BY 1),
hashed AS (SELECT m.*, b.bytes_keeper, sha256(trim(regexp_replace(regexp_replace(lower(m.text), '[0-9]', '0', 'g'), '\s+', ' ', 'g'))) AS text_hash
  FROM manifest m LEFT JOIN first_bytes b USING (sha256)),
text_keepers AS (SELECT text_hash, min(record_key) AS keeper FROM hashed WHERE NOT bad AND record_key = bytes_keeper AND length(text) >= 200 GROUP BY 1),
silver AS (SELECT h.*, CEIL(len(string_split(h.text, chr(10))) / 10.0)::BIGINT AS n_pages,
  CASE WHEN bad THEN 'quarantined' WHEN record_key <> bytes_keeper THEN 'duplicate' WHEN length(text) < 200 THEN 'quarantined' WHEN record_key <> keeper THEN 'duplicate' ELSE 'ok' END AS status,
  CASE WHEN bad THEN NULL WHEN record_key <> bytes_keeper THEN bytes_keeper WHEN length(text) < 200 THEN NULL WHEN record_key <> keeper THEN keeper END AS duplicate_of,
  CASE WHEN bad THEN 'bronze_validation' WHEN record_key <> bytes_keeper THEN NULL WHEN length(text) < 200 THEN 'parse' END AS stage
  FROM hashed h LEFT JOIN text_keepers k USING (text_hash))"""
)


def quarantine(rows: DataFrame) -> DataFrame:
    return rows.where("status = 'quarantined'")


def accepted(rows: DataFrame) -> DataFrame:
    """What the documents table holds: ok and duplicate records."""
    return rows.where("status <> 'quarantined'")


def raw_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Lines as chunks: version v1 of every document, v2 of every second; some rows were written twice."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("n"), F.posexplode(F.split("text", "\n")).alias("ordinal", "text")).where("text <> ''")
    versions = F.when(F.col("n") % 2 == 0, F.array(F.lit("v1-aaaaaaaaaaaa"), F.lit("v2-bbbbbbbbbbbb"))).otherwise(F.array(F.lit("v1-aaaaaaaaaaaa")))
    rows = lines.withColumn("chunk_config_version", F.explode(versions)).withColumn("chunked_at", F.explode(F.when(F.col("n") % 11 == 0, F.array(F.lit("2026-02-01"), F.lit("2026-02-02"))).otherwise(F.array(F.lit("2026-02-01")))))
    first = F.expr("1 + ordinal DIV 10")
    return rows.select(
        chunk_id(F.col("n").cast("string"), F.col("chunk_config_version"), F.col("ordinal")).alias("chunk_id"),
        F.col("n").cast("string").alias("doc_id"),
        "chunk_config_version",
        F.col("ordinal").cast("long").alias("ordinal"),
        F.when(F.col("ordinal") % 5 == 4, "table").otherwise("text").alias("chunk_type"),
        first.cast("long").alias("page_start"),
        F.when((F.col("n") % 31 == 0) & (F.col("ordinal") == 0), first + 5).otherwise(first).cast("long").alias("page_end"),
        F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).cast("long").alias("n_tokens"),
        "text",
        "chunked_at",
    )


RAW_CHUNKS = r"""doc_lines AS (SELECT doc_id AS n, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ordinal FROM documents),
raw_chunks AS (SELECT substr(sha256(n || '|' || v.version || '|' || ordinal), 1, 32) AS chunk_id, n::VARCHAR AS doc_id, v.version AS chunk_config_version, ordinal::BIGINT AS ordinal,
  CASE WHEN ordinal % 5 = 4 THEN 'table' ELSE 'text' END AS chunk_type, (1 + ordinal // 10)::BIGINT AS page_start,
  (1 + ordinal // 10 + CASE WHEN n % 31 = 0 AND ordinal = 0 THEN 5 ELSE 0 END)::BIGINT AS page_end, len(regexp_extract_all(text, '\S+'))::BIGINT AS n_tokens, text, w.day AS chunked_at
  FROM doc_lines, (VALUES ('v1-aaaaaaaaaaaa', 1), ('v2-bbbbbbbbbbbb', 2)) v(version, step), (VALUES ('2026-02-01', 1), ('2026-02-02', 11)) w(day, step)
  WHERE text <> '' AND n % v.step = 0 AND n % w.step = 0)"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """The latest copy of each chunk."""
    from docstrata.operators.silver import latest

    return latest(raw_chunks(spark, d), ["chunk_config_version", "chunk_id"], [F.desc("chunked_at")])


CHUNKS = RAW_CHUNKS + ", chunks AS (SELECT * FROM raw_chunks QUALIFY row_number() OVER (PARTITION BY chunk_config_version, chunk_id ORDER BY chunked_at DESC) = 1)"


def turns(spark: SparkSession, d: str) -> DataFrame:
    """conversations as chunks of documents: system turns are the chunks that are no text."""
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("doc_id"),
        F.col("turn").alias("ordinal"),
        F.concat_ws("-", "conv_id", "turn").alias("chunk_id"),
        F.when(F.col("role") == "system", "table").otherwise("text").alias("chunk_type"),
        "text",
        F.col("role").alias("context"),
        (F.col("turn") + 1).alias("page_start"),
        (F.col("turn") + 1).alias("page_end"),
    )


TURNS = """turns AS (SELECT conv_id AS doc_id, turn AS ordinal, conv_id || '-' || turn AS chunk_id, CASE WHEN role = 'system' THEN 'table' ELSE 'text' END AS chunk_type, text, role AS context,
  turn + 1 AS page_start, turn + 1 AS page_end FROM conversations)"""
