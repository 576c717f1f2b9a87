"""Queries of the lake: intake, routing, marts, data-quality tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from docstrata.operators import marts, quality, registry, silver
from docstrata.plans.adapters import CHUNKS, MANIFEST, RAW_CHUNKS, SILVER, accepted, chunks, manifest, quarantine, query, raw_chunks, table
from docstrata.plans.adapters import silver as silver_rows
from docstrata.storage import materialize


@query(f"WITH {SILVER} SELECT source, count(*) AS landed, count(*) FILTER (status = 'ok') AS parsed_ok, count(*) FILTER (status = 'duplicate') AS duplicates, count(*) FILTER (status = 'quarantined') AS quarantined, round(count(*) FILTER (status = 'quarantined') / count(*)::DOUBLE, 4) AS quarantine_rate FROM silver GROUP BY source")
def silver_outcome(spark, d):
    return silver.outcome(silver_rows(spark, d), "source")


@query(f"WITH {SILVER} SELECT record_key, text_hash, status, duplicate_of, stage FROM silver")
def silver_routing(spark, d):
    return silver_rows(spark, d).select("record_key", "text_hash", "status", "duplicate_of", "stage")


@query(r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(lower(text), '[0-9]', '0', 'g'), '\s+', ' ', 'g'))) AS text_hash FROM documents")
def normalized_text_hash(spark, d):
    from docstrata.functions.text import text_hash

    return table(spark, d, "documents").select("doc_id", text_hash(F.col("text")).alias("text_hash"))


@query(f"WITH {SILVER} SELECT text_hash, keeper FROM text_keepers")
def near_dup_keepers(spark, d):
    rows = silver_rows(spark, d).withColumnRenamed("size_hint", "n_chars")
    firsts = accepted(rows).groupBy("sha256").agg(F.min("record_key").alias("record_key"), F.first("text_hash").alias("text_hash"), F.first("n_chars").alias("n_chars"))
    return silver.keepers(firsts.where(F.col("n_chars") >= silver.MIN_TEXT))


@query(f"WITH {SILVER} SELECT record_key, duplicate_of FROM silver WHERE status = 'duplicate'")
def near_dup_losers(spark, d):
    return silver_rows(spark, d).where("status = 'duplicate'").select("record_key", "duplicate_of")


@query("SELECT doc_id, sha256(text) AS sha256, CASE WHEN doc_id <> min(doc_id) OVER (PARTITION BY sha256(text)) THEN min(doc_id) OVER (PARTITION BY sha256(text)) END AS duplicate_of FROM documents")
def exact_dup_first_seen(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return silver.first_seen(rows.withColumn("object", F.col("doc_id")), "sha256", ["doc_id"], "object").select("doc_id", "sha256", "duplicate_of")


@query("SELECT doc_id, length(text) AS n_chars FROM documents WHERE length(text) < 200")
def min_text_quarantine(spark, d):
    return table(spark, d, "documents").where(F.length("text") < silver.MIN_TEXT).select("doc_id", F.length("text").cast("long").alias("n_chars"))


@query(f"WITH {MANIFEST} SELECT record_key, title, docket, strftime(published_at::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS published, bytes, run_id FROM manifest")
def staged_manifest(spark, d):
    return manifest(spark, d).select("record_key", "title", "docket", F.date_format(F.col("published_at").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("published"), "bytes", "run_id")


@query(f"WITH {CHUNKS} SELECT chunk_id, chunk_config_version, chunked_at FROM chunks")
def latest_copy(spark, d):
    return chunks(spark, d).select("chunk_id", "chunk_config_version", "chunked_at")


DIM = f"""{SILVER}, {CHUNKS}, stats AS (SELECT doc_id, chunk_config_version, count(*) AS n_chunks, count(*) FILTER (chunk_type = 'table') AS n_table_chunks, sum(n_tokens)::BIGINT AS n_tokens FROM chunks GROUP BY ALL),
dim AS (SELECT d.doc_id, d.docket, d.published_at, s.chunk_config_version, s.n_chunks, s.n_table_chunks, s.n_tokens FROM silver d LEFT JOIN stats s USING (doc_id) WHERE d.status = 'ok')"""


def _dim(spark, d):
    return marts.dim_documents(silver_rows(spark, d).select("doc_id", "docket", "published_at", "status"), chunks(spark, d)).drop("status")


@query(f"WITH {DIM} SELECT * FROM dim")
def dim_documents(spark, d):
    return _dim(spark, d)


@query(f"WITH {SILVER}, {CHUNKS} SELECT c.chunk_id, c.doc_id, c.n_tokens, d.record_type FROM chunks c JOIN silver d ON d.doc_id = c.doc_id AND d.status = 'ok'")
def fct_chunks(spark, d):
    return marts.fct_chunks(chunks(spark, d), silver_rows(spark, d)).select("chunk_id", "doc_id", "n_tokens", "record_type")


COVERAGE = "SELECT docket, count(DISTINCT doc_id) AS documents, min(published_at) AS first_filing, max(published_at) AS last_filing, sum(n_chunks)::BIGINT AS chunks FROM dim WHERE docket IS NOT NULL"


@query(f"WITH {DIM} {COVERAGE} GROUP BY docket")
def docket_coverage(spark, d):
    return marts.docket_coverage(_dim(spark, d))


@query(f"WITH {DIM} {COVERAGE} AND chunk_config_version = 'v1-aaaaaaaaaaaa' GROUP BY docket")
def docket_coverage_of_version(spark, d):
    return marts.docket_coverage(_dim(spark, d), "v1-aaaaaaaaaaaa")


@query(f"""WITH {SILVER}, landed AS (SELECT run_id, count(*) AS landed, sum(bytes)::BIGINT AS bytes, max(fetched_at) AS fetched_at FROM manifest GROUP BY 1),
outcome AS (SELECT m.run_id, count(DISTINCT CASE WHEN s.status = 'ok' THEN s.record_key END) AS parsed_ok, count(DISTINCT CASE WHEN s.status = 'duplicate' THEN s.record_key END) AS duplicates,
  count(DISTINCT CASE WHEN s.status = 'quarantined' THEN s.record_key END) AS quarantined FROM manifest m LEFT JOIN silver s USING (record_key) GROUP BY 1)
SELECT l.*, o.* EXCLUDE (run_id), landed - parsed_ok - duplicates - quarantined AS pending_silver, round(quarantined / nullif(landed, 0)::DOUBLE, 4) AS quarantine_rate FROM landed l JOIN outcome o USING (run_id)""")
def pipeline_health(spark, d):
    rows = silver_rows(spark, d)
    return marts.pipeline_health(manifest(spark, d), accepted(rows), quarantine(rows))


@query(f"WITH {SILVER} SELECT q.record_key, q.stage, m.title FROM silver q LEFT JOIN manifest m USING (record_key) WHERE q.status = 'quarantined'")
def quarantine_with_titles(spark, d):
    return marts.with_titles(quarantine(silver_rows(spark, d)).select("record_key", "stage"), manifest(spark, d))


@query(f"WITH {SILVER} SELECT record_key, title, published_at FROM silver WHERE status = 'ok' AND (contains(lower(title), 'eb-2025-001') OR contains(lower(coalesce(docket, '')), 'eb-2025-001')) ORDER BY published_at DESC, record_key LIMIT 50")
def document_search(spark, d):
    return marts.document_search(silver_rows(spark, d), "EB-2025-001", 50).select("record_key", "title", "published_at")


# data-quality tests: the rows that break a rule
@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL")
def dq_not_null(spark, d):
    return quality.not_null(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left"), "quality").select("doc_id")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def dq_unique(spark, d):
    return quality.unique(table(spark, d, "lineitem"), "l_orderkey")


@query("SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dq_unique_combination(spark, d):
    return quality.unique(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def dq_accepted_values(spark, d):
    return quality.accepted_values(table(spark, d, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def dq_relationships(spark, d):
    return quality.relationship(table(spark, d, "documents").select("doc_id"), "doc_id", table(spark, d, "labels"), "doc_id")


@query("SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(p_name, '^[a-m]')")
def dq_regex(spark, d):
    return quality.matches_regex(table(spark, d, "part"), "p_name", "^[a-m]").select("p_partkey", "p_name")


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL AND lang = 'fr'")
def dq_conditional_not_null(spark, d):
    return quality.not_null(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left"), "quality", "lang = 'fr'").select("doc_id")


@query(f"WITH {SILVER}, {CHUNKS} SELECT d.doc_id, v.chunk_config_version FROM silver d CROSS JOIN (SELECT DISTINCT chunk_config_version FROM chunks) v LEFT JOIN chunks c ON c.doc_id = d.doc_id AND c.chunk_config_version = v.chunk_config_version WHERE d.status = 'ok' GROUP BY 1, 2 HAVING count(c.chunk_id) = 0")
def dq_docs_without_chunks(spark, d):
    return quality.documents_without_chunks(silver_rows(spark, d), chunks(spark, d))


@query(f"WITH {SILVER}, {CHUNKS} SELECT c.chunk_id FROM chunks c JOIN silver d ON d.doc_id = c.doc_id AND d.status = 'ok' WHERE c.page_start < 1 OR c.page_end < c.page_start OR c.page_end > d.n_pages")
def dq_page_ranges(spark, d):
    return quality.page_ranges(chunks(spark, d), silver_rows(spark, d))


@query(f"WITH {CHUNKS} SELECT chunk_id, chunk_config_version, n_tokens FROM chunks WHERE n_tokens <= 0 OR n_tokens > 100")
def dq_token_bounds(spark, d):
    return chunks(spark, d).where("n_tokens <= 0 OR n_tokens > 100").select("chunk_id", "chunk_config_version", "n_tokens")


@query(f"WITH {SILVER} SELECT text_hash, count(*) AS n FROM silver WHERE status = 'ok' GROUP BY 1 HAVING count(*) > 1")
def dq_ok_text_duplicates(spark, d):
    return quality.unique(silver_rows(spark, d).where("status = 'ok'"), "text_hash")


@query(f"WITH {SILVER} SELECT run_id, round(count(*) FILTER (status = 'quarantined') / count(*)::DOUBLE, 4) AS quarantine_rate FROM silver GROUP BY 1 HAVING round(count(*) FILTER (status = 'quarantined') / count(*)::DOUBLE, 4) > 0.03")
def dq_quarantine_rate(spark, d):
    return silver.outcome(silver_rows(spark, d), "run_id").where("quarantine_rate > 0.03").select("run_id", "quarantine_rate")


@query(f"""WITH {SILVER}, {CHUNKS}, docs AS (SELECT * FROM silver WHERE status <> 'quarantined'), ok AS (SELECT * FROM docs WHERE status = 'ok'),
by_doc AS (SELECT doc_id, max(page_end) AS last, count(*) FILTER (page_start < 1 OR page_end < page_start) AS ranges FROM chunks GROUP BY 1)
SELECT unnest(['record_key is unique', 'one ok document for a text', 'status is known', 'n_pages of ok documents', 'documents have a record', 'chunk ids are unique', 'chunks have a document', 'ok documents have chunks', 'page ranges', 'token bounds']) AS rule,
  unnest([(SELECT count(*) - count(DISTINCT record_key) FROM docs), (SELECT count(*) - count(DISTINCT text_hash) FROM ok), (SELECT count(*) FROM docs WHERE status NOT IN ('ok', 'duplicate')), (SELECT count(*) FROM ok WHERE n_pages IS NULL),
  (SELECT count(*) FROM docs WHERE record_key NOT IN (SELECT record_key FROM manifest WHERE NOT bad)), (SELECT count(*) FROM (SELECT 1 FROM chunks GROUP BY chunk_config_version, chunk_id HAVING count(*) > 1)),
  (SELECT count(*) FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM docs)), (SELECT count(*) FROM ok WHERE doc_id NOT IN (SELECT doc_id FROM chunks)), (SELECT count(*) FROM ok JOIN by_doc b USING (doc_id) WHERE b.ranges > 0 OR b.last > n_pages),
  (SELECT count(*) FROM chunks WHERE n_tokens <= 0 OR n_tokens > 100)])::BIGINT AS broken""")
def dq_suite(spark, d):
    """All rules of the silver tables in one pass over each, as the gate of a run has them."""
    rows = materialize(silver_rows(spark, d).where("status <> 'quarantined'").select("doc_id", "record_key", "text_hash", "status", "n_pages"), "silver")
    return quality.suite(rows, chunks(spark, d), manifest(spark, d).where("NOT bad").select("record_key"), 100)


# checks of a landed batch
@query("SELECT doc_id FROM (SELECT *, CASE WHEN doc_id % 13 = 0 THEN '' ELSE lang END AS kind FROM documents) WHERE source IS NULL OR kind IS NULL OR kind = ''")
def val_required(spark, d):
    rows = table(spark, d, "documents").withColumn("kind", F.when(F.col("doc_id") % 13 == 0, "").otherwise(F.col("lang")))
    return rows.where(quality.required_fields(["source", "kind"])).select("doc_id")


@query("SELECT source, source_id, landed FROM (SELECT source, (doc_id % 400)::VARCHAR AS source_id, doc_id AS landed FROM documents) QUALIFY row_number() OVER (PARTITION BY source, source_id ORDER BY landed) > 1")
def val_unique_ids(spark, d):
    rows = table(spark, d, "documents").select("source", (F.col("doc_id") % 400).cast("string").alias("source_id"), F.col("doc_id").alias("landed"))
    return quality.repeated_ids(rows, ["landed"])


@query("SELECT doc_id FROM documents WHERE doc_id % 17 = 0")
def val_hash_integrity(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.when(F.col("doc_id") % 34 == 0, None).when(F.col("doc_id") % 17 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))
    return rows.where(quality.hash_differs()).select("doc_id")


@query("SELECT page_id FROM pages WHERE page_id % 3 = 0 OR NOT starts_with(ltrim(html, chr(32) || chr(9) || chr(10) || chr(13)), '<')")
def val_signature(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, "pdf").otherwise("html").alias("extension"), F.substring("html", 1, 1024).alias("head"))
    return rows.where(quality.signature_differs()).select("page_id")


@query(f"WITH {MANIFEST} SELECT record_key, bytes FROM manifest WHERE NOT (bytes BETWEEN 1024 AND 20000)")
def val_size_bounds(spark, d):
    return manifest(spark, d).where(quality.size_outside(1024, 20_000)).select("record_key", "bytes")


@query(f"WITH {MANIFEST} SELECT record_key, bytes, size_hint FROM manifest WHERE size_hint <> 0 AND size_hint <> bytes")
def val_size_hint(spark, d):
    return manifest(spark, d).where(quality.size_differs()).select("record_key", "bytes", "size_hint")


@query("SELECT n_ok, n_err, round(n_err / (n_ok + n_err)::DOUBLE, 6) AS rate, n_err / (n_ok + n_err)::DOUBLE <= 0.2 AS passed FROM (SELECT count(*) FILTER (event_type <> 'error') AS n_ok, count(*) FILTER (event_type = 'error') AS n_err FROM events)")
def val_fetch_error_rate(spark, d):
    counts = table(spark, d, "events").agg(F.count_if(F.col("event_type") != "error").alias("n_ok"), F.count_if(F.col("event_type") == "error").alias("n_err"))
    return quality.fetch_error_rate(counts)


@query(f"WITH {MANIFEST} SELECT max(published_at) AS newest, datediff('day', max(published_at)::DATE, DATE '2026-04-10')::BIGINT AS age_days, datediff('day', max(published_at)::DATE, DATE '2026-04-10') <= 14 AS passed FROM manifest")
def val_freshness(spark, d):
    return quality.freshness(manifest(spark, d), F.lit("2026-04-10").cast("date")).withColumn("age_days", F.col("age_days").cast("long"))


@query("""WITH reports AS (SELECT strftime(ts, '%Y-%m-%d') AS run_id, count(*) AS listed FROM events GROUP BY 1)
SELECT run_id, listed, count(nullif(listed, 0)) OVER w AS n_before, round(avg(nullif(listed, 0)) OVER w, 6) AS mean_before, count(nullif(listed, 0)) OVER w < 3 OR listed >= avg(nullif(listed, 0)) OVER w * 0.95 AS passed
FROM reports WINDOW w AS (ORDER BY run_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""")
def val_volume_trailing(spark, d):
    runs = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("run_id")).agg(F.count("*").alias("listed"))
    return quality.volume(runs.withColumn("validated_at", F.col("run_id")), 0.95).drop("validated_at")


def _batch(spark, d):
    """Every record, as one batch."""
    return manifest(spark, d).withColumn("content", F.col("text"))


def _report(spark, d):
    """The batch after a report for each day of events."""
    reports = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("run_id")).agg((F.count("*") * 1000).alias("listed")).withColumn("validated_at", F.col("run_id"))
    batch = _batch(spark, d)
    return quality.batch_report(batch, ["record_key"], F.lit("2026-04-10").cast("date"), fetch_errors=2, reports=reports, listed=batch.count())


REPORT = f"""{MANIFEST}, b AS (SELECT * FROM manifest),
sig AS (SELECT record_key FROM b WHERE extension = 'pdf' AND NOT starts_with(text, '%PDF-')), small AS (SELECT record_key FROM b WHERE NOT bytes BETWEEN 1024 AND 52428800), hint AS (SELECT record_key FROM b WHERE size_hint <> 0 AND size_hint <> bytes),
days AS (SELECT strftime(ts, '%Y-%m-%d') AS run_id, count(*) * 1000 AS listed FROM events GROUP BY 1), last_days AS (SELECT listed FROM days ORDER BY run_id DESC LIMIT 10),
report AS (SELECT *, n_failed = 0 AS passed FROM (VALUES ('required_fields_not_null', 'error', 0), ('unique_source_id', 'error', 0), ('object_hash_matches_manifest', 'error', 0),
('file_signature_matches_extension', 'warn', (SELECT count(*) FROM sig)), ('size_within_bounds', 'warn', (SELECT count(*) FROM small)), ('download_size_matches_source', 'warn', (SELECT count(*) FROM hint)),
('fetch_error_rate', 'error', (SELECT CASE WHEN 2 > 0.2 * (count(*) + 2) THEN 1 ELSE 0 END FROM b)), ('freshness', 'warn', 0),
('volume_vs_trailing', 'warn', (SELECT CASE WHEN count(*) < 3 OR (SELECT count(*) FROM b) >= 0.3 * avg(listed) THEN 0 ELSE 1 END FROM last_days))) t(name, severity, n_failed))"""


@query(f"WITH {REPORT} SELECT * FROM report")
def val_report(spark, d):
    return _report(spark, d)


@query(f"WITH {REPORT} SELECT CASE WHEN bool_or(NOT passed AND severity = 'error') THEN 'failed' WHEN bool_or(NOT passed) THEN 'warn' ELSE 'passed' END AS status FROM report")
def val_status(spark, d):
    return quality.batch_status(_report(spark, d))


@query(f"WITH {REPORT} SELECT record_key FROM sig UNION SELECT record_key FROM small UNION SELECT record_key FROM hint")
def val_quarantine(spark, d):
    return quality.to_quarantine(_batch(spark, d), ["record_key"])


# incremental work
@query(f"WITH {SILVER} SELECT record_key FROM manifest WHERE record_key NOT IN (SELECT record_key FROM silver WHERE run_id <> 'run-6')")
def incremental_todo(spark, d):
    done = silver_rows(spark, d).where("run_id <> 'run-6'")
    return silver.todo(manifest(spark, d), accepted(done), quarantine(done)).select("record_key")


@query(f"WITH {SILVER} SELECT record_key FROM manifest WHERE record_key NOT IN (SELECT record_key FROM silver WHERE run_id <> 'run-6') ORDER BY record_key LIMIT 25")
def incremental_todo_limited(spark, d):
    done = silver_rows(spark, d).where("run_id <> 'run-6'")
    return silver.todo(manifest(spark, d), accepted(done), quarantine(done), 25).select("record_key")


@query(f"WITH {SILVER}, {RAW_CHUNKS} SELECT doc_id FROM silver WHERE status = 'ok' AND doc_id NOT IN (SELECT doc_id FROM raw_chunks WHERE chunk_config_version = 'v2-bbbbbbbbbbbb')")
def rechunk_missing(spark, d):
    return silver.missing_in_version(silver_rows(spark, d), raw_chunks(spark, d), "v2-bbbbbbbbbbbb").select("doc_id")


@query("SELECT source, k, min(doc_id) AS doc_id FROM (SELECT source, doc_id % 300 AS k, doc_id FROM documents) WHERE k NOT IN (SELECT doc_id % 300 FROM labels WHERE quality = 1 AND doc_id < 100) GROUP BY ALL")
def manifest_new_keys(spark, d):
    docs = table(spark, d, "documents").select("source", (F.col("doc_id") % 300).alias("k"), "doc_id")
    seen = table(spark, d, "labels").where("quality = 1 AND doc_id < 100").select((F.col("doc_id") % 300).alias("k"))
    return silver.latest(docs.join(seen, "k", "left_anti"), ["source", "k"], [F.asc("doc_id")]).select("source", "k", "doc_id")


@query("SELECT k, min(doc_id) AS doc_id FROM (SELECT doc_id % 300 AS k, doc_id FROM documents WHERE doc_id % 300 NOT IN (SELECT doc_id % 300 FROM labels WHERE doc_id < 100)) GROUP BY k")
def insert_only_merge(spark, d):
    docs = table(spark, d, "documents").select((F.col("doc_id") % 300).alias("k"), "doc_id")
    present = table(spark, d, "labels").where("doc_id < 100").select((F.col("doc_id") % 300).alias("k")).distinct()
    return registry.upsert(present, silver.latest(docs, ["k"], [F.asc("doc_id")]), ["k"])


@query("SELECT d.doc_id, coalesce(l.quality, d.n_chars)::BIGINT AS v FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN n_chars END AS n_chars FROM documents) d LEFT JOIN labels l ON l.doc_id = d.doc_id AND d.n_chars IS NULL")
def ordinal_backfill(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")).alias("v"))
    return silver.backfill(rows, table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("v")), "doc_id", "v")


REGISTRY = "registry AS (SELECT 'v' || label AS index_version, count(*) AS n_chunks FROM embeddings GROUP BY 1)"


@query(f"WITH {REGISTRY} SELECT index_version, index_version = 'v3' AS is_active, CASE WHEN index_version = 'v3' THEN '2026-05-01' END AS activated_at, n_chunks FROM registry")
def index_registry_activate(spark, d):
    rows = table(spark, d, "embeddings").select(F.concat(F.lit("v"), "label").alias("index_version"))
    known = rows.distinct().select("index_version", F.lit(False).alias("is_active"), F.lit(None).cast("string").alias("activated_at"))
    return registry.activate(registry.refresh_counts(registry.ensure_version(known.where("index_version <> 'v1'"), known), rows), "v3", F.lit("2026-05-01"))


@query("SELECT status, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM (SELECT o_orderstatus AS status, o_custkey FROM orders) GROUP BY 1")
def status_counts(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))
