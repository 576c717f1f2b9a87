"""Queries of documents to pages to chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from docstrata.functions import text as T
from docstrata.operators import chunking, pages
from docstrata.plans.adapters import query, table
from docstrata.sources import listings


@query()
def html_pages(spark, d):
    files = table(spark, d, "pages").select(F.col("page_id").alias("key"), F.col("html").alias("content"), F.when(F.col("page_id") % 10 == 0, "pdf").otherwise("html").alias("extension"))
    return pages.parse_files(files).select("key", "page_no", "text", "error")


def _pseudo_pages(spark, d):
    """Documents cut into pages of six lines with a head and a foot line."""
    lines = table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    numbers = F.sequence(F.lit(0), F.floor((F.size("l") - 1) / 6).cast("int"))
    cut = lines.select("doc_id", "l", F.explode(numbers).alias("p"))
    body = F.array_join(F.slice("l", F.col("p") * 6 + 1, F.lit(6)), "\n")
    text = F.concat(F.lit("Report  "), F.col("doc_id"), F.lit("\n"), body, F.lit("\nPage "), F.col("p") + 1)
    return cut.select("doc_id", (F.col("p") + 1).cast("long").alias("page_no"), text.alias("text"))


PSEUDO = r"""src AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), nums AS (SELECT doc_id, l, unnest(range(0, (len(l) - 1) // 6 + 1)) AS p FROM src),
pp AS (SELECT doc_id, p + 1 AS page_no, 'Report  ' || doc_id || chr(10) || array_to_string(l[p * 6 + 1 : p * 6 + 6], chr(10)) || chr(10) || 'Page ' || (p + 1) AS text FROM nums),
pl AS (SELECT doc_id, page_no, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM pp),
keyed AS (SELECT *, i <= 3 OR i > n - 3 AS edge, regexp_replace(regexp_replace(lower(trim(line, chr(32) || chr(9))), '[ \t ]+', ' ', 'g'), '[0-9]+', '#', 'g') AS key FROM pl),
counted AS (SELECT doc_id, key, count(DISTINCT page_no) AS at_pages FROM keyed WHERE edge AND trim(line) <> '' GROUP BY 1, 2),
sizes AS (SELECT doc_id, count(*) AS pages FROM pp GROUP BY 1), running AS (SELECT c.doc_id, c.key FROM counted c JOIN sizes s USING (doc_id) WHERE s.pages >= 3 AND c.at_pages >= greatest(2, floor(s.pages * 0.5)))"""


@query(f"WITH {PSEUDO} SELECT k.doc_id, k.page_no, coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (NOT (k.edge AND r.key IS NOT NULL)), '') AS text FROM keyed k LEFT JOIN running r ON r.doc_id = k.doc_id AND r.key = k.key GROUP BY 1, 2")
def running_lines(spark, d):
    return pages.strip_running_lines(_pseudo_pages(spark, d))


def sql_upper(text: str) -> str:
    """A sharp s has no capital of its own there."""
    return f"replace(upper({text}), 'ß', 'SS')"


def sql_headings(lines: str) -> str:
    """Tables over ``lines`` (with a text): the last one, ``judged``, tells which are headings."""
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    share = lambda keep: f"len(list_filter(words, lambda w: {keep})) / len(words)"
    return rf"""trimmed AS (SELECT *, regexp_replace(text, '^[\s\v\x{{85}}\p{{Z}}]+|[\s\v\x{{85}}\p{{Z}}]+$', '', 'g') AS s FROM {lines}),
parts AS (SELECT *, regexp_extract(s, {quoted(T.NUMBERED)}, 1) AS number, regexp_extract(s, {quoted(T.NUMBERED)}, 2) AS title FROM trimmed),
cut AS (SELECT *, regexp_extract_all(title, '[A-Za-z][A-Za-z''’\-]*') AS words, regexp_matches(title, '\p{{L}}') AND {sql_upper('title')} = title AS loud_title, regexp_matches(s, '\p{{L}}') AND {sql_upper('s')} = s AS loud FROM parts),
judged AS (SELECT *, coalesce(length(s) BETWEEN 4 AND 100 AND NOT regexp_matches(s, {quoted(T.NOT_HEADING)}) AND CASE WHEN number <> '' THEN
  len(words) BETWEEN 1 AND 12 AND NOT regexp_matches(title, '[.,;]\s*$') AND length(title) - length(replace(title, ',', '')) <= 2
  AND ({share('upper(w) = w AND length(w) > 1')} >= 0.7 OR ({share(f"regexp_matches(w, '^[A-Z]') OR list_contains({listed(T.SMALL_WORDS)}, lower(w))")} >= 0.8 AND regexp_matches(words[1], '^[A-Z]')))
  AND (regexp_matches(number, '^\d') OR loud_title)
  ELSE loud AND length(regexp_replace(s, '[^\p{{L}}]', '', 'g')) >= 6 AND len(regexp_extract_all(s, '[^\s\v\x{{85}}\p{{Z}}]+')) <= 10 AND NOT regexp_matches(s, '\d{{4}}')
  AND list_has_any(list_transform(regexp_extract_all(s, '[A-Za-z]+'), lambda w: lower(w)), {listed(T.HEADING_WORDS)}) END, false) AS heading FROM cut)"""


@query(f"""WITH whole AS (SELECT doc_id, string_split('1. Summary of Findings' || chr(10) || {sql_upper('substr(text, 1, 40)')} || chr(10) || text || chr(10) || 'DECISION AND ORDER', chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line, unnest(l) AS text FROM whole), {sql_headings('lines')} SELECT doc_id, line, text FROM judged WHERE heading""")
def headings(spark, d):
    """Lines that are section headings, among lines made from documents and fixed samples."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.concat_ws("\n", F.lit("1. Summary of Findings"), F.upper(F.substring("text", 1, 40)), "text", F.lit("DECISION AND ORDER")), "\n")).alias("line", "text"))
    return lines.where(T.is_heading(F.col("text"))).select("doc_id", F.col("line").cast("long").alias("line"), "text")


@query()
def chunk_greedy(spark, d):
    """Versioned chunks with overlap and sections; every third line group has a heading before it."""
    docs = table(spark, d, "documents").select("doc_id", F.concat_ws("\n", F.lit("1. First Findings"), "text", F.lit("2. Closing Order"), F.substring("text", 1, 400)).alias("text"))
    return chunking.chunk_lines(docs, chunking.Chunking(max_tokens=120, overlap_tokens=20))


@query()
def chunk_pages_sql(spark, d):
    """The same chunks by a table function in SQL; tests hold the two against each other."""
    from docstrata.sources import table_functions

    table_functions.register(spark, chunking.Chunking(max_tokens=120, overlap_tokens=20))
    docs = table(spark, d, "documents").select("doc_id", F.lit(1).alias("page_no"), F.concat_ws("\n", F.lit("1. First Findings"), "text", F.lit("2. Closing Order"), F.substring("text", 1, 400)).alias("text"))
    pages.with_headings(docs).select("doc_id", "page_no", "text", "headings").createOrReplaceTempView("pages_to_chunk")
    return spark.sql("SELECT * FROM chunk_pages(TABLE(pages_to_chunk) PARTITION BY doc_id ORDER BY page_no)")


ORDER_TABLES = r"""WITH RECURSIVE lines AS (SELECT o_custkey::VARCHAR AS doc_id, '| ' || o_orderkey || ' | ' || o_orderpriority || ' | ' || o_totalprice || ' |' AS line, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
counted AS (SELECT *, len(regexp_extract_all(line, '\S+')) AS n FROM lines),
packed AS (SELECT doc_id, i, line, 0 AS part, 8 + n AS total FROM counted WHERE i = 1
  UNION ALL SELECT c.doc_id, c.i, c.line, p.part + (p.total + c.n > 100)::INT, CASE WHEN p.total + c.n > 100 THEN 8 + c.n ELSE p.total + c.n END FROM packed p JOIN counted c ON c.doc_id = p.doc_id AND c.i = p.i + 1)
SELECT doc_id, '{version}' AS chunk_config_version, part AS ordinal, 'table' AS chunk_type, NULL::VARCHAR AS section, 1 AS page_start, 1 AS page_end, max(total)::INT AS n_tokens,
  '| key | priority | price |' || chr(10) || '|---|---|---|' || chr(10) || string_agg(line, chr(10) ORDER BY i) AS text FROM packed GROUP BY doc_id, part"""


@query(ORDER_TABLES.format(version=chunking.Chunking(max_table_tokens=100).version))
def chunk_tables(spark, d):
    """Table chunks of each customer's orders: the head repeats, rows that are too long are cut."""
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "o_totalprice"))).alias("r"))
    body = F.transform("r", lambda x: F.concat(F.lit("| "), F.concat_ws(" | ", x["o_orderkey"], x["o_orderpriority"], x["o_totalprice"]), F.lit(" |")))
    md = F.array_join(F.concat(F.array(F.lit("| key | priority | price |"), F.lit("|---|---|---|")), body), "\n")
    one = rows.select("doc_id", F.lit(1).alias("page_no"), F.lit("").alias("text"), F.expr("cast(array() AS array<struct<line:int,heading:string>>)").alias("headings"), F.array(md).alias("tables"))
    return chunking.chunk_pages(one, chunking.Chunking(max_table_tokens=100))


@query(r"SELECT doc_id, unnest(list_transform(range(0, (len(w) + 49) // 50), lambda i: trim(array_to_string(w[i * 50 + 1 : i * 50 + 50], ''), chr(32) || chr(9) || chr(10) || chr(13)))) AS slice FROM (SELECT doc_id, regexp_extract_all(text, '\s*\S+') AS w FROM documents)")
def token_slices(spark, d):
    words = F.regexp_extract_all("text", F.lit(r"(?U)\s*\S+"), F.lit(0))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 50).cast("int")), lambda i: F.regexp_replace(F.array_join(F.slice("w", i * 50 + 1, F.lit(50)), ""), r"(?U)^\s+|\s+$", ""))
    return table(spark, d, "documents").select("doc_id", words.alias("w")).where(F.size("w") > 0).select("doc_id", F.explode(cut).alias("slice"))


@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) > 300 THEN 'long' ELSE 'short' END AS kind FROM documents")
def payload_decode(spark, d):
    """Typed rows from a JSON payload by kind."""
    kind = F.when(F.octet_length("text") > 300, "long").otherwise("short")
    payload = table(spark, d, "documents").select(kind.alias("kind"), F.to_json(F.struct("doc_id")).alias("payload"))
    return payload.select("kind", F.from_json("payload", "doc_id bigint").alias("p")).select("p.doc_id", "kind")


@query("SELECT 'edgar' AS source, user_id || '-' || event_id || '/' || event_type || '.HTM' AS source_id, strftime(ts, '%Y-%m-%d') || 'T00:00:00Z' AS published_at, 'htm' AS extension, event_type AS record_type FROM events WHERE strftime(ts, '%Y-%m-%d') BETWEEN '2024-01-05' AND '2024-01-20' AND event_type IN ('click', 'purchase')")
def struct_of_arrays_listing(spark, d):
    """A feed of parallel arrays for each user."""
    at = lambda c: F.transform("r", lambda x: c(x))
    rows = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")))).alias("r"))
    recent = F.struct(
        at(lambda x: F.concat_ws("-", F.col("user_id"), x["event_id"])).alias("accessionNumber"),
        at(lambda x: x["event_type"]).alias("form"),
        at(lambda x: x["day"]).alias("filingDate"),
        at(lambda x: F.concat(x["event_type"], F.lit(".HTM"))).alias("primaryDocument"),
    )
    feed = F.to_json(F.struct(F.concat(F.lit("Company "), "user_id").alias("name"), F.struct(recent.alias("recent")).alias("filings")))
    raw = rows.select(F.col("user_id").cast("string").alias("cik"), feed.alias("feed"))
    return listings.decode_feed(raw, "https://example.org/archive", "2024-01-05", "2024-01-20", ["click", "purchase"]).select("source", "source_id", "published_at", "extension", "record_type")


HITS = "SELECT doc_id::VARCHAR AS source_id, 'Notice_EB-2026-' || lpad((doc_id % 10000)::VARCHAR, 4, '0') AS title, 'https://example.org/Record/' || doc_id || '/File/document' AS url, CASE WHEN doc_id % 4 > 0 THEN strftime(DATE '2026-01-01' + (doc_id % 200)::INTEGER, '%Y-%m-%d') || 'T10:00:00Z' END AS registered_at, 'pdf' AS extension, 'EB-2026-' || lpad((doc_id % 10000)::VARCHAR, 4, '0') AS docket, n_chars AS size_hint FROM documents"


def _hits(spark, d):
    n = F.col("doc_id")
    value = lambda c: F.struct(c.alias("Value"))
    day = F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (n % 200).cast("int")), "yyyy-MM-dd")
    hit = F.struct(
        n.alias("Uri"),
        value(F.concat(F.lit("Notice_EB-2026-"), F.lpad((n % 10000).cast("string"), 4, "0"))).alias("RecordTitle"),
        value(F.lit("PDF")).alias("RecordExtension"),
        value(F.col("n_chars")).alias("RecordDocumentSize"),
        F.struct((n % 4 == 0).alias("IsClear"), F.concat(day, F.lit("T10:00:00.0000000Z")).alias("DateTime")).alias("RecordDateRegistered"),
    )
    return listings.decode_hits(table(spark, d, "documents").select(F.to_json(hit).alias("hit")), "https://example.org/")


@query(HITS)
def search_hit_decode(spark, d):
    return _hits(spark, d).select("source_id", "title", "url", "registered_at", "extension", "docket", "size_hint")


@query(f"SELECT source_id, registered_at FROM ({HITS}) WHERE substr(registered_at, 1, 10) BETWEEN '2026-02-01' AND '2026-03-01' ORDER BY registered_at, source_id LIMIT 40")
def listing_window(spark, d):
    return listings.listed(_hits(spark, d), "2026-02-01", "2026-03-01", 40).select("source_id", "registered_at")
