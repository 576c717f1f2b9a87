"""Writes are idempotent; routing, listings, streams and registry on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from docstrata.operators import quality, registry, retrieval, silver
from docstrata.sources import lake as lakes
from docstrata.sources import listings
from docstrata.streaming import feed


@pytest.fixture
def lake(spark, tmp_path):
    return lakes.Lake(spark, str(tmp_path / "lake"))


def manifest(spark, rows):
    df = spark.createDataFrame(rows, "source_id string, text string")
    return df.withColumn("source", F.lit("s")).withColumn("record_key", F.concat_ws(":", "source", "source_id")).withColumn("sha256", F.sha2("text", 256))


def test_append_replaces_a_run_and_keeps_others(spark, lake):
    one = spark.createDataFrame([("k1", "r1"), ("k2", "r1")], "record_key string, run_id string")
    fill = lambda df: df.select(*(F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in lakes.SCHEMAS["silver/quarantine"]))
    assert lake.read("silver/quarantine").count() == 0
    lake.append("silver/quarantine", fill(one))
    lake.append("silver/quarantine", fill(one.limit(1).withColumn("run_id", F.lit("r2"))))
    lake.append("silver/quarantine", fill(one))
    assert lake.read("silver/quarantine").count() == 3
    lake.merge("silver/quarantine", fill(spark.createDataFrame([("k2", "r3"), ("k9", "r3"), ("k9", "r3")], "record_key string, run_id string")), ["record_key"])
    assert sorted(r[0] for r in lake.read("silver/quarantine", "record_key").collect()) == ["k1", "k1", "k2", "k9"]
    assert lake.sql("SELECT count(*) AS n FROM silver_quarantine WHERE run_id = :r", ["silver/quarantine"], r="r1").first().n == 2


def test_routing_order_and_second_run(spark):
    long = "word " * 60
    rows = [("1", long), ("2", long), ("3", long.upper()), ("4", "short"), ("5", "<html>" + long), ("6", "other " * 60)]
    routed = silver.route(manifest(spark, rows), spark.createDataFrame([("s:5",)], "record_key string"))
    got = {r.source_id: (r.status, r.duplicate_of, r.stage) for r in routed.collect()}
    assert got == {"1": ("ok", None, None), "2": ("duplicate", "s:1", None), "3": ("duplicate", "s:1", None), "4": ("quarantined", None, "parse"), "5": ("quarantined", None, "bronze_validation"), "6": ("ok", None, None)}
    assert silver.todo(manifest(spark, rows), routed.where("status <> 'quarantined'"), routed.where("status = 'quarantined'")).count() == 0
    later = silver.route(manifest(spark, [("0", long.replace("w", "W"))]), spark.createDataFrame([], "record_key string"), existing=routed)
    assert [(r.status, r.duplicate_of) for r in later.collect()] == [("duplicate", "s:1")]


def test_land_stores_bytes_once(spark):
    rows = spark.createDataFrame([("s", "1", bytearray(b"a"), "pdf"), ("s", "2", bytearray(b"a"), "pdf"), ("s", "3", bytearray(b"b"), "htm")], "source string, source_id string, content binary, extension string")
    got = {r.source_id: (r.object_uri, r.duplicate_of) for r in lakes.land(rows, "r", "2026-01-01").collect()}
    assert got["2"] == (got["1"][0], got["1"][0]) and got["1"][1] is None and got["3"][0].endswith(".htm")


def test_listing_source_and_decoding(spark, tmp_path):
    hit = {"Uri": 955586, "RecordTitle": {"Value": "PO2_EB-2026-0123"}, "RecordExtension": {"Value": "PDF"}, "RecordDocumentSize": {"Value": 238904}, "RecordDateCreated": {"IsClear": False, "DateTime": "2026-09-14T16:35:05.0000000Z"}, "RecordDateRegistered": {"IsClear": True, "DateTime": "x"}, "RecordRecordType": {"RecordTypeName": {"Value": "Order"}}}
    (tmp_path / "p1.json").write_text(json.dumps({"Results": [hit]}))
    listings.register(spark)
    r = listings.decode_hits(spark.read.format("listing").load(str(tmp_path / "*.json")), "https://example.org/").first()
    assert (r.source_id, r.published_at, r.registered_at, r.extension, r.docket, r.size_hint, r.record_type) == ("955586", "2026-09-14T16:35:05Z", None, "pdf", "EB-2026-0123", 238904, "Order")
    assert r.url == "https://example.org/Record/955586/File/document"
    assert listings.search_query("2026-01-01", "2026-01-02", ["PDF", "htm"], "x") == "registeredOn:2026-01-01 to 2026-01-02 and (extension:pdf or extension:htm) and title:x"
    with pytest.raises(ValueError):
        listings.get_source("nope")


def test_stream_is_once_and_drops_what_is_too_late(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz"
    for day, rows in (("1", [(1, "2026-01-10 00:00:00"), (1, "2026-01-10 00:00:00")]), ("2", [(2, "2026-01-13 00:00:00")]), ("3", [(3, "2026-01-12 12:00:00"), (4, "2026-01-01 00:00:00"), (2, "2026-01-13 00:00:00")])):
        spark.createDataFrame([(i, t) for i, t in rows], "event_id long, t string").selectExpr("event_id", "cast(t AS timestamp_ntz) AS ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    del day
    stream = feed.read_files(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, "*.parquet", files_per_batch=1)
    got = sorted(r.event_id for r in feed.drain(feed.once_each(stream, "event_id", "ts"), str(tmp_path / "s")).collect())
    assert got.count(1) == 1 and got.count(2) == 1 and {1, 2, 3} <= set(got)


def test_resume_window(spark):
    row = spark.range(1).select(
        feed.resume_since(F.lit("2026-01-10T05:00:00Z"), F.lit("2026-02-01").cast("date")).cast("string").alias("a"),
        feed.resume_since(F.lit(None).cast("string"), F.lit("2026-02-01").cast("date")).cast("string").alias("b"),
        feed.resume_since(F.lit("2026-01-10"), F.lit("2026-02-01").cast("date"), F.lit("2025-01-01").cast("date")).cast("string").alias("c"),
    ).first()
    assert tuple(row) == ("2026-01-09", "2026-01-25", "2025-01-01")


def test_registry(spark):
    rows = spark.createDataFrame([("a", True, "x", 1), ("b", False, None, 1)], "index_version string, is_active boolean, activated_at string, n_chunks long")
    got = {r.index_version: r.is_active for r in registry.activate(rows, "b", F.lit("now")).collect()}
    assert got == {"a": False, "b": True}
    with pytest.raises(Exception, match="unknown index version"):
        registry.activate(rows, "zzz", F.lit("now")).collect()


def test_volume_and_report(spark):
    runs = spark.createDataFrame([(f"r{i}", f"2026-01-{i:02d}", n) for i, n in enumerate([10, 0, 10, 10, 10, 2], 1)], "run_id string, validated_at string, listed long")
    got = {r.run_id: r.passed for r in quality.volume(runs).collect()}
    assert got == {"r1": True, "r2": True, "r3": True, "r4": True, "r5": True, "r6": False}


def test_neighbours_are_not_hits_and_come_in_order(spark):
    chunks = spark.createDataFrame([("d", i, f"c{i}", "text" if i != 4 else "table", f"line{i}\nshared", i + 1, i + 1) for i in range(6)], "doc_id string, ordinal long, chunk_id string, chunk_type string, text string, page_start long, page_end long")
    hits = chunks.where("ordinal IN (1, 3)")
    got = {r.ordinal: r for r in retrieval.expand(hits, chunks).collect()}
    assert got[1].context_text == "line0\nline1\nshared\nline2" and (got[1].page_start, got[1].page_end) == (1, 3)
    assert got[3].context_text == "line2\nline3\nshared" and (got[3].page_start, got[3].page_end) == (3, 4)
    assert {r.context_text for r in retrieval.expand(hits, chunks, 0).collect()} == {"line1\nshared", "line3\nshared"}


def test_rare_terms_find_what_vectors_blur(spark):
    chunks = spark.createDataFrame([(i, "rate order decision" + (" stelco" if i == 7 else "")) for i in range(40)], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "what did Stelco order?")], "query_id long, qtext string")
    rare = retrieval.rare_terms(asked, retrieval.document_frequency(chunks), 40)
    assert [r.term for r in rare.collect()] == ["stelco"]
    assert [r.chunk_id for r in retrieval.bm25_top(chunks, rare.select("query_id", "term"), 5).collect()] == [7]


def test_extractive_answer(spark):
    docs = spark.createDataFrame([(1, "when was the rate order issued", 1, "The rate order was issued in May 2024. Nothing else.\nOther text of some length here."), (1, "when was the rate order issued", 2, "A rate was discussed at length; no."), (2, "zebra", 1, "nothing fits here at all, sorry")], "query_id long, qtext string, n int, context_text string")
    got = {r.query_id: r for r in retrieval.extractive_answer(docs).collect()}
    assert got[1].answer == "(Extractive answer - no LLM configured.) The rate order was issued in May 2024. [1] A rate was discussed at length; [2]" and got[1].cited == [1, 2]
    assert got[2].answer.startswith("The retrieved filings do not appear") and got[2].cited == []
