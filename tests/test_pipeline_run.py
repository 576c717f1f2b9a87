"""The whole run on a fixture of four records, twice, then in a second chunk version."""

import pytest
from pyspark.sql import functions as F

from docstrata.config import interpolate, resolve, settings
from docstrata.operators.chunking import Chunking
from docstrata.plans.pipeline import GateError, Pipeline
from docstrata.sources.lake import Lake

NOW = "2026-03-01T00:00:00Z"


def page(title, n):
    return f"<html><h1>{title}</h1><p>1. Summary of Findings</p>" + "".join(f"<p>{title} sentence {chr(97 + i % 26)}{chr(97 + i // 26)} about the rate order.</p>" for i in range(n)) + "</html>"


def listed(spark, *more):
    decision = page("Decision EB-2026-0015 Stelco", 80)
    rows = [("1001", decision, "html"), ("1002", page("Procedural order", 30), "html"), ("1003", decision, "html"), ("1004", page("Broken download", 30), "pdf"), ("1005", page("tiny", 1) + "<!--" + "x" * 2000 + "-->", "html"), *more]
    df = spark.createDataFrame(rows, "source_id string, html string, extension string")
    names = "title url published_at registered_at".split()
    made = df.select(F.lit("oeb").alias("source"), "source_id", "extension", F.col("html").cast("binary").alias("content"), F.concat(F.lit("T"), "source_id").alias("title"), F.lit("u").alias("url"), F.lit("2026-02-25").alias("published_at"), F.concat(F.lit("2026-02-26T0"), F.col("source_id").substr(4, 1)).alias("registered_at"))
    for c in "record_number record_type docket content_type extra_json".split():
        made = made.withColumn(c, F.lit(None).cast("string"))
    assert set(names) <= set(made.columns)
    return made.withColumn("size_hint", F.lit(None).cast("long"))


def test_run_twice_and_rechunk(spark, tmp_path):
    p = Pipeline(Lake(spark, str(tmp_path / "lake")), chunking=Chunking(max_tokens=60, overlap_tokens=10, min_tokens=5))
    first = p.run(listed(spark), "run-1", NOW)
    assert first["bronze"] == {"status": "warn", "listed": 5, "landed": 5}
    made = first["silver"]
    assert (made["documents_ok"], made["duplicates"], made["quarantined"]) == (2, 1, 2) and made["chunks"] == first["indexed"] > 4
    why = {r.record_key: (r.stage, r.reason) for r in p.lake.read("silver/quarantine").collect()}
    assert why["oeb:1004"][0] == "bronze_validation" and why["oeb:1005"][0] == "parse"
    assert p.lake.read("bronze/objects").count() == 4 and p.watermark().first().high_water == "2026-02-26T05"
    assert {r.docket for r in p.lake.read("silver/documents").where("status = 'ok'").collect()} == {"EB-2026-0015", None}
    again = p.run(listed(spark), "run-2", "2026-03-02T00:00:00Z")
    assert again["bronze"]["landed"] == 0 and again["indexed"] == 0 and again["silver"] == {"documents_ok": 0, "duplicates": 0, "quarantined": 0, "chunks": 0}
    other = Chunking(name="v2", max_tokens=30, overlap_tokens=5, min_tokens=5)
    before = p.lake.chunks_of(p.chunking.version).count()
    assert p.rechunk("run-3", "2026-03-03T00:00:00Z", other) > 0 and p.rechunk("run-4", "2026-03-04T00:00:00Z", other) == 0
    assert p.lake.chunks_of(p.chunking.version).count() == before
    health = {r.run_id: r for r in p.health().collect()}
    assert health["run-1"].pending_silver == 0 and health["run-1"].quarantine_rate == 0.4
    asked = spark.createDataFrame([(1, "What did Stelco decide about the rate order?")], "query_id long, qtext string")
    hits = p.search(asked).orderBy("rank").collect()
    assert [h["rank"] for h in hits] == list(range(1, 7)) and "Stelco" in hits[0].context_text
    assert p.answer(asked).first().answer.startswith("(Extractive answer")
    assert p.search(asked, docket="EB-2026-0015").select("doc_id").distinct().count() == 1
    active = [r for r in p.versions().collect() if r.is_active]
    assert len(active) == 1 and active[0].n_chunks == before
    with pytest.raises(ValueError):
        p.activate("nope", NOW)


def test_failed_batches_are_not_published(spark, tmp_path):
    p = Pipeline(Lake(spark, str(tmp_path / "lake")))
    with pytest.raises(GateError):
        p.run(listed(spark, (None, page("no id", 40), "html")), "run-1", NOW)
    assert p.lake.read("bronze/manifest").count() == 0 and p.lake.read("bronze/reports").first().status == "failed"
    assert p.run(listed(spark), "run-2", NOW)["bronze"]["landed"] == 5


def test_command_line(spark, tmp_path):
    from docstrata.cli import main

    listed(spark).drop("record_type", "size_hint").write.parquet(str(tmp_path / "listed"))
    lake = str(tmp_path / "lake")
    (made,) = main([lake, "--run-id", "r1", "run", str(tmp_path / "listed")], spark)
    assert made["silver"]["documents_ok"] == 2
    (version,) = main([lake, "versions"], spark)
    assert main([lake, "activate", version["index_version"]], spark)[0]["is_active"]
    assert "rate order" in main([lake, "ask", "What about the rate order?"], spark)[0]["answer"]
    assert main([lake, "sql", "SELECT count(*) AS n FROM silver_documents", "silver/documents"], spark) == [{"n": 3}]


def test_settings():
    env = {"HOME_DIR": "/h"}
    assert interpolate({"a": ["${HOME_DIR}/x", "${NONE:-d}"], "b": "${secret:s/k:-none}", "c": 3}, env) == {"a": ["/h/x", "d"], "b": "none", "c": 3}
    assert interpolate("${secret:s/k}", env, lambda s, k: f"{s}.{k}") == "s.k"
    with pytest.raises(KeyError):
        interpolate("${MISSING}", env)
    assert settings({"search": {"k": 9}})["search"] == {"k": 9, "candidates": 20, "window": 1}
    assert resolve("x/y", "/r/") == "/r/x/y" and resolve("/a", "/r") == "/a" and resolve("s3://b", "/r") == "s3://b"
