"""One-pass rules against the single tests, runs that become visible at once, merges that read the buckets of their keys."""

import pytest
from pyspark.sql import functions as F

from docstrata.operators import quality
from docstrata.operators.chunking import Chunking
from docstrata.plans import pipeline
from docstrata.plans.pipeline import Pipeline
from docstrata.sources import lake as lakes
from docstrata.sources.lake import Lake
from tests.test_pipeline_run import NOW, listed

DOCS = [("d1", "k1", "h1", "ok", 3), ("d2", "k2", "h2", "ok", 2), ("d3", "k3", "h1", "duplicate", None)]
CHUNKS = [("v1", "c1", "d1", 1, 2, 10), ("v1", "c2", "d1", 3, 3, 5), ("v1", "c3", "d2", 1, 1, 7)]
RULES = ["record_key is unique", "one ok document for a text", "status is known", "n_pages of ok documents", "documents have a record", "chunk ids are unique", "chunks have a document", "ok documents have chunks", "page ranges", "token bounds"]


def frames(spark, docs, chunks, keys):
    return (
        spark.createDataFrame(docs, "doc_id string, record_key string, text_hash string, status string, n_pages int"),
        spark.createDataFrame(chunks, "chunk_config_version string, chunk_id string, doc_id string, page_start int, page_end int, n_tokens int"),
        spark.createDataFrame([(k,) for k in keys], "record_key string"),
    )


def single(docs, chunks, manifest):
    return [
        quality.unique(docs, "record_key"),
        quality.unique(docs.where("status = 'ok'"), "text_hash"),
        quality.accepted_values(docs, "status", ["ok", "duplicate"]),
        quality.not_null(docs, "n_pages", "status = 'ok'"),
        quality.relationship(docs, "record_key", manifest, "record_key"),
        quality.unique(chunks, "chunk_config_version", "chunk_id"),
        quality.relationship(chunks, "doc_id", docs, "doc_id"),
        quality.documents_without_chunks(docs, chunks),
        quality.page_ranges(chunks, docs),
        chunks.where("n_tokens <= 0 OR n_tokens > 100"),
    ]


CASES = {
    "good": (DOCS, CHUNKS, ["k1", "k2", "k3"], []),
    "keys": ([*DOCS, ("d4", "k1", "h9", "duplicate", 1)], CHUNKS, ["k1", "k2"], ["record_key is unique", "documents have a record"]),
    "texts": ([*DOCS, ("d4", "k4", "h2", "ok", None), ("d5", "k5", "h5", "lost", 1)], [*CHUNKS, ("v1", "c9", "d4", 1, 1, 1)], ["k1", "k2", "k3", "k4", "k5"], ["one ok document for a text", "status is known", "n_pages of ok documents"]),
    "chunks": (DOCS, [*CHUNKS, ("v1", "c2", "d1", 4, 4, 101), ("v1", "c5", "d9", 1, 1, 0)], ["k1", "k2", "k3"], ["chunk ids are unique", "chunks have a document", "page ranges", "token bounds"]),
    "missing": (DOCS, [("v1", "c1", "d1", 0, 2, 10)], ["k1", "k2", "k3"], ["ok documents have chunks", "page ranges"]),
    "none": (DOCS, [], ["k1", "k2", "k3"], []),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_the_suite_has_the_verdicts_of_the_single_tests(spark, name):
    docs, chunks, keys, want = CASES[name]
    parts = frames(spark, docs, chunks, keys)
    got = {r.rule: r.broken for r in quality.suite(*parts, 100).collect()}
    assert [r for r in RULES if got[r]] == [r for r, rows in zip(RULES, single(*parts)) if not rows.isEmpty()] == want and list(got) == RULES


def test_each_table_is_scanned_once(spark, tmp_path):
    for name, df in zip(("docs", "chunks", "keys"), frames(spark, *CASES["good"][:3])):
        df.write.parquet(str(tmp_path / name))
    read = [spark.read.parquet(str(tmp_path / n)) for n in ("docs", "chunks", "keys")]
    plan = quality.suite(*read, 100)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") + plan.count("Relation[") == 3


@pytest.mark.parametrize("at", [0, 1, 2])
def test_a_run_is_seen_as_a_whole_or_not_at_all(spark, tmp_path, monkeypatch, at):
    p = Pipeline(Lake(spark, str(tmp_path / "l")), chunking=Chunking(max_tokens=60, overlap_tokens=10, min_tokens=5))
    append, calls = Lake.append, []

    def lost(self, table, rows):
        if table in lakes.TOGETHER:
            calls.append(table)
            if len(calls) == at + 1:
                raise OSError("the driver is gone")
        append(self, table, rows)

    monkeypatch.setattr(Lake, "append", lost)
    with pytest.raises(OSError):
        p.ingest(listed(spark), "r:1", NOW)
    monkeypatch.undo()
    assert p.lake.open_runs() == ["r:1"] and all(p.lake.read(t).isEmpty() for t in lakes.TOGETHER) and p.watermark().isEmpty()
    if at == 1:
        assert p.lake.sweep(running=("r:1",)) == [] and p.lake.sweep() == ["r:1"] and p.lake.open_runs() == []
        assert all(p.lake.read(t).isEmpty() for t in lakes.TOGETHER)
    assert p.ingest(listed(spark), "r:1", NOW)["landed"] == 5 and p.lake.open_runs() == []
    assert p.lake.read("bronze/manifest").count() == 5 and p.lake.read("bronze/objects").count() == 4 and not p.watermark().isEmpty()


def test_a_merge_reads_the_buckets_of_its_keys(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "l"))
    assert pipeline.EXTRA
    schema = lakes.SCHEMAS["gold/embeddings"]
    rows = lambda ids, run: spark.createDataFrame([("m", f"h{i}", [1.0], run) for i in ids], schema)
    lake.merge("gold/embeddings", rows([*range(500), 3, 3], "r1"), ["model", "text_hash"])
    assert lake.read("gold/embeddings").count() == 500 and lake.read("gold/embeddings").columns == schema.names
    touched = [r[0] for r in rows([7, 900], "r2").select(lakes.bucket_of(F.col("text_hash"))).distinct().collect()]
    read = lake.in_buckets("gold/embeddings", touched).select("model", "text_hash")
    assert len(touched) <= 2 and "key_bucket" in read._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert read.select(F.input_file_name().alias("f")).distinct().count() < lake.read("gold/embeddings").select(F.input_file_name().alias("f")).distinct().count() / 4
    lake.merge("gold/embeddings", rows([7, 900], "r2"), ["model", "text_hash"])
    got = lake.read("gold/embeddings")
    assert got.count() == 501 and [r.text_hash for r in got.where("run_id = 'r2'").collect()] == ["h900"]
    with pytest.raises(ValueError, match="merged"):
        lake.append("gold/embeddings", rows([1], "r3"))


def test_a_run_goes_on_at_the_step_that_did_not_end(spark, tmp_path, monkeypatch):
    p = Pipeline(Lake(spark, str(tmp_path / "l")), chunking=Chunking(max_tokens=60, overlap_tokens=10, min_tokens=5))
    done = []
    for name in ("ingest", "silver", "rechunk", "gate", "gold"):
        step = getattr(Pipeline, name)
        monkeypatch.setattr(Pipeline, name, lambda self, *a, _s=step, _n=name, **k: (done.append(_n), _s(self, *a, **k))[1])
    kill = Pipeline.rechunk

    def lost(self, *a, **k):
        raise KeyboardInterrupt

    monkeypatch.setattr(Pipeline, "rechunk", lost)
    with pytest.raises(KeyboardInterrupt):
        p.run(listed(spark), "run-1", NOW)
    assert done == ["ingest", "silver"]
    monkeypatch.setattr(Pipeline, "rechunk", kill)
    made = Pipeline(p.lake, chunking=p.chunking).run(listed(spark), "run-1", NOW)
    assert done == ["ingest", "silver", "rechunk", "gate", "gold"]
    assert made["bronze"]["landed"] == 5 and made["silver"]["documents_ok"] == 2 and made["silver"]["chunks"] == made["indexed"] > 4
    # ended: nothing is done again; with other settings, everything that depends on them is
    assert Pipeline(p.lake, chunking=p.chunking).run(listed(spark), "run-1", NOW) == made and len(done) == 5
    Pipeline(p.lake, {"gate": {"max_quarantine_rate": 0.9}}, p.chunking).run(listed(spark), "run-1", NOW)
    assert done[5:] == ["ingest", "silver", "rechunk", "gate", "gold"]
