"""Search modes, answers, evaluation, watching and views over a lake; PDF tables; settings that are read."""

import json
import sys
import threading
import types

import pytest
from pyspark.sql import functions as F

from docstrata.operators import pages, retrieval
from docstrata.operators.chunking import Chunking
from docstrata.plans import pipeline
from docstrata.plans.pipeline import GateError, Pipeline
from docstrata.sources.lake import Lake
from tests.test_pipeline_run import NOW, listed, page

SMALL = Chunking(max_tokens=60, overlap_tokens=10, min_tokens=5)


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    p = Pipeline(Lake(spark, str(tmp_path_factory.mktemp("lake") / "l")), chunking=SMALL)
    made = p.run(listed(spark), "run-1", NOW)
    assert made["warnings"] == ["40% of run-1 are in quarantine"]
    return p


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "query_id long, qtext string")


def test_modes(spark, lake):
    q = asked(spark, "What did Stelco decide in EB-2026-0015?", "procedural order")
    got = {m: lake.search(q, mode=m).orderBy("query_id", "rank").collect() for m in ("dense", "hybrid", "rerank")}
    assert all([r["rank"] for r in rows if r.query_id == 1] == list(range(1, 7)) for rows in got.values())
    assert got["dense"][0].score == pytest.approx(1 / 61, abs=1e-6) and "EB-2026-0015" in got["hybrid"][0].context_text
    scores = [r.score for r in got["rerank"] if r.query_id == 1]
    assert scores == sorted(scores, reverse=True) and scores[0] <= 1
    constant = lake.search(q, mode="rerank", score=lambda hits: F.lit(0.5)).where("query_id = 1").orderBy("rank").collect()
    assert {r.score for r in constant} == {0.5} and len(constant) == 6
    with pytest.raises(ValueError):
        lake.search(q, mode="other")


def test_candidates_setting_bounds_the_rerank(spark, lake):
    p = Pipeline(lake.lake, {"search": {"candidates": 2}}, SMALL)
    assert p.search(asked(spark, "Stelco rate order"), mode="rerank").count() == 2


def test_rare_terms_by_all_chunks(spark):
    rows = [(i, "common word here" + (" seldom" if i < 30 else ""), [1.0, float(i)]) for i in range(100)]
    pool = spark.createDataFrame(rows, "chunk_id long, lexical string, embedding array<double>")
    q = spark.createDataFrame([(1, "seldom", [0.0, 1.0])], "query_id long, qtext string, qvec array<double>")
    posts = retrieval.postings(pool, retrieval.question_terms(q), "lexical")
    # 30 chunks are too many for 25, and few for a share of 10,000
    assert posts.rare(retrieval.question_terms(q), 100).count() == 0 and posts.rare(retrieval.question_terms(q), 10_000).count() == 1
    few, many = (retrieval.search(pool, q, 3, "rare", n).collect() for n in (100, 10_000))
    assert {r.chunk_id for r in few} == {97, 98, 99} and few != many


def test_dense_search_beyond_one_block(spark):
    rows = [(f"c{i:03}", [1.0, i / 50, -i / 70]) for i in range(200)] + [("none", None), ("short", [1.0]), ("hole", [1.0, None, 1.0]), ("zero", [0.0, 0.0, 0.0]), ("c000b", [2.0, 0.0, 0.0])]
    chunks = spark.createDataFrame(rows, "chunk_id string, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([(i, [1.0, i / 10, 0.3]) for i in range(37)] + [(99, None)], "query_id long, qvec array<double>")
    got = [sorted(map(tuple, retrieval.dense_top(chunks, queries, 5, block=b).collect())) for b in (4096, 7)]
    assert got[0] == got[1] and len(got[0]) == 37 * 5
    import numpy as np

    usable = [(i, np.array(v)) for i, v in rows if v and len(v) == 3 and None not in v]
    for q in range(37):
        a = np.array([1.0, q / 10, 0.3])
        want = sorted((-round(float(a @ v / (np.linalg.norm(a) * np.linalg.norm(v) + 1e-9)), 6), i) for i, v in usable)[:5]
        assert [(r[1], r[3]) for r in sorted((r for r in got[0] if r[0] == q), key=lambda r: r[3])] == [(i, n) for n, (_, i) in enumerate(want, 1)]
    assert retrieval.dense_top(chunks, queries.where("false"), 5).count() == 0


def test_postings_read_the_texts_once(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (2, "b c c")], "chunk_id long, text string").write.parquet(str(tmp_path / "t"))
    posts = retrieval.postings(spark.read.parquet(str(tmp_path / "t")), spark.createDataFrame([("b",), ("c",), ("zz",)], "term string"))
    assert sorted(map(tuple, posts.rows.select("chunk_id", "term", "dl", "tf").collect())) == [(1, "b", 1, 1), (2, "b", 3, 1), (2, "c", 3, 2)]
    assert posts.stats.first().asDict() == {"n": 2, "avgdl": 2.0}
    assert str(tmp_path) not in posts.rows._jdf.queryExecution().toString()


def test_embedding_of_a_long_text_is_linear(spark):
    import time

    text = " ".join(f"w{i}" for i in range(40_000))
    df = spark.createDataFrame([(text,), ("",), ("x x b",)], "t string").select(retrieval.hash_embedding(F.col("t")).alias("v"))
    begin = time.time()
    rows = df.collect()
    assert time.time() - begin < 15 and abs(sum(x * x for x in rows[0].v) - 1) < 1e-9 and set(rows[1].v) == {0.0} and sorted(rows[2].v)[-2:] == pytest.approx([5**-0.5, 2 * 5**-0.5])


def test_answers_are_kept_for_a_time(spark, lake):
    q = asked(spark, "What about the rate order?")
    get = lambda now, text="What about the rate order?", **o: lake.answer(asked(spark, text), now, **o).first()
    first = get("2026-03-05T00:00:00Z")
    assert first.cache == "miss" and first.answer.startswith("(Extractive answer")
    again = get("2026-03-05T10:00:00Z", "what ABOUT the  rate order")
    assert (again.cache, again.answer, again.cited) == ("hit", first.answer, first.cited)
    assert get("2026-03-06T00:00:01Z").cache == "miss"  # a day later
    assert get("2026-03-05T11:00:00Z", mode="dense").cache == "miss" and get("2026-03-05T12:00:00Z", docket="EB-2026-0015").cache == "miss"
    assert lake.answer(q, "2026-03-05T13:00:00Z", use_cache=False).first().cache == "miss"
    poor = lambda docs: docs.select("query_id").distinct().select("query_id", F.lit("poor").alias("answer"), F.expr("array(1)").alias("cited"), F.lit(True).alias("degraded"))
    for _ in range(2):
        r = get("2026-03-05T14:00:00Z", model="other", generate=poor)
        assert (r.answer, r.cache) == ("poor", "miss")


def test_embeddings_are_made_once(spark, lake):
    made = lake.lake.read("gold/embeddings")
    n = made.count()
    assert n == made.select("text_hash").distinct().count() > 0
    lake.rechunk("again", "2026-03-09T00:00:00Z")
    calls = []
    p = Pipeline(lake.lake, chunking=SMALL)
    assert p.gold("again", "2026-03-09T00:00:00Z", embed=lambda c: calls.append(1) or retrieval.hash_embedding(c)) == 0
    assert lake.lake.read("gold/embeddings").count() == n


def test_evaluation_report(spark, lake):
    golden = spark.createDataFrame([("q1", "What did Stelco decide about the rate order?", ["1001"], ["Stelco sentence"]), ("q2", "zebra crossing", ["9999"], ["zebra"])], "id string, question string, expected_source_ids array<string>, answer_contains array<string>")
    summary = lake.evaluate(golden, "hybrid", "mine", "2026-03-07T00:00:00Z")
    assert (summary["n_questions"], summary["hit_1"], summary["mrr"], summary["answer_hit_k"], summary["n_errors"]) == (2, 0.5, 0.5, 0.5, 0)
    assert summary["retrieval_ms_p50"] > 0 and summary["answer_acc"] == 0.5 and summary["cited_expected_rate"] == 0.5 and summary["cache_hit_ratio"] == 0
    root = lake.lake.root
    kept = json.loads(open(f"{root}/eval/20260307T000000Z_hybrid_mine.json").read())
    assert kept["summary"]["hit_1"] == 0.5 and [r["first"] for r in kept["rows"]] == [1, None]
    assert "| q2 | miss | no |" in open(f"{root}/eval/latest_hybrid_mine.md").read()


def test_views(spark, lake):
    s = lake.status()
    assert (s["documents_ok"], s["duplicates"], s["quarantined"], s["bronze_records"]) == (2, 1, 2, 5) and s["latest_validation"]["status"] == "warn" and s["active_index"]
    checks = {c["name"]: c for c in json.loads(s["latest_validation"]["checks_json"])}
    assert len(checks) == 9 and not checks["file_signature_matches_extension"]["passed"] and checks["volume_vs_trailing"]["passed"]
    assert [r.source_id for r in lake.quarantine().collect()] == ["1004", "1005"] and lake.documents("t1001").count() == 1


def test_watching(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pipeline, "MIN_WAIT", 0.01)
    p = Pipeline(Lake(spark, str(tmp_path / "w")), chunking=SMALL)
    assert p.watch(lambda: listed(spark), once=True) == 1 and p.status()["documents_ok"] == 2
    stop, seen = threading.Event(), []

    def poll():
        seen.append(len(seen))
        if len(seen) == 1:
            raise OSError("no answer")
        if len(seen) == 3:
            stop.set()

    assert p.watch(poll, every=0.01, stop=stop) == 3 and p.status()["bronze_records"] == 5


def test_a_step_is_tried_again():
    calls = []

    def step():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("lost")
        return 7

    assert pipeline.attempt(step, 2) == 7 and len(calls) == 3

    def gate():
        calls.append(1)
        raise GateError("no")

    with pytest.raises(GateError):
        pipeline.attempt(gate, 5)
    assert len(calls) == 4


def test_settings_of_validation_are_read(spark, tmp_path):
    low = Pipeline(Lake(spark, str(tmp_path / "a")), {"validation": {"min_bytes": 10_000}}, SMALL)
    low.ingest(listed(spark), "r", NOW)
    failed = {(r.record_key, r.name) for r in low.lake.read("bronze/failed").collect()}
    assert ("oeb:1002", "size_within_bounds") in failed
    strict = Pipeline(Lake(spark, str(tmp_path / "b")), {"validation": {"max_error_rate": 0.1}}, SMALL)
    errors = spark.createDataFrame([("oeb", "77", "u", "x" * 900)], "source string, source_id string, url string, error string")
    assert strict.ingest(listed(spark), "r", NOW, errors=errors)["status"] == "failed"
    assert len(strict.lake.read("bronze/fetch_errors").first().error) == 500


def test_a_sudden_drop_is_a_warning(spark, tmp_path):
    p = Pipeline(Lake(spark, str(tmp_path / "d")), chunking=SMALL)
    schema = p.lake.read("bronze/reports").schema
    p.lake.append("bronze/reports", spark.createDataFrame([(None, "passed", n, n, 0, f"2026-02-0{i}T00:00:00Z", "[]", f"r{i}") for i, n in enumerate((100, 120, 0, 90), 1)], schema))
    p.ingest(listed(spark), "r9", NOW)
    checks = {c["name"]: c["passed"] for c in json.loads(p.lake.read("bronze/reports").where("run_id = 'r9'").first().checks_json)}
    assert not checks["volume_vs_trailing"] and checks["fetch_error_rate"]


class FakePage:
    """What the PDF library gives for a page: characters with places, and tables with boxes."""

    def __init__(self, lines, tables=()):
        self.objects = [{"text": t, "x0": 0, "x1": 10, "top": 10 * i, "bottom": 10 * i + 8} for i, t in enumerate(lines)]
        self.tables = tables

    def find_tables(self):
        return [types.SimpleNamespace(bbox=b, extract=lambda r=r: r) for b, r in self.tables]

    def filter(self, keep):
        other = FakePage([])
        other.objects = [o for o in self.objects if keep(o)]
        return other

    def extract_text(self):
        return "\n".join(o["text"] for o in self.objects)


@pytest.fixture
def fake_pdf(monkeypatch):
    words = lambda i: [f"{w} {chr(97 + i)} about the rate order of the board and what it decides" for w in ("First", "Second", "Third")]
    table = ((0, 15, 10, 29), [["name", "value"], ["a\nb", None], [None, ""], ["c", "2"]])
    made = [FakePage(["Board  Report", *words(i), f"Page {i}"], [table] if i == 2 else []) for i in range(1, 6)]

    class Pdf(types.SimpleNamespace):
        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

    def open_(f):
        if b"broken" in f.read():
            raise RuntimeError("bad xref")
        return Pdf(pages=made)

    monkeypatch.setitem(sys.modules, "pdfplumber", types.SimpleNamespace(open=open_))


def test_pdf_tables_leave_the_text(fake_pdf):
    doc = pages.parse_document(b"%PDF-1.7", "pdf", most_pages=4)
    assert doc.total == 5 and len(doc.texts) == 4 and doc.tables[1] == ["| name | value |\n|---|---|\n| a b |  |\n| c | 2 |"] and doc.raw
    assert "Second c" not in doc.texts[1] and "First c" in doc.texts[1] and "Third c" in doc.texts[1] and "Second b" in doc.texts[0]
    with pytest.raises(pages.ParseError, match="bad xref"):
        pages.parse_document(b"%PDF-broken", "pdf")


def test_markdown_as_columns_make_it(spark):
    from docstrata.functions.text import table_to_markdown

    tables = [[["a", "b"], ["c", None]], [["x"]], [["a", " b \n c"], None, ["", None], ["d"]], [], [["one"], ["two"]]]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(tables)], "i int, t array<array<string>>").select("i", table_to_markdown(F.col("t")).alias("m")).orderBy("i").collect()
    assert [r.m for r in got] == [pages.markdown(t) for t in tables]


def test_raw_pages_lose_running_lines(spark):
    rows = [("k", i, f"Board  Report\nbody {w}\n\n\n\n{w}-\nover\nlast {w}\nthen {w}\nPage {i}", ["t"], 9, True, None) for i, w in enumerate(["one", "two", "three", "four"], 1)] + [("h", 1, "Board  Report\nx", [], 1, False, None), ("e", None, None, None, None, None, "bad")]
    got = {(r.record_key, r.page_no): r for r in pages.finished(spark.createDataFrame(rows, "record_key string, page_no int, text string, tables array<string>, n_pages_total int, raw boolean, error string")).collect()}
    assert [got["k", i].text for i in range(1, 5)] == [f"body {w}\n\n{w}over\nlast {w}\nthen {w}" for w in ("one", "two", "three", "four")] and got["k", 1].tables == ["t"]
    assert got["h", 1].text == "Board  Report\nx" and got["e", None].error == "bad" and len(got) == 6


def test_tables_of_pages_become_chunks(spark, tmp_path, monkeypatch):
    table = "| h | v |\n|---|---|\n| a | 1 |"
    plain = pages.parse_files

    def with_table(files, most_pages=400):
        rows = plain(files, most_pages)
        return rows.withColumn("tables", F.when((F.col("page_no") == 1) & F.col("key").endswith("1002"), F.array(F.lit(table))).otherwise(F.col("tables"))).withColumn("n_pages_total", F.col("n_pages_total") + 3)

    monkeypatch.setattr(pages, "parse_files", with_table)
    p = Pipeline(Lake(spark, str(tmp_path / "t")), chunking=SMALL)
    p.run(listed(spark), "r", NOW)
    (doc,) = p.lake.read("silver/documents").where("source_id = '1002'").collect()
    assert (doc.n_tables, doc.n_pages_total, doc.n_pages) == (1, 4, 1)
    assert [r.text for r in p.lake.read("silver/chunks").where("chunk_type = 'table'").collect()] == [table]
    assert p.lake.read("staging/pages").count() == 0


def test_a_broken_table_is_not_an_empty_one(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "x"))
    assert lake.read("silver/documents").count() == 0
    folder = tmp_path / "x" / "silver" / "documents" / "run_id=r"
    folder.mkdir(parents=True)
    (folder / "part-0.parquet").write_bytes(b"this is no parquet file")
    with pytest.raises(Exception, match="(?i)parquet|footer|magic"):
        lake.read("silver/documents").collect()


def test_stored_responses(spark, tmp_path):
    from docstrata.sources import listings

    (tmp_path / "a.json").write_text(json.dumps({"Results": [{"Uri": 1, "RecordTitle": {"Value": "é"}}, {"Uri": 2}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"Uri": 3}]))
    (tmp_path / "c.txt").write_text("{}")
    listings.register(spark)
    for rows in (listings.stored_responses(spark, f"{tmp_path}/*.json"), spark.read.format("listing").load(f"{tmp_path}/*.json"), spark.read.format("listing").load(f"file://{tmp_path}/*.json")):
        assert sorted(json.loads(r.hit)["Uri"] for r in rows.collect()) == [1, 2, 3]
    (tmp_path / "d.json").write_text(json.dumps({"ErrorCode": "E7"}))
    with pytest.raises(Exception, match="E7"):
        listings.stored_responses(spark, f"{tmp_path}/*.json").collect()


def test_percentiles_of_a_hot_group(spark):
    from docstrata.operators.evaluation import percentiles_nearest

    import random

    r = random.Random(0)
    data = {"hot": [r.gauss(0, 1) for _ in range(5000)] + [1e9], "ties": [3.0] * 700 + [4.0], "one": [2.0], "few": [1.0, 2.0]}
    rows = [(k, x) for k, v in data.items() for x in v] + [("one", None)]
    got = {x.k: x for x in percentiles_nearest(spark.createDataFrame(rows, "k string, v double"), "k", "v", p0=0, p50=50, p95=95, p100=100).collect()}
    for k, v in data.items():
        v = sorted(v)
        assert [got[k].p0, got[k].p50, got[k].p95, got[k].p100] == [v[round(p * (len(v) - 1))] for p in (0, 0.5, 0.95, 1)]


def test_items_inside_longer_words(spark, tmp_path):
    from docstrata.plans.search import _expected

    docs = [(1, "prealpha beta gammas and so on"), (2, "alpha beta"), (3, "the of and"), (4, "xx alpha beta gamma xx")]
    items = [(1, "alpha beta gamma"), (2, "the of"), (3, "beta"), (4, "!!"), (5, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(map(tuple, _expected(spark, str(tmp_path)).collect()))
    assert got == sorted((i, d) for i, needle in items if needle for d, text in docs if needle in text)


def test_commands(spark, tmp_path, capsys):
    from docstrata.cli import main

    listed(spark).drop("record_type", "size_hint").write.parquet(str(tmp_path / "listed"))
    root = str(tmp_path / "lake")
    assert main([root, "watch", str(tmp_path / "listed"), "--once"], spark) == [{"polls": 1}]
    assert main([root, "status"], spark)[0]["documents_ok"] == 2 and main([root, "validation"], spark)[0]["status"] == "warn"
    assert len(main([root, "quarantine"], spark)) == 2 and len(main([root, "documents", "t100", "--limit", "1"], spark)) == 1
    (tmp_path / "q.jsonl").write_text('{"id": "q1", "question": "Stelco rate order", "expected_source_ids": ["1001"], "answer_contains": ["Stelco"]}\n\n')
    assert main([root, "eval", str(tmp_path / "q.jsonl"), "--mode", "dense"], spark)[0]["n_questions"] == 1
    assert "rate order" in main([root, "ask", "What about the rate order?", "--mode", "hybrid", "--fresh"], spark)[0]["answer"]
    rows = main([root, "sql", "SELECT explode(sequence(1, 2500)) AS i FROM silver_documents LIMIT 2500", "silver/documents"], spark)
    assert len(rows) == 2500 and capsys.readouterr().out.count("\n") > 2500
