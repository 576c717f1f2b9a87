"""The persisted inverted index: the rows of a search over texts, from the buckets of the asked terms alone."""

import pytest
from pyspark.sql import functions as F

from docstrata.operators import retrieval
from docstrata.operators.text_index import TextIndex, counted_terms

ROWS = [(i, f"word{i % 7} alpha x{i % 13}-{i} " + "beta " * (i % 4) + ("rare" if i % 50 == 0 else "")) for i in range(300)] + [(900, ""), (901, None), (902, "the of and")]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(ROWS, "chunk_id long, lexical string")


def asked(spark):
    return spark.createDataFrame([(1, "alpha beta rare"), (2, "word3 x4-17"), (3, "nowhere")], "query_id long, qtext string")


def test_terms_are_counted_in_the_row(spark):
    got = spark.createDataFrame([(1, "b a b c b"), (2, ""), (3, None), (4, "a")], "i int, t string").select("i", counted_terms(F.col("t")).alias("t")).collect()
    assert {r.i: None if r.t is None else [tuple(x) for x in r.t] for r in got} == {1: [("b", 3), ("c", 1)], 2: [], 3: None, 4: []}


@pytest.mark.parametrize("few", [20_000, 2])
def test_search_by_index_and_by_texts(spark, chunks, tmp_path, monkeypatch, few):
    from docstrata.operators import text_index

    monkeypatch.setattr(text_index, "FEW_TERMS", few)
    index = TextIndex(spark, str(tmp_path / "i"), "long", buckets=8)
    assert index.add(chunks.where("chunk_id < 100"), "s1") == 100
    assert index.add(chunks, "s:2") == len(ROWS) - 100 and index.add(chunks, "s3") == 0
    q = retrieval.question_terms(asked(spark))
    rank = lambda found: sorted(map(tuple, retrieval.bm25(found, q, 20).collect()))
    want = rank(retrieval.postings(chunks, q, "lexical"))
    assert rank(index.postings(q)) == want and len(want) == 40
    part = chunks.where("chunk_id % 3 = 1")
    assert rank(index.postings(q, part)) == rank(retrieval.postings(part, q, "lexical"))
    index.merge("m")
    assert list(index.segments.committed()) == ["m"] and rank(index.postings(q)) == want and index.segments.sweep() == ["s1", "s:2"]
    assert rank(index.postings(q)) == want and index.size() == len(ROWS)
    assert sorted(map(tuple, index.frequency().collect())) == sorted(map(tuple, retrieval.document_frequency(chunks, "lexical").collect()))


def test_only_asked_buckets_are_read(spark, chunks, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"), "long", buckets=16)
    index.add(chunks, "s")
    found = index.postings(retrieval.question_terms(asked(spark).where("query_id = 2")))
    plan = found.rows._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("\n")[0] and "In(term" in plan
    # two terms are in two buckets at most
    assert found.rows.count() == 43 + 1 and found.rows.select(F.input_file_name().alias("f")).distinct().count() <= 2
    assert "Exchange" not in found.rows._jdf.queryExecution().executedPlan().toString()


def test_what_is_not_committed_is_not_read(spark, chunks, tmp_path, monkeypatch):
    index = TextIndex(spark, str(tmp_path / "i"), "long", buckets=4)
    index.add(chunks.where("chunk_id < 10"), "s1")
    monkeypatch.setattr(index.segments, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        index.add(chunks, "s2")
    monkeypatch.undo()
    again = TextIndex(spark, str(tmp_path / "i"), "long", buckets=99)
    assert again.buckets == 4 and again.size() == 10
    assert again.add(chunks, "s2") == len(ROWS) - 10 and again.size() == len(ROWS)
    with pytest.raises(ValueError, match="committed"):
        again.add(spark.createDataFrame([(5000, "new")], "chunk_id long, lexical string"), "s2")


def test_a_run_clears_its_own_staging_only(spark, tmp_path):
    from docstrata.plans import pipeline  # noqa: F401  (it declares the staging table)
    from docstrata.sources.lake import Lake

    lake = Lake(spark, str(tmp_path / "l"))
    for run in ("watch-2026-03-01T00:00:00Z-1", "manual"):
        lake.append("staging/pages", spark.createDataFrame([("k", 1, "text", None, 1, False, None, run)], lake.read("staging/pages").schema))
    lake.clear("staging/pages", run_id="watch-2026-03-01T00:00:00Z-1")
    assert [r.run_id for r in lake.read("staging/pages").collect()] == ["manual"]
    lake.clear("staging/pages", run_id="manual")
    assert lake.read("staging/pages").count() == 0


def test_the_lake_searches_by_its_index(spark, tmp_path):
    from docstrata.operators.chunking import Chunking
    from docstrata.plans.pipeline import Pipeline
    from docstrata.sources.lake import Lake
    from tests.test_pipeline_run import NOW, listed

    p = Pipeline(Lake(spark, str(tmp_path / "l")), chunking=Chunking(max_tokens=60, overlap_tokens=10, min_tokens=5))
    p.run(listed(spark), "run-1", NOW)
    version = p.active()
    chunks = p.lake.read("gold/chunks").where(F.col("index_version") == version)
    assert p.text_index(version).size() == chunks.count() > 0
    q = spark.createDataFrame([(1, "What did Stelco decide in EB-2026-0015?")], "query_id long, qtext string")
    pool = chunks.withColumn("lexical", F.concat_ws(" ", "context", "text")).select("chunk_id", "lexical", "embedding")
    asked_ = q.withColumn("qvec", retrieval.hash_embedding(F.col("qtext")))
    for mode in ("exact", "rare"):
        plain = sorted(map(tuple, retrieval.search(pool, asked_, 6, mode).collect()))
        assert plain == sorted(map(tuple, retrieval.search(pool, asked_, 6, mode, p.text_index(version).size(), index=p.text_index(version)).collect()))
    p.run(listed(spark), "run-2", "2026-03-06T00:00:00Z")
    assert p.text_index(version).size() == chunks.count()


def test_a_row_of_the_index_is_a_list(spark, tmp_path, monkeypatch):
    """Postings were dealt out and sorted one by one, and all texts shuffled for the first segment."""
    from docstrata.functions import term_counts
    from docstrata.functions.text import terms

    words = ["The a.b--c. -x- 7", "İstanbul K9 ﬁ Straße naïve", "", None, "... - the", "x.y x.y X.Y. z\tz\nz z", "\x00q\x1fr s"] * 30
    rows = spark.createDataFrame(list(enumerate(words)), "chunk_id long, lexical string").repartition(3)
    index = TextIndex(spark, str(tmp_path / "i"), "long", buckets=4)
    assert index.add(rows, "s") == len(words)
    lists = spark.read.parquet(index.segments.path("postings", "s"))
    want = {r.term: r.df for r in retrieval.document_frequency(rows, "lexical").collect()}
    assert {r.term: r.df for r in index.frequency().collect()} == want and lists.count() <= 3 * len(want) < sum(want.values())
    plain = {(r.chunk_id, t): r.t.count(t) for r in rows.select("chunk_id", terms(F.col("lexical")).alias("t")).collect() for t in r.t or []}
    got = index.postings(spark.createDataFrame([(t,) for t in want], "term string")).rows.collect()
    assert {(r.chunk_id, r.term): r.tf for r in got} == plain and len(got) == len(plain)
    vectors = term_counts.hash_vectors(words[:7]).to_pylist()
    made = {r.chunk_id: r.v for r in rows.where("chunk_id < 7").select("chunk_id", retrieval.hash_embedding(F.col("lexical")).alias("v")).collect()}
    assert [made[i] for i in range(7)] == vectors
    pieces = list(term_counts.blocks(iter([__import__("pyarrow").record_batch({"text": ["ab" * 5, None, "c", "d" * 30]})] * 2), most=16))
    assert sum(p.num_rows for p in pieces) == 8 and max(sum(len(t or "") for t in p["text"].to_pylist()[:-1]) for p in pieces) < 16


def test_scores_of_few_terms_are_summed_by_chunk(spark, chunks, monkeypatch):
    """Every pair of a query and a chunk was a row of the shuffle; now a task keeps the best of its chunks, some at a time."""
    from dataclasses import replace

    q = retrieval.question_terms(spark.createDataFrame([(i, f"alpha beta word{i % 7} x{i % 13}-{i} rare") for i in range(9)], "query_id long, qtext string"))
    found = retrieval.postings(chunks, q, "lexical")
    rank = lambda df: sorted(map(tuple, df.collect()))
    want = rank(retrieval.bm25(found, q, 20))
    few, run = replace(found, few=True), retrieval._bm25
    plan = retrieval.bm25(few, q, 20)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "hashpartitioning(query_id" in plan and "Aggregate(keys=[query_id" not in plan
    for cells in (1 << 21, 40, 1):
        monkeypatch.setattr(retrieval, "_bm25", lambda *a, cells=cells: run(*a, cells))
        assert rank(retrieval.bm25(few, q, 20)) == want and len(want) == 180
    # of the terms of the postings, only some may be asked
    some = q.where("term LIKE 'x%'")
    assert rank(retrieval.bm25(few, some, 20)) == rank(retrieval.bm25(found, some, 20)) != []
    assert retrieval.bm25(few, q.where("false"), 20).count() == 0


def test_dense_products_are_small():
    """One task held 128 MB of scores several times for a block of queries."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(1)
    x, q = r.integers(-2, 3, (9_000, 4)).astype(float), r.integers(-2, 3, (4_096, 4)).astype(float)
    lists = lambda a: pa.array(a.tolist(), pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([pa.array([f"c{i:05}" for i in range(len(x))]), lists(x)], names=["chunk_id", "embedding"])
    asked = pa.table({"query_id": np.arange(len(q)), "qvec": lists(q)})
    tracemalloc.start()
    got = pa.Table.from_batches(list(retrieval._dense(asked, 5)(iter([batch.slice(0, 3), batch.slice(3)])))).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6 and len(got) == 5 * len(q)
    for i in (0, 17, 4_095):
        s = np.round((x @ q[i]) / (np.sqrt((q[i] ** 2).sum()) * np.sqrt((x * x).sum(axis=1)) + 1e-9), 6)
        want = sorted(range(len(x)), key=lambda j: (-s[j], j))[:5]
        assert [(g["chunk_id"], g["score"]) for g in got if g["query_id"] == i] == [(f"c{j:05}", s[j]) for j in want]


def test_more_postings_are_dealt_to_more_tasks(spark, chunks, tmp_path, monkeypatch):
    """The number of tasks stood still, so that what each of them sorted grew with the input."""
    from docstrata.operators import text_index

    monkeypatch.setattr(text_index, "FILE_BYTES", 200)
    monkeypatch.setattr(retrieval, "POSTINGS", 50)
    index = TextIndex(spark, str(tmp_path / "i"), "long", buckets=8)
    index.add(chunks, "s")
    q = retrieval.question_terms(asked(spark))
    ranked = retrieval.bm25(index.postings(q), q, 20)
    assert sorted(map(tuple, ranked.collect())) == sorted(map(tuple, retrieval.bm25(retrieval.postings(chunks, q, "lexical"), q, 20).collect()))
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    parts = int(plan.split("RepartitionByExpression [chunk_id")[1].split("], ")[1].split("\n")[0].split(",")[0])
    assert parts > 10
    files = spark.read.parquet(index.segments.path("postings", "s")).select(F.input_file_name().alias("f")).distinct().count()
    assert files > 16
