"""Vector cells: recall against the exact search, partition pruning, later segments, slices, hostile rows."""

import re

import numpy as np
import pytest

from docstrata.operators import cells as module
from docstrata.operators import retrieval
from docstrata.operators.cells import CellIndex, fit_centroids, recall
from docstrata.plans import search as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(30, 16)) * 3
    x = centres[r.integers(0, 30, 3000)] + r.normal(size=(3000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [1.0]), (9003, [None] * 16), (9004, [0.0] * 16), (9005, [float("nan")] * 16)]
    return spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(4)


@pytest.fixture(scope="module")
def queries(vectors):
    return vectors.where("chunk_id % 50 = 0").selectExpr("chunk_id AS query_id", "embedding AS qvec")


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    made = CellIndex(spark, str(tmp_path_factory.mktemp("cells") / "i"))
    made.add(vectors.where("chunk_id < 2000"), "a")
    made.add(vectors, "b")
    return made


def test_recall_and_share_of_files(spark, index, vectors, queries):
    assert index.codes().count() == 3000 and index.codes().select("chunk_id").distinct().count() == 3000
    exact = retrieval.dense_top(vectors.where("chunk_id < 3000"), queries, 6)
    probes = index.tune(0.95)
    found = index.search(queries, 6)
    assert recall(found, exact) >= 0.9 and probes < 30
    one = queries.where("query_id = 50")
    assert index.share_read(one) < 0.6 and index.share_read(queries, 200) == 1.0
    # in all cells the search is exact
    every = index.search(queries, 6, probes=10_000, candidates=3000)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))


def test_only_probed_cells_are_read(spark, index, queries):
    found = index.search(queries.where("query_id = 100"), 6, probes=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    wanted = re.findall(r"PartitionFilters: \[[^\]]*cell#\d+ IN(?:SET)? \(?([\d,]+)\)?", plan)
    assert len(wanted) >= 2 and all(len(w.split(",")) == 3 for w in wanted)


def test_a_large_cell_is_sliced(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "SLICE", 100)
    rows = spark.range(1000).selectExpr("id AS chunk_id", "array(1.0D, cast(id AS double) / 1000) AS embedding")
    index = CellIndex(spark, str(tmp_path / "i"), cells=2)
    index.add(rows, "a")
    assert index.codes().groupBy("cell", "slice").count().agg({"count": "max"}).first()[0] < 200
    q = spark.createDataFrame([(1, [1.0, 0.5]), (2, None), (3, [1.0]), (4, [0.0, 0.0])], "query_id long, qvec array<double>")
    # codes of two bytes tell neighbours poorly apart: a third of the vectors are scored exactly
    got = index.search(q, 5, probes=2, candidates=300)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, retrieval.dense_top(rows, q.where("query_id = 1"), 5).collect()))
    index.add(rows, "again")
    assert index.codes().count() == 1000


def test_empty_index(spark, tmp_path):
    index = CellIndex(spark, str(tmp_path / "e"))
    index.add(spark.createDataFrame([], "chunk_id long, embedding array<double>"), "a")
    assert index.search(spark.createDataFrame([(1, [1.0])], "query_id long, qvec array<double>"), 3).count() == 0 and index.tune() == 1


def test_registered_query_finds_nine_in_ten(spark):
    exact, found = plans.dense_topk(spark, SF), plans.ann_topk(spark, SF)
    assert found.columns == exact.columns and recall(found, exact) >= 0.9


def test_centroids_are_directions():
    x = np.random.default_rng(0).normal(size=(50, 4))
    c = fit_centroids(x, 60)
    assert c.shape == (60, 4) and np.allclose(np.linalg.norm(c, axis=1), 1)


def test_products_of_bounded_size():
    import pyarrow as pa

    r = np.random.default_rng(1)
    asked = pa.table({"query_id": pa.array(range(7)), "qvec": pa.array(r.normal(size=(7, 3)).tolist())})
    batch = pa.RecordBatch.from_pydict({"chunk_id": list(range(100)), "embedding": r.normal(size=(100, 3)).tolist()})
    whole, cut = (pa.Table.from_batches(retrieval._dense(asked, 4, size)(iter([batch]))) for size in (1 << 24, 20))
    assert whole.equals(cut)
