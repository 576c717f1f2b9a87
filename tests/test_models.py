"""Models behind Arrow batches: one load in a worker, batches of like length, the stand-ins' values."""

import random
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from docstrata.operators import models, retrieval
from docstrata.operators.models import BatchModel, HashEmbedder, OverlapScorer, PhraseJudge


def texts(n=500):
    r = random.Random(2)
    return [(i, " ".join(r.choice(["alpha", "the", "beta-2", "x.y", "Grüße", "EB-2025-0001"]) for _ in range(r.randint(0, 60)))) for i in range(n)] + [(n, None), (n + 1, "")]


def test_vectors_are_those_of_the_column_function(spark):
    df = spark.createDataFrame(texts(), "i long, t string").repartition(3)
    got = models.embedded(df, BatchModel("hash", HashEmbedder, batch=7, buffered=50), "t").collect()
    want = {r.i: r.v for r in df.select("i", retrieval.hash_embedding(F.col("t")).alias("v")).collect()}
    assert len(got) == 502
    for r in got:
        assert r.embedding is None if r.t is None else np.allclose(r.embedding, want[r.i], atol=1e-12)


def test_a_model_is_loaded_once_in_a_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        Path(folder, f"{os.getpid()}-{uuid.uuid4().hex}").write_text("")
        return HashEmbedder()

    df = spark.createDataFrame(texts(200), "i long, t string").repartition(12)
    model = BatchModel(f"counted-{folder}", load, batch=8, buffered=16)
    for _ in range(2):
        assert models.embedded(df, model, "t").where("embedding IS NOT NULL").count() == 201
    pids = [f.name.split("-")[0] for f in tmp_path.iterdir()]
    assert len(pids) == len(set(pids)) and 0 < len(pids) < 12


def test_batches_of_like_length_pad_less():
    lengths = [len(t or "") for _, t in texts()]
    plain = [np.arange(a, min(a + 16, len(lengths))) for a in range(0, len(lengths), 16)]
    dealt = models.by_length(lengths, 16)
    assert sorted(np.concatenate(dealt).tolist()) == list(range(len(lengths))) and max(map(len, dealt)) == 16
    assert models.padding(lengths, dealt) < 0.1 < 0.3 < models.padding(lengths, plain)
    assert models.padding([], []) == 0.0


def test_tasks_get_texts_of_like_length(spark):
    df = models.dealt_by_length(spark.createDataFrame(texts(), "i long, t string").where("t IS NOT NULL"), "t", 4)
    spans = df.select(F.spark_partition_id().alias("p"), F.length("t").alias("n")).groupBy("p").agg(F.min("n").alias("a"), F.max("n").alias("b")).orderBy("p").collect()
    assert len(spans) > 2 and all(x.b <= y.a for x, y in zip(spans, spans[1:]))


def test_pairs_and_verdicts(spark):
    hits = spark.createDataFrame([(1, "alpha beta", "ctx", "alpha here"), (2, "alpha", None, "nothing"), (3, "", "", ""), (4, "gamma", "gamma", "x")], "i int, qtext string, context string, text string")
    score = BatchModel("overlap", OverlapScorer)
    got = {r.i: r.rescored for r in models.rescored(hits, score).collect()}
    assert got == {r.i: r.rescored for r in models.rescored(hits, retrieval.overlap_score).collect()} == {1: 0.5, 2: 0.0, 3: 0.0, 4: 1.0}
    rows = spark.createDataFrame([(1, "q", "two  years\n3 months", "It lasts Two Years."), (2, "q", "x y", "none"), (3, "q", None, "a")], "i int, question string, reference string, answer string")
    verdicts = {r.i: (r.judge_correct, r.judge_reason) for r in models.judged(rows, BatchModel("phrases", PhraseJudge)).collect()}
    assert verdicts[1][0] is True and verdicts[2] == (False, "holds none of the phrases") and verdicts[3] == (None, None)
