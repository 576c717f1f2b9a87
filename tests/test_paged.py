"""Paged listings: only the window's pages are opened, a stream goes on after the last page; high-water marks as keyed state."""

import json

import pytest
from pyspark.sql import functions as F

from docstrata.sources import paged
from docstrata.streaming import feed, marks


def put(folder, day, number, ids, body=None):
    place = folder / f"registered={day}"
    place.mkdir(parents=True, exist_ok=True)
    (place / f"page-{number:06}.json").write_text(body or json.dumps({"Results": [{"Uri": i} for i in ids], "HasMoreItems": False}))


@pytest.fixture
def folder(tmp_path):
    for day in range(1, 6):
        for page in (1, 2):
            put(tmp_path, f"2026-03-0{day}", page, range(day * 100 + page * 10, day * 100 + page * 10 + 3))
    put(tmp_path, "2026-02-01", 1, [], "this is no JSON")
    put(tmp_path, "2026-04-01", 1, [], json.dumps({"ResponseStatus": {"ErrorCode": "E7"}}))
    (tmp_path / "notes.txt").write_text("x")
    return tmp_path


def uris(df):
    return sorted(json.loads(r.hit)["Uri"] for r in df.collect())


def test_only_the_pages_of_the_window_are_opened(spark, folder):
    got = paged.window(spark, str(folder), "2026-03-02", "2026-03-04")
    assert uris(got) == sorted(d * 100 + p * 10 + i for d in (2, 3, 4) for p in (1, 2) for i in range(3))
    assert got.rdd.getNumPartitions() == 6  # a task for each page
    every = spark.read.format("paged_listing").load(f"file://{folder}")
    assert uris(every.where("registered = '2026-03-05'")) == [510, 511, 512, 520, 521, 522]
    assert uris(every.where("registered IN ('2026-03-01', '2026-03-03') AND place = 0")) == [110, 120, 310, 320]
    with pytest.raises(Exception, match="E7"):
        every.where("registered > '2026-03-31'").collect()
    with pytest.raises(Exception, match="(?i)json|expecting"):
        every.where("registered < '2026-03-01'").collect()
    assert paged.window(spark, str(folder / "missing"), "2026-01-01", "2026-12-31").count() == 0


def test_a_stream_goes_on_after_the_last_page(spark, tmp_path):
    folder, out = tmp_path / "pages", tmp_path / "out"
    put(folder, "2026-03-01", 1, [1, 2])
    put(folder, "2026-03-02", 1, [3])
    run = lambda: feed.drain(paged.follow(spark, str(folder), "2026-03-01"), str(out))
    assert uris(run()) == [1, 2, 3]
    assert uris(run()) == [1, 2, 3]  # nothing is repeated
    put(folder, "2026-03-02", 2, [4])
    put(folder, "2026-03-04", 1, [5, 6])
    put(folder, "2026-02-01", 1, [99])  # before the first day
    # pages that were taken are not opened again
    put(folder, "2026-03-01", 1, [], "broken since")
    assert uris(run()) == [1, 2, 3, 4, 5, 6]


def test_kept_pages_come_back(spark, tmp_path):
    hits = spark.range(250).select(F.when(F.col("id") < 120, "2026-03-01").otherwise("2026-03-02").alias("registered"), F.when(F.col("id") < 120, F.col("id")).otherwise(F.col("id") - 120).alias("place"), F.to_json(F.struct(F.col("id").alias("Uri"))).alias("hit"))
    paged.store_pages(hits, str(tmp_path / "p"), page_size=50)
    assert sorted(f.name for f in (tmp_path / "p" / "registered=2026-03-01").iterdir() if f.suffix == ".json" and not f.name.startswith(".")) == [f"page-{i:06}.json" for i in (1, 2, 3)]
    assert uris(paged.window(spark, str(tmp_path / "p"), "2026-03-02", "2026-03-02")) == list(range(120, 250))


def test_marks_move_with_passed_runs_only(spark, tmp_path):
    runs, state = str(tmp_path / "runs"), str(tmp_path / "state")

    def land(*rows):
        spark.createDataFrame(rows, marks.RUNS).coalesce(1).write.mode("append").parquet(runs)
        return {r.source: r.high_water for r in marks.advance(spark, runs, state).collect()}

    assert land(("oeb", "r1", "passed", "2026-03-02"), ("edgar", "r1", "warn", "2026-02-01"), ("other", "r1", "failed", "2026-01-01")) == {"oeb": "2026-03-02", "edgar": "2026-02-01"}
    # failed, older and empty runs leave the marks; the state comes from the checkpoint
    assert land(("oeb", "r2", "failed", "2026-03-09"), ("edgar", "r2", "passed", "2026-01-15"), ("edgar", "r3", "passed", None)) == {"oeb": "2026-03-02", "edgar": "2026-02-01"}
    moved = spark.read.parquet(f"{state}/moves").count()
    assert land(("oeb", "r3", "passed", "2026-03-05"), ("oeb", "r4", "passed", "2026-03-04"), ("other", "r4", "passed", "2026-01-02")) == {"oeb": "2026-03-05", "edgar": "2026-02-01", "other": "2026-01-02"}
    assert moved == 2 and spark.read.parquet(f"{state}/moves").count() == 4
    assert {r.source for r in marks.advance(spark, runs, state).collect()} == {"oeb", "edgar", "other"}


def test_marks_of_nothing(spark, tmp_path):
    assert marks.marks(spark, str(tmp_path / "none")).count() == 0
