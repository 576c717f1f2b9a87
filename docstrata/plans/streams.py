"""Queries of the streams; each gives, once drained, the rows of a batch query."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docstrata.plans.adapters import query, table
from docstrata.sources import paged
from docstrata.streaming import feed, marks


def _events(spark, d):
    schema = table(spark, d, "events").schema
    return feed.read_files(spark, d, schema, "events.parquet")


@query("SELECT event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS high_water FROM events WHERE user_id % 7 <> 2 GROUP BY 1")
def stream_high_water(spark, d):
    """High-water marks without the runs that failed."""
    rows = table(spark, d, "events").withColumn("run_id", F.col("user_id") % 7)
    failed = rows.select("run_id").where("run_id = 2").distinct()
    return feed.high_water(rows, "event_type", "ts", failed).withColumn("high_water", F.date_format("high_water", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT event_type, CASE WHEN event_type = 'view' THEN strftime(DATE '2024-02-01' - 7, '%Y-%m-%d') ELSE strftime(max(ts)::DATE - 1, '%Y-%m-%d') END AS since FROM events GROUP BY 1")
def stream_resume_window(spark, d):
    marks = table(spark, d, "events").groupBy("event_type").agg(F.date_format(F.max("ts"), "yyyy-MM-dd").alias("m"))
    mark = F.when(F.col("event_type") != "view", F.col("m"))
    return marks.select("event_type", F.date_format(feed.resume_since(mark, F.lit("2024-02-01").cast("date")), "yyyy-MM-dd").alias("since"))


@query("SELECT event_id, user_id, event_type, value FROM events")
def stream_overlap_dedup(spark, d):
    """The events listed twice, in overlapping windows: each comes out once."""
    events = _events(spark, d)
    return feed.drain(feed.once_each(events.unionByName(events), "event_id", "ts"), feed.scratch(spark, "overlap")).select("event_id", "user_id", "event_type", "value")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_microbatch_outcome(spark, d):
    """Each micro-batch merges its new keys into a table; running it twice changes nothing."""
    path = feed.scratch(spark, "outcome")
    schema = _events(spark, d).schema
    spark.createDataFrame([], schema).write.parquet(f"{path}/out")

    def handle(batch, number):
        present = batch.sparkSession.read.schema(schema).parquet(f"{path}/out").select("event_id")
        batch.join(present, "event_id", "left_anti").write.mode("append").parquet(f"{path}/out")

    for attempt in ("first", "again"):
        feed.micro_batches(_events(spark, d), handle, f"{path}/{attempt}").awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _listing(spark, d):
    """The events as a listing is kept: a folder for each day, a page for each 1,000."""
    path = feed.scratch(spark, "listing")
    day = F.date_format("ts", "yyyy-MM-dd")
    place = F.row_number().over(Window.partitionBy("registered").orderBy("event_id")) - 1
    hit = F.to_json(F.struct(F.col("event_id").alias("Uri"), F.col("event_type").alias("Kind")))
    paged.store_pages(table(spark, d, "events").select(day.alias("registered"), "event_id", hit.alias("hit")).withColumn("place", place), path, 1000)
    return path


def _decoded(hits):
    h = F.from_json("hit", "Uri bigint, Kind string").alias("h")
    return hits.select("registered", h).select("registered", F.col("h.Uri").alias("event_id"), F.col("h.Kind").alias("event_type"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS registered, event_id, event_type FROM events WHERE ts::DATE BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'")
def listing_pages_window(spark, d):
    """A window of days of a paged listing: the source opens its pages only."""
    return _decoded(paged.window(spark, _listing(spark, d), "2024-01-10", "2024-01-12"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS registered, event_id, event_type FROM events")
def listing_pages_stream(spark, d):
    """The same listing as a stream of pages, run twice: what was taken is not taken again."""
    path, out = _listing(spark, d), feed.scratch(spark, "followed")
    for _ in range(2):
        rows = feed.drain(paged.follow(spark, path), out)
    return _decoded(rows)


@query("SELECT event_type AS source, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS high_water FROM events WHERE user_id % 7 <> 2 GROUP BY 1")
def stream_marks(spark, d):
    """High-water marks as keyed state, moved by every event as a run of its user; runs of every seventh user have failed."""
    runs = table(spark, d, "events").select(F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("run_id"), F.when(F.col("user_id") % 7 == 2, "failed").otherwise("passed").alias("status"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("registered_at"))
    path = feed.scratch(spark, "runs")
    runs.write.parquet(f"{path}/runs")
    return marks.advance(spark, f"{path}/runs", f"{path}/state")
