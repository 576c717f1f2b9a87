"""Paged listings as a Spark data source: a partition for each page of results, the date window pushed to the source, and a stream with a position.

A listing is kept as it was answered: a folder for each day of registration, with a file for each page of results
(``registered=2026-03-01/page-000001.json``: ``{"Results": [...], "HasMoreItems": true}``). A read with a window on ``registered`` looks into the folders
of its days only; a stream goes on after the last page that it has taken, in the order of days and pages.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

_DAY = re.compile(r"^registered=(\d{4}-\d{2}-\d{2})$")
SCHEMA = "registered string, page string, place int, hit string"


class Page(InputPartition):
    def __init__(self, day: str, name: str) -> None:
        self.day, self.name = day, name


class _Folder:
    """The pages of a listing on any file system that Arrow reaches; readers run outside of Spark."""

    def __init__(self, path: str) -> None:
        self.path = path

    def _place(self, below: str = ""):
        path = f"{self.path.rstrip('/')}/{below}".rstrip("/")
        return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))

    def days(self, wanted) -> list[str]:
        system, path = self._place()
        found = (_DAY.match(f.base_name) for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)))
        return sorted(m[1] for m in found if m and wanted(m[1]))

    def pages(self, day: str) -> list[Page]:
        system, path = self._place(f"registered={day}")
        return [Page(day, f.base_name) for f in sorted(system.get_file_info(fs.FileSelector(path)), key=lambda f: f.base_name) if f.is_file and f.base_name.startswith("page-")]

    def read(self, page: Page | None) -> Iterator[tuple]:
        if page is None:  # a window without pages
            return
        system, path = self._place(f"registered={page.day}/{page.name}")
        with system.open_input_stream(path) as f:
            body = json.loads(f.read())
        status = body.get("ResponseStatus") or {}
        if code := status.get("ErrorCode") or body.get("ErrorCode"):
            raise ValueError(f"{path}: {code}")
        for i, hit in enumerate(body.get("Results", [])):
            yield page.day, page.name, i, hit if isinstance(hit, str) else json.dumps(hit)


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.folder, self.wanted = _Folder(path), []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802  (Spark's name)
        tests = {
            EqualTo: lambda v: lambda d: d == v,
            GreaterThan: lambda v: lambda d: d > v,
            GreaterThanOrEqual: lambda v: lambda d: d >= v,
            LessThan: lambda v: lambda d: d < v,
            LessThanOrEqual: lambda v: lambda d: d <= v,
            In: lambda v: lambda d: d in v,
        }
        for f in filters:
            if type(f) in tests and f.attribute == ("registered",):
                self.wanted.append(tests[type(f)](f.value))
            else:
                yield f

    def partitions(self) -> list[Page]:
        days = self.folder.days(lambda d: all(w(d) for w in self.wanted))
        return [p for d in days for p in self.folder.pages(d)]

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.folder.read(partition)


class _Stream(DataSourceStreamReader):
    """The offset is the last page taken; a page that comes later for a day before it is left to the overlap of the next listing."""

    def __init__(self, path: str, since: str) -> None:
        self.folder, self.since = _Folder(path), since

    def initialOffset(self) -> dict:  # noqa: N802
        return {"day": self.since, "page": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        for day in reversed(self.folder.days(lambda d: d >= self.since)):
            if pages := self.folder.pages(day):
                return {"day": day, "page": pages[-1].name}
        return self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Page]:
        low, high = (start["day"], start["page"]), (end["day"], end["page"])
        days = self.folder.days(lambda d: low[0] <= d <= high[0])
        return [p for d in days for p in self.folder.pages(d) if low < (p.day, p.name) <= high]

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.folder.read(partition)


class PagedListing(DataSource):
    """``format("paged_listing")``: option ``path``; for streams also ``since``, the first day."""

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.options["path"], self.options.get("since", "0000-00-00"))


def register(spark: SparkSession) -> None:
    """Filters reach Python data sources only with this setting."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedListing)


def window(spark: SparkSession, path: str, since: str, until: str) -> DataFrame:
    """Hits of the days from ``since`` to ``until``, both included; other days' pages are not opened."""
    register(spark)
    return spark.read.format("paged_listing").load(path).where(F.col("registered").between(since, until))


def follow(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """A stream of hits, a page at a time, that goes on where its checkpoint has stopped."""
    register(spark)
    stream = spark.readStream.format("paged_listing").option("path", path)
    return (stream.option("since", since) if since else stream).load()


def store_pages(hits: DataFrame, path: str, page_size: int = 100, first_page: int = 1) -> None:
    """Keep hits (registered, place in the day's order, hit as JSON) as pages, in any number of tasks.

    Pages are numbered in each day by ``place`` (from 0, gapless), so what a task gathers is one page.
    """
    numbered = hits.withColumn("_page", F.floor(F.col("place") / page_size) + first_page)
    bodies = numbered.groupBy("registered", "_page").agg(F.array_sort(F.collect_list(F.struct("place", "hit"))).alias("h"), F.max("place").alias("last"))
    body = F.concat(F.lit('{"Results": ['), F.array_join(F.transform("h", lambda x: x["hit"]), ", "), F.lit('], "HasMoreItems": '), (F.size("h") == page_size).cast("string"), F.lit("}"))
    pages = bodies.select("registered", F.format_string("page-%06d.json", "_page").alias("name"), body.alias("body"))
    root = _Folder(path)

    def write(batches):
        import pyarrow as pa

        for batch in batches:
            for day, name, text in zip(*(c.to_pylist() for c in batch.columns)):
                system, folder = root._place(f"registered={day}")
                system.create_dir(folder, recursive=True)
                # a page is there as a whole or not at all
                with system.open_output_stream(f"{folder}/.{name}") as f:
                    f.write(text.encode())
                system.move(f"{folder}/.{name}", f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    pages.mapInArrow(write, "n long").agg(F.sum("n")).collect()
