"""Listings of records: a paged search with nested hits, and a company feed of parallel arrays.

There is no network here: responses are JSON files or rows. ``ListingSource`` makes them a Spark data source.
"""

from __future__ import annotations

import fnmatch
import json
import os
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docstrata.functions.text import find_docket

_VALUE = "struct<Value:string>"
_TIME = "struct<IsClear:boolean,DateTime:string>"
HIT = (
    f"struct<Uri:bigint,RecordTitle:{_VALUE},RecordNumber:{_VALUE},RecordExtension:{_VALUE},RecordMimeType:{_VALUE},RecordDocumentSize:struct<Value:bigint>,"
    f"RecordDateCreated:{_TIME},RecordDateRegistered:{_TIME},RecordRecordType:struct<RecordTypeName:{_VALUE}>>"
)
_LISTS = "accessionNumber form filingDate primaryDocument primaryDocDescription acceptanceDateTime".split()
FEED = "struct<name:string,filings:struct<recent:struct<" + ",".join(f"{n}:array<string>" for n in _LISTS) + ">>>"


def search_query(since: str, until: str, extensions: list[str], title: str | None = None) -> str:
    """The search text for a window of registration dates."""
    wanted = " or ".join(f"extension:{e.lower()}" for e in extensions)
    clauses = [f"registeredOn:{since} to {until}", f"({wanted})" if wanted else None, f"title:{title}" if title else None]
    return " and ".join(c for c in clauses if c)


def decode_hits(raw: DataFrame, base_url: str, source: str = "oeb", json_col: str = "hit") -> DataFrame:
    """JSON hits to record columns: wrapped values are unwrapped, a cleared date is null."""
    h = raw.select(F.from_json(json_col, HIT).alias("h"))
    date = lambda c: F.when(F.coalesce(F.col(f"h.{c}.IsClear"), F.lit(False)), None).otherwise(F.replace(F.col(f"h.{c}.DateTime"), F.lit(".0000000Z"), F.lit("Z")))
    title, uri = F.coalesce("h.RecordTitle.Value", F.lit("")), F.col("h.Uri").cast("string")
    landing = F.concat(F.lit(f"{base_url.rstrip('/')}/Record/"), uri)
    return h.select(
        F.lit(source).alias("source"),
        uri.alias("source_id"),
        title.alias("title"),
        F.concat(landing, F.lit("/File/document")).alias("url"),
        date("RecordDateCreated").alias("published_at"),
        date("RecordDateRegistered").alias("registered_at"),
        F.lower(F.coalesce("h.RecordExtension.Value", F.lit(""))).alias("extension"),
        F.col("h.RecordNumber.Value").alias("record_number"),
        F.col("h.RecordRecordType.RecordTypeName.Value").alias("record_type"),
        find_docket(title).alias("docket"),
        F.col("h.RecordDocumentSize.Value").alias("size_hint"),
        F.to_json(F.struct(F.col("h.RecordMimeType.Value").alias("mime_type"), landing.alias("landing_url"))).alias("extra_json"),
    )


def listed(records: DataFrame, since: str, until: str, most: int | None = None) -> DataFrame:
    """Records registered in the window. Without a limit, newest first; with one, oldest first, so that a
    high-water mark never passes records that were not listed."""
    rows = records.where(F.substring("registered_at", 1, 10).between(since, until))
    return rows.orderBy("registered_at", "source_id").limit(most) if most else rows.orderBy(F.desc("registered_at"), "source_id")


def decode_feed(raw: DataFrame, archive_url: str, since: str, until: str, forms: list[str] | None = None, source: str = "edgar") -> DataFrame:
    """raw: cik, feed (JSON). Parallel arrays to one record each, of the wanted forms and filing dates."""
    recent = F.col("f.filings.recent")
    zipped = F.arrays_zip(*(F.coalesce(recent[n], F.expr("cast(array() AS array<string>)")).alias(n) for n in _LISTS))
    rows = raw.select(F.lpad("cik", 10, "0").alias("cik"), F.from_json("feed", FEED).alias("f")).select("cik", F.coalesce("f.name", "cik").alias("company"), F.explode(zipped).alias("x"))
    rows = rows.where(F.col("x.accessionNumber").isNotNull() & F.col("x.filingDate").between(since, until))
    if forms:
        rows = rows.where(F.col("x.form").isin(forms))
    doc, number = F.col("x.primaryDocument"), F.col("x.accessionNumber")
    return rows.select(
        F.lit(source).alias("source"),
        F.concat_ws("/", number, doc).alias("source_id"),
        F.trim(F.concat_ws(" ", "company", "x.form", F.coalesce("x.primaryDocDescription", F.lit("")))).alias("title"),
        F.concat_ws("/", F.lit(archive_url.rstrip("/")), F.col("cik").cast("bigint"), F.replace(number, F.lit("-"), F.lit("")), doc).alias("url"),
        F.concat(F.col("x.filingDate"), F.lit("T00:00:00Z")).alias("published_at"),
        F.col("x.acceptanceDateTime").alias("registered_at"),
        F.lower(F.element_at(F.split(doc, r"\."), -1)).alias("extension"),
        number.alias("record_number"),
        F.col("x.form").alias("record_type"),
        number.alias("docket"),
    )


def stored_responses(spark: SparkSession, path: str) -> DataFrame:
    """Stored search responses, a JSON file each, on any file system that Spark reads: path and hit (JSON), a row for each hit.

    A response that holds an error code stops the read.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))
    code = F.get_json_object("body", "$.ErrorCode")
    failed = F.raise_error(F.concat("path", F.lit(": "), code)).cast("string")
    hits = F.when(code.isNotNull(), failed).when(F.startswith(F.ltrim("body"), F.lit("[")), F.col("body")).otherwise(F.get_json_object("body", "$.Results"))
    return files.select("path", F.explode(F.from_json(hits, "array<string>")).alias("hit"))


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _ListingReader(DataSourceReader):
    """A data source's reader runs outside of Spark, so that files are reached by Arrow's file systems, by scheme."""

    def __init__(self, pattern: str) -> None:
        self.pattern = pattern

    def _place(self, path: str):
        return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))

    def partitions(self):
        system, pattern = self._place(self.pattern)
        if not any(c in pattern for c in "*?["):
            return [_File(self.pattern)]
        found = system.get_file_info(fs.FileSelector(os.path.dirname(pattern)))
        scheme = self.pattern.split("://")[0] + "://" if "://" in self.pattern else ""
        return [_File(scheme + f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and fnmatch.fnmatch(f.path, pattern)]

    def read(self, partition: _File) -> Iterator[tuple]:
        system, path = self._place(partition.path)
        with system.open_input_stream(path) as f:
            body = json.loads(f.read())
        if isinstance(body, dict) and body.get("ErrorCode"):
            raise ValueError(f"{partition.path}: {body['ErrorCode']}")
        for hit in body.get("Results", []) if isinstance(body, dict) else body:
            yield partition.path, json.dumps(hit)


class ListingSource(DataSource):
    """``format("listing")``: stored search responses, one task per file; columns path and hit (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "path string, hit string"

    def reader(self, schema) -> DataSourceReader:
        return _ListingReader(self.options["path"])


SOURCES = {"oeb": decode_hits, "edgar": decode_feed}


def get_source(name: str):
    if name not in SOURCES:
        raise ValueError(f"unknown source {name!r}; there are {sorted(SOURCES)}")
    return SOURCES[name]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ListingSource)


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Golden questions from JSON lines; blank lines are skipped."""
    return spark.read.schema("id string, question string, expected_source_ids array<string>, answer_contains array<string>, note string").json(path).where("id IS NOT NULL")
