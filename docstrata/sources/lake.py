"""Lake tables: directories of Parquet with fixed schemas, appended to once per run.

Appends are idempotent without a table format: a run's rows replace what the same run wrote before
(dynamic partition overwrite on run_id), and merges insert only keys that are not there.
"""

from __future__ import annotations

from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstrata.storage import drop, exists, materialize, names_in, read_text, write_text

_S, _I, _L = T.StringType(), T.IntegerType(), T.LongType()


def _schema(strings: str, ints: str = "", longs: str = "", order: str | None = None) -> T.StructType:
    kinds = {n: _S for n in strings.split()} | {n: _I for n in ints.split()} | {n: _L for n in longs.split()}
    return T.StructType([T.StructField(n, kinds[n]) for n in (order or f"{strings} {ints} {longs}").split()])


# The columns of the lake's tables.
SCHEMAS = {
    "bronze/manifest": _schema("run_id source source_id title url published_at registered_at extension record_number record_type docket content_type object_uri sha256 fetched_at duplicate_of extra_json", "", "size_hint bytes"),
    "bronze/fetch_errors": _schema("run_id source source_id url error failed_at"),
    "silver/documents": _schema("doc_id record_key source source_id title docket record_type published_at url landing_url object_uri parser text_hash duplicate_of status run_id parsed_at", "n_pages n_pages_total n_tables", "n_chars"),
    "silver/pages": _schema("doc_id text tables_json headings_json run_id", "page_no"),
    "silver/chunks": _schema("chunk_id doc_id chunk_config_version chunk_type section text context source source_id docket title published_at url run_id chunked_at", "ordinal page_start page_end n_tokens"),
    "silver/quarantine": _schema("record_key source source_id sha256 object_uri stage reason run_id quarantined_at"),
}
PARTITIONS = {"silver/chunks": ["chunk_config_version", "run_id"]}
# Tables that a run writes together, and readers see together.
TOGETHER = ["bronze/failed", "bronze/objects", "bronze/manifest"]
# Tables that are merged into by a key: folders by a hash of it, so that a merge reads those of its own keys.
BUCKETED = {"gold/embeddings": "text_hash", "gold/answers": "key"}
BUCKETS = 64


def bucket_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


class Lake:
    """Tables under a root folder, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def read(self, table: str, *columns: str, schema: T.StructType | None = None) -> DataFrame:
        """A table by name; one that was never written is empty with its schema."""
        schema = schema or SCHEMAS[table]
        # only a folder that is not there is an empty table; a broken one is an error
        found = exists(self.spark, self.path(table))
        df = self.spark.read.schema(schema).parquet(self.path(table)) if found else self.spark.createDataFrame([], schema)
        if table in TOGETHER and (open_runs := self.open_runs()):
            df = df.where(~F.col("run_id").isin(open_runs))
        return df.select(*columns) if columns else df.select(*schema.names)

    # runs that write several tables: a mark that one has begun hides its rows, and goes when all are there
    def open_runs(self) -> list[str]:
        """Runs that have begun and are not committed: those that write now, and those that were lost."""
        return [unquote(n.removesuffix(".open")) for n in names_in(self.spark, self.path("_runs")) if n.endswith(".open")]

    def begin(self, run_id: str) -> None:
        """From now on the run's rows in the tables written together are not seen; what an attempt before has left goes, as this one writes all of it."""
        write_text(self.spark, self.path(f"_runs/{quote(run_id, safe='')}.open"), "")
        self._sweep(run_id)

    def commit(self, run_id: str) -> None:
        """All of the run's rows are seen, by the deletion of one small file."""
        drop(self.spark, self.path(f"_runs/{quote(run_id, safe='')}.open"))

    def _sweep(self, run_id: str) -> None:
        for table in TOGETHER:
            self.clear(table, run_id)

    def sweep(self, running: tuple[str, ...] = ()) -> list[str]:
        """Delete what lost runs have left; returns their names. ``running``: runs that write now."""
        lost = [r for r in self.open_runs() if r not in running]
        for run_id in lost:
            self._sweep(run_id)
            self.commit(run_id)
        return lost

    def append(self, table: str, rows: DataFrame) -> None:
        """Write a run's rows; run again, they replace themselves. Empty frames leave a readable empty table."""
        schema, parts = SCHEMAS[table], PARTITIONS.get(table, ["run_id"])
        fitted = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))
        if table in BUCKETED:
            raise ValueError(f"{table} is merged into, not appended to")
        fitted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*parts).parquet(self.path(table))

    def merge(self, table: str, rows: DataFrame, keys: list[str]) -> None:
        """Insert the rows whose keys are not there yet; nothing is updated. A bucketed table is read in the buckets of these rows only."""
        schema, parts = SCHEMAS[table], PARTITIONS.get(table, ["run_id"])
        fitted = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))
        by = BUCKETED.get(table)
        if by is None:
            fresh = fitted.dropDuplicates(keys).join(self.read(table, *keys), keys, "left_anti")
        else:
            parts = ["key_bucket", *parts]
            own = materialize(fitted.dropDuplicates(keys).withColumn("key_bucket", bucket_of(F.col(by))), "merge")
            touched = [r["key_bucket"] for r in own.select("key_bucket").distinct().collect()]  # BUCKETS at most
            fresh = own.join(self.in_buckets(table, touched).select(*keys), keys, "left_anti")
        fresh.write.mode("append").option("compression", "zstd").partitionBy(*parts).parquet(self.path(table))

    def in_buckets(self, table: str, buckets: list[int]) -> DataFrame:
        """A bucketed table's rows in the folders of these buckets; other folders are not listed among the files to read."""
        schema = T.StructType([*SCHEMAS[table], T.StructField("key_bucket", _I)])
        return self.read(table, schema=schema).where(F.col("key_bucket").isin(buckets))

    def clear(self, table: str, run_id: str | None = None) -> None:
        """Delete a staging table whose rows have been read, or only what one run has staged."""
        part = f"/run_id={self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(run_id)}" if run_id is not None else ""
        drop(self.spark, self.path(table) + part)

    def chunks_of(self, version: str) -> DataFrame:
        """One chunk version: only its folder is read."""
        return self.read("silver/chunks").where(F.col("chunk_config_version") == version)

    def write_report(self, report: DataFrame, name: str) -> None:
        """A validation or evaluation report (a few rows) as one JSON file."""
        report.coalesce(1).write.mode("overwrite").json(self.path(name))

    def write_text(self, text: str, name: str) -> None:
        """A small file, on whatever file system the lake is."""
        write_text(self.spark, self.path(name), text)

    def read_text(self, name: str) -> str | None:
        """A small file's text, or None if there is none."""
        return read_text(self.spark, self.path(name))

    def reports(self, folder: str, schema: T.StructType | str) -> DataFrame:
        """All reports below a folder, with their path."""
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").json(self.path(folder)).withColumn("path", F.input_file_name())

    def sql(self, text: str, tables: list[str], **parameters) -> DataFrame:
        """Ad-hoc SQL over lake tables; their names in the text have an underscore for the slash."""
        for t in tables:
            self.read(t).createOrReplaceTempView(t.replace("/", "_"))
        return self.spark.sql(text, args=parameters or None)


def quarantine_keys(reports: DataFrame) -> DataFrame:
    return reports.select(F.explode("quarantine_source_ids").alias("record_key")).distinct()


def latest_report(reports: DataFrame) -> DataFrame:
    """The last report by the time of its validation, not by its name: names start with the source."""
    return reports.agg(F.max_by(F.struct(*reports.columns), F.struct("validated_at", "run_id")).alias("r")).select("r.*")


def land(records: DataFrame, run_id: str, ingest_date: str) -> DataFrame:
    """Manifest rows with content-named paths; a record with bytes that came before points to the first one's object."""
    from docstrata.functions.text import safe_name
    from docstrata.operators.silver import first_seen

    name = F.concat(F.lit("source="), F.col("source"), F.lit(f"/ingest_date={ingest_date}/"), safe_name(F.col("source_id")), F.lit("_"), F.substring("sha256", 1, 12), F.lit("."), F.col("extension"))
    named = records.withColumn("sha256", F.sha2("content", 256)).withColumn("bytes", F.length("content").cast("long")).withColumn("object_uri", name).withColumn("run_id", F.lit(run_id))
    seen = first_seen(named, "sha256", ["source", "source_id"], "object_uri")
    return seen.withColumn("object_uri", F.coalesce("duplicate_of", "object_uri"))
