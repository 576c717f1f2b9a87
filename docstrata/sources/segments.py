"""Index tables that grow by segments: what a segment holds is seen when its one-row commit is there, and not before.

A segment that was written again replaces itself; one that merges others names them, and readers skip those from then on. A run that
stops between its tables leaves readers on the state before it.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.storage import drop, exists

COMMIT = "segment string, replaces array<string>, facts map<string,string>"


class Segments:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def committed(self) -> dict[str, dict[str, str]]:
        """Facts of the segments that readers see: a row for each segment ever committed."""
        rows = self._commits().collect()
        gone = {s for r in rows for s in r["replaces"] or []}
        return {r["segment"]: r["facts"] or {} for r in sorted(rows, key=lambda r: r["segment"]) if r["segment"] not in gone}

    def _commits(self) -> DataFrame:
        path = f"{self.root}/commits"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], COMMIT)
        return self.spark.read.schema(COMMIT).option("recursiveFileLookup", "true").json(path)

    def commit(self, segment: str, replaces: list[str] | None = None, **facts: object) -> None:
        row = self.spark.createDataFrame([(segment, replaces or [], {k: str(v) for k, v in facts.items()})], COMMIT)
        row.coalesce(1).write.mode("overwrite").json(f"{self.root}/commits/{quote(segment, safe='')}")

    def path(self, table: str, segment: str) -> str:
        """A segment is a partition folder, so that a table is one relation however many segments it has."""
        return f"{self.root}/{table}/segment={quote(segment, safe='')}"

    def read(self, table: str, schema: str) -> DataFrame:
        """A table over all committed segments; partition folders below a segment are columns."""
        found = list(self.committed())
        if not found or not exists(self.spark, f"{self.root}/{table}"):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, segment string").parquet(f"{self.root}/{table}")
        return rows.where(F.col("segment").isin(found)).drop("segment")

    def sweep(self) -> list[str]:
        """Delete what merged segments replaced; returns their names. For when no reader of the state before is left."""
        gone = sorted(r["s"] for r in self._commits().select(F.explode("replaces").alias("s")).distinct().collect())
        for s in gone:
            for table in ("postings", "lengths", "codes", "vectors"):
                drop(self.spark, self.path(table, s))
        return gone
