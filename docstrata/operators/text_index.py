"""An inverted index that is written once for an index version, and read by the buckets of the asked terms.

Postings lie in folders by a hash of their term, sorted by term inside, so that a search reads the buckets of its terms, and of
those the row groups that may hold them. A task counts the terms of a block of texts at a time; a row is a term with the chunks of
such a block that have it, their counts and lengths, so what is dealt out and sorted are lists, and not single postings. Chunks
that come later are a further segment; merging segments reads postings, not texts. A bucket is dealt to several files when it is
large, so that a term that very many chunks have is not one task's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.functions.term_counts import blocks, count_terms
from docstrata.functions.text import terms
from docstrata.operators.retrieval import Postings
from docstrata.sources.segments import Segments
from docstrata.storage import dealt, input_bytes, materialize

FILE_BYTES = 16 << 20
# Asked terms up to this number are named in the scan and may be broadcast; more are joined.
FEW_TERMS = 20_000
LAYOUT = "lists"


def counted_terms(text: Column) -> Column:
    """Array of (term, tf): the terms are sorted and counted by runs, inside the row."""
    last = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))
    runs = lambda p: F.transform(p["at"], lambda i, k: F.struct(F.get(p["s"], i).alias("term"), (F.coalesce(F.get(p["at"], k + 1), F.size(p["s"])) - i).cast("long").alias("tf")))
    # one-element arrays give the sorted terms and the runs' begins names, so that they are made once
    sorted_ = F.transform(F.array(F.array_sort(terms(text))), lambda s: F.struct(s.alias("s"), F.when(F.size(s) > 0, last(s)).when(s.isNotNull(), F.array().cast("array<int>")).alias("at")))
    return F.element_at(F.transform(sorted_, runs), 1)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, ids, tfs, dls) of each block of (chunk_id, text). The empty term, which no text has, comes with all chunks of a block; of those without a text the length is null."""
    for rows in blocks(batches):
        ids, texts = rows["chunk_id"].combine_chunks(), rows["text"].to_pylist()
        found = count_terms(texts)
        begin = np.flatnonzero(np.diff(found.term, prepend=-1))
        ends = pa.array(np.concatenate([[0], len(ids) + np.append(begin, len(found.term))]), pa.int32())
        lengths = pa.array(found.total, mask=np.array([t is None for t in texts], bool))
        every = pa.array(np.concatenate([np.arange(len(ids)), found.text]))
        tfs = pa.array(np.concatenate([np.zeros(len(ids), np.int64), found.tf]))
        names = pa.concat_arrays([pa.array([""]), found.terms.take(pa.array(found.term[begin])).cast(pa.string())])
        yield pa.RecordBatch.from_arrays([names, *(pa.ListArray.from_arrays(ends, v) for v in (ids.take(every), tfs, lengths.take(every)))], names=["term", "ids", "tfs", "dls"])


class TextIndex:
    """Postings of chunks below ``root``. Chunk ids are unique; ``kind`` is their type."""

    def __init__(self, spark: SparkSession, root: str, kind: str = "string", buckets: int = 64) -> None:
        self.spark, self.kind, self.segments = spark, kind, Segments(spark, root)
        known = self.segments.committed()
        if any(f.get("layout") != LAYOUT for f in known.values()):
            raise ValueError(f"the index in {root} has single postings, as written before; it must be written anew")
        self.buckets = next((int(f["buckets"]) for f in known.values()), buckets)

    @property
    def lists(self) -> str:
        return f"term string, ids array<{self.kind}>, tfs array<long>, dls array<long>"

    @property
    def schema(self) -> str:
        return f"{self.lists}, bucket int"

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, segment: str, size: int) -> None:
        """rows: term, ids, tfs, dls. A bucket's files are dealt by chunk when it would be larger than a file should be."""
        slices = 1 + size // (self.buckets * FILE_BYTES)
        named = rows.withColumn("bucket", self._bucket(F.col("term")))
        # what a task puts in order is about a file's worth
        out = dealt(named, 1 + size // FILE_BYTES, "bucket", F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(slices))).sortWithinPartitions("bucket", "term").write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 4 << 20)
        out.partitionBy("bucket").parquet(self.segments.path("postings", segment))

    def add(self, chunks: DataFrame, segment: str, text: str = "lexical") -> int:
        """Index the chunks (chunk_id and a text) that no committed segment has; returns how many. Under a name that is committed, nothing is done if there are none."""
        fresh, committed = chunks.select("chunk_id", F.col(text).cast("string").alias("text")), self.segments.committed()
        if committed:
            # without any, texts stay where they are
            fresh = fresh.join(self.segments.read("lengths", f"chunk_id {self.kind}, dl long").select("chunk_id"), "chunk_id", "left_anti")
        cut = materialize(fresh.select(F.col("chunk_id").cast(self.kind), "text").mapInArrow(_lists, self.lists), "terms")
        lengths = cut.where("term = ''").select(F.inline(F.arrays_zip("ids", "dls")).alias("chunk_id", "dl"))
        # a chunk without a text is known, and counts for no mean
        facts = lengths.agg(F.count("*").alias("rows"), F.count("dl").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).first()
        if not facts["rows"]:
            return 0
        if segment in committed:
            raise ValueError(f"segment {segment} is committed, and there are {facts['rows']} chunks that it lacks")
        self._write(cut.where("term <> ''"), segment, input_bytes(cut))
        lengths.write.mode("overwrite").option("compression", "zstd").parquet(self.segments.path("lengths", segment))
        self.segments.commit(segment, buckets=self.buckets, layout=LAYOUT, **facts.asDict())
        return facts["rows"]

    def merge(self, segment: str) -> None:
        """One segment in place of all there are. Texts are not read."""
        old = self.segments.committed()
        if len(old) < 2 or segment in old:
            return
        rows = self.segments.read("postings", self.schema)
        self._write(rows.drop("bucket"), segment, input_bytes(rows))
        self.segments.read("lengths", f"chunk_id {self.kind}, dl long").write.mode("overwrite").option("compression", "zstd").parquet(self.segments.path("lengths", segment))
        sums = {k: sum(int(f[k]) for f in old.values()) for k in ("rows", "n", "total")}
        self.segments.commit(segment, list(old), buckets=self.buckets, layout=LAYOUT, **sums)

    def postings(self, asked: DataFrame, pool: DataFrame | None = None) -> Postings:
        """What ``retrieval.postings`` makes from texts, read from the index. asked: term; pool: chunk_id of a part of the chunks, or None for all.

        Up to FEW_TERMS asked terms are looked at on the driver: their buckets and names go into the scan.
        """
        rows = self.segments.read("postings", self.schema)
        found = asked.select("term", self._bucket(F.col("term")).alias("bucket")).limit(FEW_TERMS + 1).collect()
        few = len(found) <= FEW_TERMS
        if few:
            named = sorted({r["term"] for r in found})
            rows = rows.where(F.col("bucket").isin(sorted({r["bucket"] for r in found}))).where(F.col("term").isin(named))
        else:
            rows = rows.join(asked.select("term").distinct(), "term", "left_semi")
        counts = rows.groupBy("term").agg(F.sum(F.size("ids")).alias("df"))
        rows = rows.select("term", F.inline(F.arrays_zip("ids", "dls", "tfs")).alias("chunk_id", "dl", "tf")).select("chunk_id", "term", "dl", "tf")
        if pool is None:
            facts = self.segments.committed().values()
            n, total = (sum(int(f[k]) for f in facts) for k in ("n", "total"))
            stats = self.spark.createDataFrame([(n, total / n if n else None)], "n long, avgdl double")
        else:
            part = pool.select("chunk_id")
            # read for frequencies and for scores
            rows, counts = materialize(rows.join(part, "chunk_id", "left_semi"), "part"), None
            stats = self.segments.read("lengths", f"chunk_id {self.kind}, dl long").join(part, "chunk_id", "left_semi").agg(F.count("dl").alias("n"), F.avg("dl").alias("avgdl"))
        return Postings(rows, stats, few, counts)

    def frequency(self) -> DataFrame:
        """term, df of every term, from the index."""
        return self.segments.read("postings", self.schema).groupBy("term").agg(F.sum(F.size("ids")).alias("df"))

    def size(self) -> int:
        """How many chunks are indexed, with or without a text."""
        return sum(int(f["rows"]) for f in self.segments.committed().values())
