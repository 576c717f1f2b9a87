"""Token ids of whole documents as ORC files in the order of the document ids, and reading them back.

Documents are dealt by ranges of their id, sorted, encoded as a stream and written with ORC's integer run-length encoding, row
indexes and a Bloom filter on the id. A file holds a range of ids; its rows say where they start in it, and a small table of the
files says where each file starts, so that any stripe is read by itself, and a lookup reads the stripes only whose indexes and
filters let its ids pass.

Defined results: a null or empty text is the end token alone; texts of any length are encoded whole; null ids come first; rows
that share an id stand in the order of the input, each with its own ids; an empty table gives an empty store; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docstrata.llm.packing import encoder
from docstrata.llm.storage import scan_blocks, scratch, shuffles_dropped

ROWS = "part int, doc_id long, start long, n_tokens long, ids array<int>"
PARTS = "part int, n_docs long, n_tokens long, first_id long, last_id long, start long"
BLOCK_BYTES = 64 << 20
BATCH_TOKENS = 1 << 18
# Texts that are encoded together: each different word of them is looked up once.
BLOCK_CHARS = 2_000_000
BLOCK_TEXTS = 10_000
# Words that a worker remembers, in each of two generations: fewer than for packing, since the files' writer takes memory, too.
MEMO = 500_000


def _encoded(path: str, end_id: int):
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, start = encoder(path, MEMO), TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        held: list[str] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal start
            ids, at = enc.encode_all(held, end)
            i = 0
            while i < len(docs):
                j = max(i + 1, int(np.searchsorted(at, at[i] + BATCH_TOKENS, "right")) - 1)
                own = pa.ListArray.from_arrays(pa.array(at[i : j + 1] - at[i], pa.int32()), pa.array(ids[at[i] : at[j]].view("<i4")))
                out = [pa.array([part] * (j - i), pa.int32()), pa.array(docs[i:j], pa.int64()), pa.array(start + at[i:j]), pa.array(np.diff(at[i : j + 1])), own]
                yield pa.RecordBatch.from_arrays(out, names=["part", "doc_id", "start", "n_tokens", "ids"])
                i = j
            start += int(at[-1])
            docs.clear()
            held.clear()

        waiting = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs.append(doc)
                held.append(text.as_py() or "")
                waiting += len(held[-1])
                if waiting >= BLOCK_CHARS or len(held) >= BLOCK_TEXTS:
                    yield from flush()
                    waiting = 0
        if docs:
            yield from flush()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, stripe_bytes: int = 64 << 20, index_rows: int = 1000, bloom_fpp: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the store below ``path``: ``ids``, the ORC files, and ``parts``, a row for each file. ``tokenizer``: a file that is there on every machine."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("at"))
    # the place in the input splits an id that very many rows share; ranges are cut by ids and places alone
    dealt = rows.repartitionByRange(scan_blocks(docs, BLOCK_BYTES), "doc_id", "at").sortWithinPartitions("doc_id", "at").select("doc_id", "text")
    writer = dealt.mapInArrow(_encoded(tokenizer, end_id), ROWS).write.format("orc")
    options = {"compression": "zstd", "orc.stripe.size": stripe_bytes, "orc.row.index.stride": index_rows, "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": bloom_fpp}
    with shuffles_dropped(spark):
        writer.options(**options).save(f"{path}/ids")
    found = spark.read.schema(ROWS).orc(f"{path}/ids").groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    # a row for each file: the window is over those
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    found.withColumn("start", F.coalesce(before, F.lit(0))).select("part", "n_docs", "n_tokens", "first_id", "last_id", "start").coalesce(1).write.format("orc").save(f"{path}/parts")


def parts(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file that holds rows: its ids' range and where it starts in the whole."""
    return spark.read.schema(PARTS).orc(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame:
    """doc_id, start (in the whole store), n_tokens, ids. ``only``: these documents, found by row indexes and Bloom filters."""
    rows = spark.read.schema(ROWS).orc(f"{path}/ids")
    if only is not None:
        rows = rows.where(F.col("doc_id").isin(only))
    # the broadcast side has a row for each file
    placed = rows.join(F.broadcast(parts(spark, path).select("part", F.col("start").alias("before"))), "part")
    return placed.select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(2)
        data, cut = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4"), ids.offsets.to_numpy()
        crcs = [zlib.crc32(data[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(cut).astype(np.int64)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_report(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files of a store that is written for it."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write_tokens(docs, path, tokenizer, **options)
    back = read_tokens(spark, path).select("doc_id", "start", "ids")
    return back.mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


