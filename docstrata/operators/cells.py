"""Approximate nearest neighbours: vectors lie by cells in small codes, a search reads the cells near its queries and scores the best again, exactly.

Cells are those of centroids that are fitted on a bounded sample (spherical k-means); every vector is assigned to the nearest. A
cell that holds many vectors is dealt to slices of bounded size. Codes are one byte for each dimension; the exact vectors lie
beside them by the same cells, and only those of candidates are scored. Vectors that come later are a further segment of the
same cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.operators.retrieval import _best, _usable, cosine, dense_top, top
from docstrata.sources.segments import Segments
from docstrata.storage import exists, materialize

SLICE = 65_536


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Directions of spherical k-means; empty cells are drawn anew from the sample."""
    draw = np.random.default_rng(seed)
    x = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-12)
    centroids = x[draw.choice(len(x), cells, replace=len(x) < cells)]
    for _ in range(rounds):
        near = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        empty = np.bincount(near, minlength=cells) == 0
        sums[empty] = x[draw.choice(len(x), int(empty.sum()))]
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


def _assigned(centroids: np.ndarray):
    """Rows of vectors with their cell, their code and its scale. Vectors of zero or other length, or with holes, are in no cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = _usable(batch, centroids.shape[1])
            norm = np.linalg.norm(x, axis=1) if len(x) else np.zeros(0)
            good = np.isfinite(norm) & (norm > 0)
            ids, unit = ids[good], x[good] / norm[good, None]
            cell = (unit @ centroids.T).argmax(axis=1) if len(unit) else np.zeros(0, np.int64)
            scale = np.maximum(np.abs(unit).max(axis=1), 1e-12) / 127 if len(unit) else np.zeros(0)
            codes = np.rint(unit / scale[:, None]).astype(np.int8) if len(unit) else np.zeros((0, centroids.shape[1]), np.int8)
            kind = batch.column("chunk_id").type
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(x[good].tolist(), pa.list_(pa.float64()))], names=["chunk_id", "cell", "code", "scale", "embedding"])

    return run


def _probes(centroids: np.ndarray, most: int):
    """A row for each query and cell that it visits, the nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = np.array([v if v is not None and len(v) == centroids.shape[1] and None not in v else [0.0] * centroids.shape[1] for v in batch.column("qvec").to_pylist()], np.float64).reshape(batch.num_rows, centroids.shape[1])
            cells = np.argsort(-(q @ centroids.T), axis=1, kind="stable")[:, :most]
            at = np.repeat(np.arange(batch.num_rows), cells.shape[1])
            usable = np.abs(q).sum(axis=1)[at] > 0
            taken = batch.take(pa.array(at[usable]))
            yield pa.RecordBatch.from_arrays([taken.column("query_id"), taken.column("qvec"), pa.array(cells.ravel()[usable].astype(np.int32))], names=["query_id", "qvec", "q_cell"])

    return run


def _scanned(n: int, scores_at_once: int = 1 << 24):
    """The n best of a slice for each of its queries, by codes."""

    def run(key: tuple, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return pa.table({"query_id": pa.array([], queries["query_id"].type if queries.num_rows else pa.int64()), "chunk_id": pa.array([], vectors["chunk_id"].type if vectors.num_rows else pa.int64()), "near": pa.array([], pa.float64())})
        codes = np.frombuffer(b"".join(vectors["code"].to_pylist()), np.int8).reshape(vectors.num_rows, -1).astype(np.float32)
        x = codes * vectors["scale"].to_numpy().astype(np.float32)[:, None]
        ids = vectors["chunk_id"].to_numpy()
        q = np.array(queries["qvec"].to_pylist(), np.float32)
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        step, found = max(1, scores_at_once // len(x)), []
        for a in range(0, len(q), step):
            found += [_best(ids, s, n) for s in (q[a : a + step] @ x.T).astype(np.float64)]
        own = queries["query_id"].combine_chunks().take(pa.array(np.repeat(np.arange(len(found)), [len(i) for i, _ in found])))
        return pa.table({"query_id": own, "chunk_id": pa.array(np.concatenate([i for i, _ in found]), vectors["chunk_id"].type), "near": pa.array(np.concatenate([s for _, s in found]))})

    return run


class CellIndex:
    """Vectors below ``root``. ``kind``: type of chunk_id. Centroids are fitted at the first ``add``, on at most ``sample`` vectors, and are as many as ``cells``, or the root of the number of vectors."""

    def __init__(self, spark: SparkSession, root: str, kind: str = "long", cells: int | None = None, sample: int = 65_536, most_cells: int = 16_384) -> None:
        self.spark, self.root, self.kind, self.cells, self.sample, self.most_cells = spark, root.rstrip("/"), kind, cells, sample, most_cells
        self.segments = Segments(spark, root)

    def centroids(self) -> np.ndarray:
        """A row for each cell: bounded by ``most_cells``."""
        rows = self.spark.read.parquet(f"{self.root}/centroids").orderBy("cell").toArrow()
        return np.array(rows["centroid"].to_pylist(), np.float64)

    def _fit(self, vectors: DataFrame) -> None:
        n = vectors.count()
        cells = min(self.cells or max(1, round(n**0.5)), self.most_cells, max(1, n))
        share = min(1.0, 1.2 * self.sample / n) if n else 1.0
        some = vectors.where("embedding IS NOT NULL").select("chunk_id", "embedding")
        # by a hash of the id: the same sample whatever the partitions
        some = some.where(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 20)) < int(share * (1 << 20))).limit(self.sample).toArrow()
        lengths = [len(v) for v in some["embedding"].to_pylist()]
        dim = max(set(lengths), key=lengths.count) if lengths else 1
        x = np.array([v for v in some["embedding"].to_pylist() if len(v) == dim and None not in v and any(v)], np.float64).reshape(-1, dim)
        found = fit_centroids(x, min(cells, len(x))) if len(x) else np.ones((1, dim))
        self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(found)], "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/centroids")

    def add(self, vectors: DataFrame, segment: str) -> None:
        """Index vectors (chunk_id, embedding); ids that committed segments have are left out."""
        known = self.segments.read("codes", self._codes).select("chunk_id")
        fresh = vectors.select("chunk_id", "embedding").join(known, "chunk_id", "left_anti")
        if not exists(self.spark, f"{self.root}/centroids"):
            self._fit(vectors)
        schema = f"chunk_id {self.kind}, cell int, code binary, scale double, embedding array<double>"
        held = materialize(fresh.mapInArrow(_assigned(self.centroids()), schema), "cells")
        counts = held.groupBy("cell").count()
        slices = counts.select("cell", F.ceil(F.col("count") / SLICE).cast("int").alias("slices"))
        # a row for each cell
        dealt = held.join(F.broadcast(slices), "cell").withColumn("slice", F.pmod(F.xxhash64("chunk_id"), F.col("slices")).cast("int")).drop("slices").repartition("cell", "slice").sortWithinPartitions("cell", "slice", "chunk_id")
        for table, columns in (("codes", ("cell", "slice", "chunk_id", "code", "scale")), ("vectors", ("cell", "chunk_id", "embedding"))):
            dealt.select(*columns).write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 8 << 20).partitionBy("cell").parquet(self.segments.path(table, segment))
        self.segments.commit(segment)

    @property
    def _codes(self) -> str:
        return f"slice int, chunk_id {self.kind}, code binary, scale double, cell int"

    def codes(self, cells: list[int] | None = None) -> DataFrame:
        rows = self.segments.read("codes", self._codes)
        return rows if cells is None else rows.where(F.col("cell").isin(cells))

    def tune(self, goal: float = 0.95, n: int = 6, queries: int = 256) -> int:
        """The fewest probes that find the share ``goal`` of the n nearest of some indexed vectors, measured by an exact search, and kept for searches."""
        vectors = self.segments.read("vectors", f"chunk_id {self.kind}, embedding array<double>, cell int")
        rows = max(1, vectors.count())
        share = min(1.0, 1.2 * queries / rows)
        some = vectors.where(F.pmod(F.xxhash64("chunk_id", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20))).limit(queries).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("qvec"))
        some = materialize(some, "tuning")
        near = dense_top(vectors.select("chunk_id", "embedding"), some, n + 1).where("query_id <> chunk_id")
        # a bounded number of rows: the sample's neighbours
        found = near.join(vectors.select("chunk_id", "cell"), "chunk_id").join(some, "query_id").select("qvec", "cell").collect()
        centroids = self.centroids()
        places = np.sort([int(np.flatnonzero(np.argsort(-(centroids @ np.array(r["qvec"])), kind="stable") == r["cell"])[0]) for r in found])
        probes = int(places[min(len(places) - 1, int(np.ceil(goal * len(places))) - 1)]) + 1 if len(places) else 1
        self.spark.createDataFrame([(probes, goal)], "probes int, goal double").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/probes")
        return probes

    def probes(self) -> int:
        """What ``tune`` has found, or 8."""
        return self.spark.read.parquet(f"{self.root}/probes").first()["probes"] if exists(self.spark, f"{self.root}/probes") else 8

    def search(self, queries: DataFrame, n: int, probes: int | None = None, candidates: int | None = None) -> DataFrame:
        """query_id, chunk_id, score, rank: as ``dense_top`` has them, of the vectors in the ``probes`` nearest cells; ``candidates`` are scored exactly. queries: query_id, qvec, a stated set."""
        probes = probes or self.probes()
        asked = materialize(queries.where("qvec IS NOT NULL").select("query_id", F.col("qvec").cast("array<double>").alias("qvec")), "asked")
        kind = asked.schema["query_id"].dataType.simpleString()
        visits = materialize(asked.mapInArrow(_probes(self.centroids(), probes), f"query_id {kind}, qvec array<double>, q_cell int"), "visits")
        cells = sorted(r["q_cell"] for r in visits.select("q_cell").distinct().collect())  # no more than there are cells
        read = self.codes(cells)
        pieces = read.select(F.col("cell").alias("p_cell"), F.col("slice").alias("p_slice")).distinct()
        spread = visits.join(pieces, visits["q_cell"] == pieces["p_cell"]).select("query_id", "qvec", "q_cell", F.col("p_slice").alias("q_slice"))
        most = max(n, candidates or 4 * n)
        near = read.groupBy("cell", "slice").cogroup(spread.groupBy("q_cell", "q_slice")).applyInArrow(_scanned(most), f"query_id {kind}, chunk_id {self.kind}, near double")
        best = top(near, most, F.desc("near"), F.asc("chunk_id")).select("query_id", "chunk_id")
        exact = self.segments.read("vectors", f"chunk_id {self.kind}, embedding array<double>, cell int").where(F.col("cell").isin(cells)).select("chunk_id", "embedding")
        scored = best.join(exact, "chunk_id").join(asked, "query_id").select("query_id", "chunk_id", F.round(cosine(F.col("embedding"), F.col("qvec")), 6).alias("score"))
        return top(scored, n, F.desc("score"), F.asc("chunk_id"))

    def share_read(self, queries: DataFrame, probes: int | None = None) -> float:
        """Share of the files with codes that the queries' search reads."""
        probes = probes or self.probes()
        asked = queries.where("qvec IS NOT NULL").select("query_id", F.col("qvec").cast("array<double>").alias("qvec"))
        kind = asked.schema["query_id"].dataType.simpleString()
        cells = [r["q_cell"] for r in asked.mapInArrow(_probes(self.centroids(), probes), f"query_id {kind}, qvec array<double>, q_cell int").select("q_cell").distinct().collect()]
        every = self.codes().inputFiles()
        return sum(int(f.split("/cell=")[1].split("/")[0]) in set(cells) for f in every) / max(1, len(every))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact (query_id, chunk_id) that were found."""
    one = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0)))).first()
    return one[0] or 0.0
