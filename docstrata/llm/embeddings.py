"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside cells.

The centres are fitted on a bounded sample; every vector is assigned. For unit vectors x and y in
different cells, the distances of x and y to the plane between the two centres add up to |x - y| at
most, so one of them is within half of the threshold's chord of the plane. A vector that near to a
plane also visits the cell behind it, which makes the search exact: no pair is lost at a border. A
pair is counted in one cell only. Equal vectors of a label are one vertex with a weight.

Defined results: labels of any type are compared as text; vectors that are null, empty, zero or hold null or
non-finite components, and rows with a null label, have no links and are kept; vectors of different lengths never
link; a cosine equal to the threshold links; a repeated row is a vector of its own; rows that share an id but
not the vector stand together, each with the links of all of them; a null id is smaller than any other; an empty table gives an empty one; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.components import cell_starts, connected, gathered, in_tiles, local_roots, whole_cells
from docstrata.llm.storage import materialize, partitions_for


def _unit(lists: pa.Array) -> np.ndarray:
    x = np.asarray(lists.flatten(), dtype=np.float64).reshape(len(lists), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """k unit centres of unit vectors x; an empty cell keeps its centre."""
    centres = x[np.sort(np.random.default_rng(seed).choice(len(x), k, replace=False))]
    for _ in range(rounds):
        at = (x @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), centres)
    return centres


def fit_centres(rows: DataFrame, sample: int, per_cell: int, most_cells: int) -> dict[tuple[str, int], np.ndarray]:
    """Centres for each (label, dimension) in a sample of about ``sample`` rows, chosen by a hash of the id; twice as many at most, the first by another hash."""
    n = rows.count()
    cells = max(1, min(most_cells, n // per_cell))
    chosen = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n // sample)))) == 0).select("label", "embedding", "vec_id")
    picked = chosen.orderBy(F.xxhash64(F.lit(3), "vec_id"), "vec_id", F.xxhash64("embedding")).limit(2 * sample).toArrow().sort_by([("vec_id", "ascending"), ("label", "ascending")])
    out, labels = {}, np.array(picked["label"].to_pylist(), object)
    sizes = np.array([len(v) for v in picked["embedding"]], int)
    for label, dim in sorted({*zip(labels.tolist(), sizes.tolist())}):
        own = np.flatnonzero((labels == label) & (sizes == dim))
        x = _unit(pa.concat_arrays([picked["embedding"].combine_chunks()]).take(pa.array(own)))
        k = max(1, min(len(own), round(cells * len(own) / picked.num_rows)))
        out[label, dim] = spherical_kmeans(x, k)
    return out


def assign(x: np.ndarray, centres: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """The home cell of each row, and which cells it visits: those whose border plane is within ``margin``."""
    dots = x @ centres.T
    home = dots.argmax(axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))[home]
    visits = dots[np.arange(len(x)), home][:, None] - dots <= margin * apart + 1e-9
    visits[np.arange(len(x)), home] = False
    return home, visits


def _cells(centres: dict, margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, dims = np.array(batch.column("label").to_pylist(), object), np.array([len(v) for v in batch.column("embedding")], int)
            for label, dim in sorted({*zip(labels.tolist(), dims.tolist())}):
                own = np.flatnonzero((labels == label) & (dims == dim))
                rows = batch.take(pa.array(own))
                x = _unit(rows.column("embedding"))
                known = centres.get((label, dim))
                home, visits = assign(x, known, margin) if known is not None else (np.zeros(len(x), int), np.zeros((len(x), 1), bool))
                at, to = np.nonzero(visits)
                seen = np.split(to, np.searchsorted(at, np.arange(1, len(x))))
                take, cell = np.concatenate([np.arange(len(x)), at]), np.concatenate([home, to])
                out = rows.take(pa.array(take))
                lists = pa.array([s.tolist() for s in seen], pa.list_(pa.int32())).take(pa.array(take))
                names = ["rep", "label", "weight", "embedding"]
                yield pa.RecordBatch.from_arrays([*(out.column(n) for n in names), pa.array(dims[own][take].astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(home[take].astype(np.int32)), lists], names=[*names, "dim", "cell", "home", "visits"])

    return run


NO_ID = -(1 << 63)
CELL_SCHEMA = "rep long, label string, weight long, embedding array<{}>, dim int, cell int, home int, visits array<int>"


CELL = ["label", "dim", "cell"]


def cell_links(t: pa.Table, threshold: float, block: int = 512) -> pa.RecordBatch | None:
    """Links of the rows of one cell, in id order: for each row that has any, how many (by weight) and the smallest row that it reaches here.

    Only rows at home here are multiplied with the others: two visitors are counted where one of them is at home. A row at
    home and a visitor are counted here unless the row also visits the visitor's home and that one is the smaller cell.
    """
    home, weight, part, rep = t["home"].to_numpy(), t["weight"].to_numpy(), t["part"].to_numpy(), t["rep"].to_numpy()
    cell, across = t["cell"][0].as_py(), t["cell_a"][0].as_py() != t["cell_b"][0].as_py()
    at_home = home == cell
    own, guest = np.flatnonzero(at_home), np.flatnonzero(~at_home)
    if not len(own):
        return None
    order = np.concatenate([own, guest])
    x = _unit(t["embedding"].combine_chunks())[order]
    weight, part, home, m = weight[order], part[order], home[order], len(own)
    # which of the guests' homes the rows at home visit
    others, at = np.unique(home[m:], return_inverse=True)
    sees = np.zeros((m, len(others)), bool)
    lists = t["visits"].combine_chunks().take(pa.array(own))
    rows, cells = np.repeat(np.arange(m), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
    if len(others) and len(cells):
        place = np.minimum(np.searchsorted(others, cells), len(others) - 1)
        known = others[place] == cells
        sees[rows[known], place[known]] = True
    elsewhere = (sees & (others < cell))[:, at]
    counts, us, vs = np.zeros(len(x), np.int64), [], []
    for a in range(0, m, block):
        near = x[a : min(a + block, m)] @ x.T >= threshold
        if across:
            near &= part[a : a + len(near), None] != part[None]
        near[:, m:] &= ~elsewhere[a : a + len(near)]
        near[np.arange(len(near)), np.arange(a, a + len(near))] = False
        i, j = np.nonzero(near)
        i += a
        # rows at home find each other from both sides, a guest is told
        np.add.at(counts, i, weight[j])
        told = j >= m
        np.add.at(counts, j[told], weight[i[told]])
        us.append(order[i])
        vs.append(order[j])
    if not counts.any():
        return None
    # the smallest id becomes the root: rows are in id order
    root = local_roots(len(x), np.concatenate(us), np.concatenate(vs))
    links = np.zeros(len(x), np.int64)
    links[order] = counts
    i = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(rep[i]), pa.array(links[i]), pa.array(rep[root[i]])], names=["rep", "links", "root"])


def _cell_links(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_cells(batches, CELL, 16_384):
            starts = cell_starts(table, [*CELL, "cell_a", "cell_b"]).tolist()
            for a, b in zip(starts, [*starts[1:], table.num_rows]):
                if b - a > 1 and (out := cell_links(table.slice(a, b - a), threshold)) is not None:
                    yield out

    return run


def embedding_groups(vectors: DataFrame, threshold: float = 0.98, sample: int = 16_384, per_cell: int = 400, most_cells: int = 1024, tile: int = 8192) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of (vec_id, embedding, label).

    The fit sees about ``sample`` rows (twice that at most) and makes up to ``most_cells`` cells, one for ``per_cell`` rows; a
    label that the sample lacks is one cell. Cells of more than ``tile`` rows, guests included, are cut into slices.
    """
    kind = "double" if vectors.schema["embedding"].dataType.simpleString() == "array<double>" else "float"
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda v: v != 0)
    # a null id is smaller than any other
    base = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(f"array<{kind}>").alias("embedding")).withColumn("usable", F.coalesce(usable, F.lit(False)))
    base = base.withColumn("k1", F.xxhash64(F.lit(1), "label", "embedding")).withColumn("k2", F.xxhash64(F.lit(2), "embedding", "label"))
    distinct = base.where("usable").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    reps = materialize(distinct, "vectors")
    centres = fit_centres(reps.withColumnRenamed("rep", "vec_id"), sample, per_cell, most_cells)
    margin = math.sqrt(2 - 2 * threshold) / 2
    cells = materialize(reps.mapInArrow(_cells(centres, margin), CELL_SCHEMA.format(kind)), "cells")
    tiles = gathered(in_tiles(cells, CELL, "rep", tile), CELL, partitions_for(vectors.sparkSession, cells.count(), 200_000), "rep")
    found = materialize(tiles.mapInArrow(_cell_links(threshold), "rep long, links long, root long"), "vector-links")
    roots = connected(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    stats = reps.select("k1", "k2", "rep", "weight").join(links, "rep", "left").join(roots.withColumnRenamed("vertex", "rep"), "rep", "left")
    stats = stats.select("k1", "k2", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    usable_rows = base.where("usable").select("vec_id", "k1", "k2").join(stats, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = base.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    rows = usable_rows.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
    return rows.withColumns({c: F.nullif(c, F.lit(NO_ID)) for c in ("vec_id", "component_id")})


def oracle(threshold: float = 0.98) -> str:
    """DuckDB: the same by a plain join on the label."""
    return f"""WITH RECURSIVE usable AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
unit AS (SELECT *, sqrt(list_inner_product(e, e)) AS norm FROM usable),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= {threshold}),
reach AS (SELECT DISTINCT a AS v, a AS r FROM links UNION SELECT reach.v, links.b FROM reach JOIN links ON links.a = reach.r),
least AS (SELECT v, min(r) AS r FROM reach GROUP BY 1), counted AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, coalesce(l.r, e.vec_id) AS component_id, coalesce(l.r, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN least l ON l.v = e.vec_id LEFT JOIN counted c ON c.a = e.vec_id"""
