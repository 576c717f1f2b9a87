"""Connected components over links, distributed, and the local forests that keep the links few."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.storage import materialize, release


def local_roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For vertices 0..n-1 and links (u, v): the smallest vertex of each one's component."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            break
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star step and one small-star step over distinct links with a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    down = large.groupBy("a").agg(F.min("b").alias("m"))
    joined = large.join(down, "a")
    small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
    return small.distinct()


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Links (a, b) of longs to (vertex, root): root is the smallest vertex reachable.

    Vertices without a link to another one do not occur in the result. Each round is written to the
    shared folder; only a count and a checksum come to the driver. The number of rounds grows with
    the logarithm of the longest shortest path.
    """
    tidy = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen = materialize(tidy, "links"), None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("a").alias("vertex"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct())
        seen, before = mark, now
        now = materialize(_stars(before), "links")
        release(before)
    raise RuntimeError(f"links have not settled after {most_rounds} rounds")


def in_tiles(keyed: DataFrame, keys: list[str], row: str, tile: int) -> DataFrame:
    """Deal groups into cells of bounded size so that any two rows of a group meet in one cell.

    Rows of groups with one row are dropped (no pair). A group of up to ``tile`` rows is one cell
    (0, 0); a larger one is cut into slices by a hash of ``row``, and a row goes to each cell (own
    slice, other slice). Adds part, cell_a, cell_b.
    """
    sizes = keyed.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    slices = F.ceil(F.col("n") / tile)
    return (
        keyed.join(sizes, keys)
        .withColumn("slices", slices)
        .withColumn("part", F.pmod(F.xxhash64(F.lit(7), row), F.col("slices")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
        .withColumn("cell_a", F.least("part", "other"))
        .withColumn("cell_b", F.greatest("part", "other"))
        .drop("n", "slices", "other")
    )


def gathered(cells: DataFrame, keys: list[str], partitions: int, *order: str) -> DataFrame:
    """Rows of a cell side by side in one partition, for ``whole_cells``; Spark's sort spills, so a partition need not fit in memory."""
    by = [*keys, "cell_a", "cell_b"]
    return cells.repartition(partitions, *by).sortWithinPartitions(*by, *order)


def whole_cells(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 65_536) -> Iterator[pa.Table]:
    """The sorted rows of a partition in tables of whole cells: about ``rows`` rows at a time are held, and one cell at least."""
    by, held, n = [*keys, "cell_a", "cell_b"], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        new = cell_starts(table, by)
        last = int(new[-1])
        if last:
            yield table.slice(0, last)
            # a copy, so that the rest does not hold on to all that was read
            rest = table.slice(last)
            held, n = rest.take(pa.array(np.arange(rest.num_rows))).to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def cell_starts(table: pa.Table, by: list[str]) -> np.ndarray:
    """Where a new cell begins."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for name in by:
        column = table[name].combine_chunks()
        new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)
