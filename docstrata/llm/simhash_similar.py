"""SimHash near-duplicates by similarity: five-word shingles, linked at a Jaccard similarity of about 0.8 or more.

A fingerprint of 512 bits over the distinct shingles tells the angle between two sets, and so, for texts of like length,
their Jaccard similarity: at 0.8 two fingerprints differ in 78 bits on average, with a deviation of 8, at 0.7 in 99. The radius of 91
bits keeps 95 of 100 pairs at exactly 0.8, and nearly all above 0.85; of pairs at 0.7 it links about one in five.
No cell of fingerprint bits holds pairs that differ in so many, so cells are bands of four minimum hashes, ten of them: a pair of 0.8
meets in one with a probability of 0.995, one of 0.3 with 0.08.

Inside a cell no pair within one component has to be compared. First every member meets three pivots of its cell, which joins a large
group of copies in one round; then, in cells with members of different components, those outside of the largest one meet
all, by tiles with exclusive-or and bit counts, and tile pairs whose bit counts differ by more than the radius are skipped. A large cell is
cut into slices; members of the largest component are in one each, the others in all of them. So only a cell that holds very many texts of
different components is compared at a cost above its size. Links within the cells are exact for the radius; only forest links leave a task.

Defined results: null and blank texts have no shingle, fingerprint zero, and are near-duplicates of each other only; a text of fewer words is
one shingle; texts of any length are read whole; equal fingerprints are one vertex; an empty table gives an empty one; a null id comes after any
other; further columns are ignored, whatever their names. Of texts with fewer than about ten shingles, half of which are
shared, the angle tells less: their link may be wrong by one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.llm.components import cell_starts, connected, gathered, local_roots, whole_cells
from docstrata.llm.simhash import text_key
from docstrata.llm.storage import materialize, partitions_for, release
from docstrata.llm.workers import make_room

SHINGLE, RADIUS = 5, 91
LANES, BANDS, ROWS, PIVOTS = 8, 10, 4, 3
PRINT, CELL = [f"p{i}" for i in range(LANES)], ["block", "key"]

_draw = np.random.default_rng(20)
_LANES = _draw.integers(0, 1 << 64, LANES, dtype=np.uint64)
_ORDERS = _draw.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_M, _N = (_draw.integers(0, 1 << 64, 1, dtype=np.uint64)[0] | np.uint64(1) for _ in range(2))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M
    x = (x ^ (x >> np.uint64(29))) * _N
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct word shingles, in order."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    of = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([of(b" ".join(parts))], np.uint64)
    each = np.fromiter(map(of, parts), np.uint64, len(parts))
    h = np.zeros(len(parts) - words + 1, np.uint64)
    for i in range(words):
        h = _mixed(h + each[i : len(h) + i])
    return np.unique(h)


def sketch(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint as eight numbers, and a key for each band; a text without words has no band."""
    h = shingles(text)
    if not len(h):
        return np.zeros(LANES, np.uint64), np.zeros(0, np.uint64)
    counts, least = np.zeros(64 * LANES, np.int64), np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(h), 4096):
        part = h[a : a + 4096]
        np.minimum(least, (part[:, None] * _ORDERS).min(axis=0), out=least)
        bits = np.unpackbits(_mixed(part[:, None] ^ _LANES).astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little")
        for b in range(0, len(bits), 255):  # counts of up to 255 fit a byte
            counts += bits[b : b + 255].sum(axis=0, dtype=np.uint8)
    keys = np.zeros(BANDS, np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = _mixed(keys + row)
    return np.packbits(2 * counts > len(h), bitorder="little").view("<u8"), keys


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make_room("simhash")
    for batch in batches:
        made = [sketch(t.as_py()) for t in batch.column(2)]
        prints = np.array([p for p, _ in made], np.uint64).reshape(-1, LANES)
        vertex = np.array([xxhash.xxh64_intdigest(p.tobytes()) for p in prints], np.uint64)
        ends = np.cumsum([0, *(len(k) for _, k in made)])
        keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *(k for _, k in made)]).view(np.int64)))
        lanes = [pa.array(np.ascontiguousarray(lane).view(np.int64)) for lane in prints.T]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vertex.view(np.int64)), *lanes, keys], names=["doc_id", "text_key", "vertex", *PRINT, "bands"])


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, vertex (a hash of the fingerprint), p0 to p7, bands."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(id_col, text_col).alias("text_key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_sketches, f"doc_id long, text_key long, vertex long, {', '.join(f'{p} long' for p in PRINT)}, bands array<long>")


def tile_roots(prints: np.ndarray, rest: np.ndarray, radius: int, tile: int = 256) -> np.ndarray:
    """For the rows of one cell, the first row of each one's component, over pairs at most ``radius`` bits apart of which one is of the ``rest``."""
    ones = np.bitwise_count(prints).sum(axis=1, dtype=np.int64)
    order = np.argsort(ones, kind="stable")
    x, ones, rest, n = prints[order], ones[order], rest[order], len(prints)
    root = np.arange(n)
    for a in range(0, n, tile):
        top, some = ones[min(a + tile, n) - 1], rest[a : a + tile]
        us, vs = [np.arange(n)], [root]
        for b in range(a, n, tile):
            if ones[b] - top > radius:
                break
            others = rest[b : b + tile]
            if not (some.any() or others.any()):
                continue
            apart = np.bitwise_count(x[a : a + tile, None] ^ x[None, b : b + tile]).sum(axis=2, dtype=np.int16)
            i, j = np.nonzero((apart <= radius) & (some[:, None] | others[None]))
            us.append(order[a + i])
            vs.append(order[b + j])
        # a forest is all that is held of the tiles so far
        root = local_roots(n, np.concatenate(us), np.concatenate(vs))
    return root


def _rest_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_cells(batches, CELL, rows=16_384):
            prints, rest = np.stack([table[p].to_numpy().view(np.uint64) for p in PRINT], axis=1), table["rest"].to_numpy()
            vertex = table["vertex"].to_numpy()
            edges = [*cell_starts(table, [*CELL, "cell_a", "cell_b"]), len(prints)]
            root = np.concatenate([s + tile_roots(prints[s:e], rest[s:e], radius) for s, e in zip(edges, edges[1:])])
            i = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(vertex[i]), pa.array(vertex[root[i]])], names=["a", "b"])

    return run


def _apart(a: str, b: str) -> Column:
    return reduce(Column.__add__, (F.bit_count(F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}"))) for p in PRINT))


def similar_roots(vertices: DataFrame, radius: int = RADIUS, tile: int = 2048) -> DataFrame:
    """(vertex, root) of all vertices that are linked. vertices: distinct ``vertex``, with its p0 to p7 and bands."""
    prints = vertices.select("vertex", *PRINT)
    keyed = vertices.select("vertex", F.posexplode("bands").alias("block", "key"))
    pivots = [F.min_by("vertex", F.xxhash64(F.lit(j), "vertex")).alias(f"v{j}") for j in range(PIVOTS)]
    shared = keyed.groupBy(*CELL).agg(F.count("*").alias("n"), *pivots).where("n > 1")
    met = materialize(keyed.join(shared, CELL), "met")
    asked = met.select("vertex", F.explode(F.array(*(f"v{j}" for j in range(PIVOTS)))).alias("pivot")).where("vertex <> pivot").distinct()
    ends = asked.join(prints.alias("x"), "vertex").select("pivot", F.struct("vertex", *PRINT).alias("x")).alias("l")
    both = ends.join(prints.alias("y"), F.col("l.pivot") == F.col("y.vertex"))
    stars = materialize(both.where(_apart("x", "y") <= radius).select(F.col("x.vertex").alias("a"), F.col("l.pivot").alias("b")), "stars")
    roots = connected(stars)
    release(stars)

    rows = met.select(*CELL, "vertex", "n").join(roots, "vertex", "left").withColumn("root", F.coalesce("root", "vertex"))
    # counted by component first, so that a hot cell is a few rows
    parts = rows.groupBy(*CELL, "root").agg(F.count("*").alias("c"))
    open_cells = parts.groupBy(*CELL).agg(F.count("*").alias("parts"), F.max_by("root", F.struct("c", "root")).alias("main")).where("parts > 1")
    slices = F.ceil(F.col("n") / tile)
    own = F.pmod(F.xxhash64(F.lit(7), "vertex"), slices)
    dealt = (
        rows.where("n > 2")  # of two, one is a pivot
        .join(open_cells, CELL)
        .withColumn("rest", F.col("root") != F.col("main"))
        .withColumn("cell_a", F.explode(F.when(F.col("rest"), F.sequence(F.lit(0).cast("long"), slices - 1)).otherwise(F.array(own))))
        .select(*CELL, "vertex", "rest", "cell_a", F.lit(0).cast("long").alias("cell_b"))
    )
    cells = gathered(dealt.join(prints, "vertex"), CELL, partitions_for(prints.sparkSession, met.count()))
    links = roots.select(F.col("vertex").alias("a"), F.col("root").alias("b")).unionByName(cells.mapInArrow(_rest_links(radius), "a long, b long"))
    return connected(links)


def similar_keepers(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """kept_id, kept_key: one row of each component, that with the smallest id (none comes last) and, of the texts under that id, the smallest ``text_key``."""
    made = materialize(sketches(docs, id_col, text_col), "sketches")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    vertices = materialize(made.groupBy("vertex").agg(least.alias("least"), *(F.first(c).alias(c) for c in [*PRINT, "bands"])), "vertices")
    release(made)
    placed = vertices.select("vertex", "least").join(similar_roots(vertices, radius), "vertex", "left")
    return placed.groupBy(F.coalesce("root", "vertex").alias("root")).agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias("kept_id"), F.col("least.text_key").alias("kept_key"))
