"""SimHash near-duplicates: 64-bit fingerprints, linked at a small Hamming distance, exactly.

Fingerprints are compared in tiles with exclusive-or and bit counts; a tile pair whose bit counts
differ by more than the radius is skipped. To keep the comparison from growing with the square of the
corpus, the tiles are cut from cells in which two of five bit blocks agree: with at most three
differing bits, at least two blocks always do, so no link is lost. Equal fingerprints are one
vertex. Hot cells are cut into slices that meet pairwise. Only forest links leave a task. Cells hold 26 bits, so
their size, and the work on each fingerprint, begins to grow beyond 2**26 distinct fingerprints.

Defined results: a null or blank text has fingerprint zero and is linked like any other; texts of any length are
read whole; a bit set in exactly half of the hashes is 0; repeated rows stay one row each in the result,
those that share an id each in the component of its text; a null id is the smallest of its component only
if there is no other; an empty table gives an empty one; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.llm.components import cell_starts, connected, gathered, in_tiles, local_roots, whole_cells
from docstrata.llm.storage import materialize, partitions_for
from docstrata.llm.workers import make_room

SEED = 42


def fingerprint(text: str | None, words: int = 3, seed: int = SEED) -> int:
    """Bit k is set if it is set in more than half of the hashes of the text's word shingles."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = list(accumulate(map(len, parts)))
        ends = [e + i for i, e in enumerate(ends)]
        starts = [0, *(e + 1 for e in ends)]
        of = xxhash.xxh64_intdigest
        hashes = [of(joined[s:e], seed) for s, e in zip(starts, ends[words - 1 :])]
    h = np.array(hashes, dtype="<u8")
    counts = np.zeros(64, np.int64)
    for a in range(0, len(h), 65536):
        counts += np.unpackbits(h[a : a + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make_room("simhash")
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column(2)], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], names=["doc_id", "text_key", "print"])


def text_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Tells rows with one id but different texts apart, and no id from any."""
    return F.xxhash64(F.lit(11), F.col(id_col).isNull(), F.col(text_col))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, print (the fingerprint as a signed number)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(id_col, text_col).alias("text_key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, text_key long, print long")


def _tile_links(prints: np.ndarray, part: np.ndarray, across: bool | np.ndarray, radius: int, tile: int = 64, cell: np.ndarray | None = None, most: int = 256) -> tuple[list, list]:
    """Links inside cells, by tiles over rows in order of cell and bit count. across: only between slices (said of all rows, or of each).

    A tile is compared with itself and with the tiles after it, as long as its last row and the other's first one are of one
    cell and their bit counts differ by at most the radius. ``most`` tile pairs are compared at once.
    """
    n = len(prints)
    cell = np.zeros(n, np.int64) if cell is None else cell
    bits = np.bitwise_count(prints).astype(np.int16)
    order = np.lexsort((bits, cell))
    tiles = -(-n // tile)
    fill = tiles * tile - n
    # rows that fill up the last tile are of no cell
    x = np.pad(prints[order], (0, fill)).reshape(tiles, tile)
    c = np.pad(cell[order], (0, fill), constant_values=-1).reshape(tiles, tile)
    p = np.pad(part[order], (0, fill)).reshape(tiles, tile)
    s = np.pad(np.broadcast_to(across, n)[order], (0, fill)).reshape(tiles, tile)
    first, last = order[np.arange(tiles) * tile], order[np.minimum(np.arange(1, tiles + 1) * tile, n) - 1]
    us, vs, left = [], [], np.arange(tiles)
    for step in range(tiles):
        left = left[left + step < tiles]
        if step:  # tiles are in order, so a tile that is too far off is followed by none that is near
            a, b = last[left], first[left + step]
            left = left[(cell[a] == cell[b]) & (bits[b] - bits[a] <= radius)]
        if not len(left):
            break
        for chunk in np.array_split(left, -(-len(left) // most)):
            a, b = chunk, chunk + step
            near = np.bitwise_count(x[a][:, :, None] ^ x[b][:, None, :]) <= radius
            near &= c[a][:, :, None] == c[b][:, None, :]
            near &= ~s[a][:, :, None] | (p[a][:, :, None] != p[b][:, None, :])
            t, i, j = np.nonzero(near)
            i, j = a[t] * tile + i, b[t] * tile + j
            real = (i < n) & (j < n) & (i != j)
            us.append(order[i[real]])
            vs.append(order[j[real]])
    return us, vs


CELL = ["block", "key"]


def _cell_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_cells(batches, CELL):
            prints, part = table["print"].to_numpy().view(np.uint64), table["part"].to_numpy()
            across = table["cell_a"].to_numpy() != table["cell_b"].to_numpy()
            cell = np.zeros(len(prints), np.int64)
            cell[cell_starts(table, [*CELL, "cell_a", "cell_b"])[1:]] = 1
            us, vs = _tile_links(prints, part, across, radius, cell=np.cumsum(cell))
            vertex, at = np.unique(prints, return_inverse=True)
            root = local_roots(len(vertex), at[np.concatenate(us)], at[np.concatenate(vs)])
            i = np.flatnonzero(root != np.arange(len(vertex)))
            yield pa.RecordBatch.from_arrays([pa.array(vertex[i].view(np.int64)), pa.array(vertex[root[i]].view(np.int64))], names=["a", "b"])

    return run


def block_masks(radius: int, spare: int = 2) -> list[int]:
    """Masks over radius + spare bit blocks, ``spare`` blocks each: any near pair agrees on one of them."""
    blocks = radius + spare
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    ones = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(m) for m in combinations(ones, spare)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(prints: DataFrame, radius: int = 3, tile: int = 2048) -> DataFrame:
    """Forest links (a, b) between distinct fingerprints at most ``radius`` bits apart. prints: distinct ``print``."""
    masks = block_masks(radius)
    keys = F.array(*(F.struct(F.lit(i).cast("int").alias("block"), F.col("print").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key")) for i, m in enumerate(masks)))
    keyed = prints.select("print", F.explode(keys).alias("k")).select("print", "k.block", "k.key")
    cells = in_tiles(keyed, CELL, "print", tile)
    return gathered(cells, CELL, partitions_for(prints.sparkSession, len(masks) * prints.count())).mapInArrow(_cell_links(radius), "a long, b long")


def _rooted(docs: DataFrame, radius: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The prints of all rows; and for each distinct print its component's root, and the smallest (doc_id, text_key) that has the print."""
    prints = materialize(fingerprints(docs, id_col, text_col), "prints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    vertices = materialize(prints.groupBy("print").agg(least.alias("least")), "vertices")
    roots = connected(near_links(vertices.select("print"), radius))
    return prints, vertices.join(roots, vertices["print"] == roots["vertex"], "left").select("print", "least", F.coalesce("root", "print").alias("root"))


def simhash_groups(docs: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id reachable, its own included)."""
    prints, placed = _rooted(docs, radius, id_col, text_col)
    smallest = placed.groupBy("root").agg(F.min("least.doc_id").alias("component_id"))
    named = placed.join(smallest, "root").select("print", "component_id")
    return prints.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def keepers(docs: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """kept_id, kept_key: one row of each component, that with the smallest id (none comes last) and, of the texts under that id, the smallest ``text_key``."""
    _, placed = _rooted(docs, radius, id_col, text_col)
    return placed.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias("kept_id"), F.col("least.text_key").alias("kept_key"))
