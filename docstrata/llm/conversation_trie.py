"""A prefix trie over conversations that are rebuilt from families, merged family first.

The family of conversation c is c - c%5, its base. Conversations are cogrouped with their base, rebuilt, and each family's small
trie is built in its task; what is shuffled over all families is a row for each family node, with counts that are summed before
the shuffle. Rows carry digests and lengths, never texts.

A node is known by its depth and by two 64-bit sums over the turns before it of a hash of (place, role, text), so that a path can
be summed up in parts: a conversation of more than ``long_turns`` turns is never gathered in one task, but numbered and summed by
ranges of its turns. (The sums tell sequences apart as 128 random bits do; they are not meant for texts made to collide.)

What a subtree sums of its distinct nodes is summed by paths: a node belongs to its smallest member, and a conversation
adds the nodes that belong to it to each node on its path, so that a second sum by node needs no walk over the trie.

Defined results: rows are ordered by turn, null first, then by role, by the first 16 and 64 characters of role and text, and by a
digest; repeated rows are turns each; null role or text is empty; rows without conversation id belong to no conversation; an
empty table gives no node; texts and conversations may be of any length; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstrata.llm.storage import materialize

FAMILY, HEADS = 5, 9
KEY = ["depth", "k1", "k2"]
NODE = "family long, depth long, k1 long, k2 long, p1 long, p2 long, n long, conv long, n_bytes long, below long, inner boolean, ends array<long>"
SUMS = "depth long, k1 long, k2 long, p1 long, p2 long, n long, conv long, n_bytes long, below long, own_bytes long, own_leaves long, own_children long"
ORDER = ["turn", "role", "head", "digest"]
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def head_turns(conv: int) -> int:
    """How many turns a conversation takes from its base."""
    return zlib.crc32(str(conv).encode()) % HEADS


def mixed(digests: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes for each turn (n x 2 digests) at its place."""
    x = digests + (place.astype(np.uint64) * _STEP)[:, None]
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _family(conv: Column) -> Column:
    return conv - conv % FAMILY


def _apart(df: DataFrame) -> DataFrame:
    """Columns of their own for the second side of a cogroup, when both sides come from one table."""
    return df.select(*(F.col(c).alias(f"o_{c}") for c in df.columns))


def slim_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role and head (what ties are told apart by), digest of role and text, bytes of the text."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    both = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    digest = F.unhex(F.substring(F.sha2(both.cast("binary"), 256), 1, 32))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.substring(role, 1, 16).alias("role"), F.substring(text, 1, 64).alias("head"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.where("conv IS NOT NULL")


def _digests(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, 2)


def _own_turns(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By conversation: digests and bytes of its turns in order. The empty side of a cogroup has no columns."""
    if not table.num_rows:
        return {}
    rows = sorted(zip(*(table[c].to_pylist() for c in ("conv", "turn", "role", "head", "digest", "n_bytes"))), key=lambda r: (r[0], r[1] is not None, r[1] or 0, *r[2:]))
    found: dict[int, list] = {}
    for r in rows:
        found.setdefault(r[0], []).append(r)
    return {c: (np.frombuffer(b"".join(r[4] for r in own), "<u8").reshape(-1, 2), np.array([r[5] for r in own], np.int64)) for c, own in found.items()}


def _family_trie(key: tuple, members: pa.Table, base: pa.Table) -> pa.Table:
    """The trie of one family. Rows of ``base`` that are not ``whole`` are the head of a long conversation, which is no member here."""
    family = key[0].as_py()
    own = _own_turns(members)
    first = _own_turns(base.rename_columns([c.removeprefix("o_") for c in base.column_names])).get(family)
    if first is not None and base["o_whole"][0].as_py():
        own[family] = first
    nodes: dict[tuple, list] = {}
    for conv in sorted(own):
        h, (digests, sizes) = head_turns(conv), own[conv]
        if conv != family:
            digests, sizes = digests[h:], sizes[h:]
            if first is not None:
                digests, sizes = np.concatenate([first[0][:h], digests]), np.concatenate([first[1][:h], sizes])
        path = np.cumsum(mixed(digests, np.arange(1, len(sizes) + 1)), axis=0, dtype=np.uint64).view(np.int64).tolist()
        below = (int(sizes.sum()) - np.concatenate([[0], np.cumsum(sizes)])).tolist()  # what stands after each depth
        before = (0, 0)
        for d in range(len(path) + 1):
            here = tuple(path[d - 1]) if d else (0, 0)
            size = int(sizes[d - 1]) if d else 0
            node = nodes.get((d, *here))
            if node is None:
                node = nodes[d, *here] = [before, 0, conv, size, 0, False, []]
            node[1] += 1
            node[4] += below[d] + size
            if d < len(path):
                node[5] = True
            else:
                node[6].append(conv)
            before = here
    rows = [(family, *k, *before, *rest) for k, (before, *rest) in nodes.items()]
    return _table(rows, NODE)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*(f.split() for f in schema.split(", ")))
    columns = list(zip(*rows)) or [[]] * len(names)
    return pa.table([pa.array(c, kinds[t]) for c, t in zip(columns, types)], names=list(names))


def _owned_sums(key: tuple, nodes: pa.Table, owned: pa.Table) -> pa.Table:
    """For each node of a family: what the nodes that belong to this family's conversations add to it."""
    mine = {(d, a, b): leaf for d, a, b, leaf in zip(*(owned[c].to_pylist() for c in ("o_depth", "o_k1", "o_k2", "o_leaf")))} if owned.num_rows else {}
    sums = {}
    rows = sorted(zip(*(nodes[c].to_pylist() for c in (*KEY, "p1", "p2", "n", "conv", "n_bytes", "below"))), reverse=True)  # the deepest first
    for d, a, b, p1, p2, *_, size, _below in rows:
        node = sums.setdefault((d, a, b), [0, 0, 0])
        leaf = mine.get((d, a, b))
        if leaf is not None:
            node[0] += size
            node[1] += leaf
        if d:
            above = sums.setdefault((d - 1, p1, p2), [0, 0, 0])
            above[0] += node[0]
            above[1] += node[1]
            above[2] += leaf is not None
    return _table([(*r, *sums[r[:3]]) for r in rows], SUMS)


def _placed(rows: DataFrame, name: str, sums: tuple[str, ...] = ()) -> DataFrame:
    """place (from 1) and running sums of columns in each conversation, in ORDER, dealt by ranges of turns so that a long conversation is spread."""
    ranks = [F.col(c).asc_nulls_first() for c in ("conv", *ORDER)]
    # the place in the input spreads rows that are alike
    ranged = rows.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(*ranks, "at").drop("at")
    dealt = materialize(ranged.withColumn("part", F.spark_partition_id()), name)
    here = Window.partitionBy("part", "conv").orderBy(*ranks[1:])
    inside = dealt.withColumn("place", F.row_number().over(here).cast("long")).withColumns({c: F.sum(c).over(here.rowsBetween(Window.unboundedPreceding, 0)) for c in sums})
    totals = dealt.groupBy("conv", "part").agg(F.count("*").alias("place"), *(F.sum(c).alias(c) for c in sums))
    # a row for each conversation and part of it
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("conv", "part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"before_{c}") for c in ("place", *sums)))
    return inside.join(carried, ["conv", "part"]).withColumns({c: F.col(c) + F.col(f"before_{c}") for c in ("place", *sums)}).drop("part", *(f"before_{c}" for c in ("place", *sums)))


def _lanes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of turns at their places, as 32-bit halves, whose sums do not overflow."""
    for batch in batches:
        halves = mixed(_digests(batch.column("digest")), batch.column("place").to_numpy()) if batch.num_rows else np.zeros((0, 2), np.uint64)
        low, high = (halves & np.uint64(0xFFFFFFFF)).astype(np.int64), (halves >> np.uint64(32)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x) for x in (low[:, 0], high[:, 0], low[:, 1], high[:, 1]))], names=[*batch.schema.names, "l1", "h1", "l2", "h2"])


def _joined_lanes(low: Column, high: Column) -> Column:
    """The sum modulo 2^64 as a signed number, of the sums of its halves."""
    top = (high + F.shiftright(low, 32)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(top, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))


def _long_paths(long_rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Nodes of conversations that are too long for one task: conv, depth, keys, bytes, after (bytes of the turns after it), length."""
    own = _placed(long_rows, "long-turns").withColumn("h", F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(HEADS))).withColumn("family", _family(F.col("conv")))
    is_base = F.col("conv") == F.col("family")
    taken = heads.groupBy("family").agg(F.count("*").alias("n_heads"))
    shifted = own.join(taken, "family", "left").where(is_base | (F.col("place") > F.col("h")))
    kept = shifted.withColumn("place", F.when(is_base, F.col("place")).otherwise(F.col("place") - F.col("h") + F.least("h", F.coalesce("n_heads", F.lit(0)))))
    borrowers = own.where("place = 1").where(~is_base).select("conv", "family", "h")
    lent = heads.withColumnRenamed("place", "at").join(borrowers, "family").where("at <= h").select("conv", "digest", "n_bytes", F.col("at").alias("place"))
    rows = kept.select("conv", "digest", "n_bytes", "place").unionByName(lent)
    # the place is the order now
    placed = rows.withColumns({"turn": F.col("place"), "role": F.lit(""), "head": F.lit("")}).select("conv", *ORDER, "n_bytes", "place")
    schema = "conv long, turn long, role string, head string, digest binary, n_bytes long, place long, l1 long, h1 long, l2 long, h2 long"
    lanes = placed.mapInArrow(_lanes, schema).drop("place").withColumn("size", F.col("n_bytes"))
    summed = _placed(lanes, "long-paths", ("n_bytes", "l1", "h1", "l2", "h2"))
    total = lanes.groupBy("conv").agg(F.sum("size").alias("total"), F.count("*").alias("length"))
    keyed = summed.join(total, "conv").select("conv", F.col("place").alias("depth"), _joined_lanes(F.col("l1"), F.col("h1")).alias("k1"), _joined_lanes(F.col("l2"), F.col("h2")).alias("k2"), F.col("size").alias("n_bytes"), (F.col("total") - F.col("n_bytes")).alias("after"), "length", "digest")
    # the key of the node above is this one's less its own turn
    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([batch.column("k1").to_numpy(), batch.column("k2").to_numpy()], axis=1).view(np.uint64)
            p = (keys - mixed(_digests(batch.column("digest")), batch.column("depth").to_numpy())).view(np.int64) if batch.num_rows else np.zeros((0, 2), np.int64)
            names = ["conv", "depth", "k1", "k2", "n_bytes", "after", "length"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(p[:, 0]), pa.array(p[:, 1])], names=[*names, "p1", "p2"])

    paths = keyed.mapInArrow(above, "conv long, depth long, k1 long, k2 long, n_bytes long, after long, length long, p1 long, p2 long")
    zero = F.lit(0).cast("long")
    roots = long_rows.select("conv").distinct().join(total, "conv", "left")
    roots = roots.select("conv", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("n_bytes"), F.coalesce("total", zero).alias("after"), F.coalesce("length", zero).alias("length"), zero.alias("p1"), zero.alias("p2"))
    return materialize(paths.unionByName(roots), "long-nodes")


def _chunks(most: int):
    """Sorted (node, conversation) rows to rows of joined numbers of bounded size, in the same order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        node, first, ids = None, 0, []
        for batch in batches:
            for *key, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if key != node or len(ids) >= most:
                    if ids:
                        held.append((*node, first, ",".join(map(str, ids))))
                    node, first, ids = key, conv, []
                ids.append(conv)
            yield _batch_of(held)
            held = []
        if ids:
            held.append((*node, first, ",".join(map(str, ids))))
        yield _batch_of(held)

    return run


def _batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 5
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string())], names=[*KEY, "first", "ids"])


def _sha_of_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by node and first number to a digest for each node; what is held is the state of one hash."""
    node, state = None, None
    for batch in batches:
        done = []
        for d, a, b, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
            if (d, a, b) != node:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = (d, a, b), hashlib.sha256(ids.encode())
            else:
                state.update(f",{ids}".encode())
        yield _hash_batch(done)
    yield _hash_batch([] if node is None else [(*node, state.hexdigest())])


def _hash_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=[*KEY, "ends_sha256"])


def ends_digests(ends: DataFrame, most: int = 10_000) -> DataFrame:
    """ends: depth, k1, k2, conv. The digest of each node's numbers; a node that very many share is joined up in ranges of its numbers first."""
    dealt = ends.repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv")
    chunks = dealt.mapInArrow(_chunks(most), "depth long, k1 long, k2 long, first long, ids string")
    return chunks.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_sha_of_chunks, "depth long, k1 long, k2 long, ends_sha256 string")


def conversation_trie(turns: DataFrame, long_turns: int = 1024, **columns) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    slim = materialize(slim_turns(turns, **columns).withColumn("family", _family(F.col("conv"))), "turns")
    long_ids = materialize(slim.groupBy("conv").count().where(F.col("count") > long_turns).select("conv"), "long-ids")
    some_long = not long_ids.isEmpty()
    usual = slim.join(long_ids, "conv", "left_anti") if some_long else slim
    base = usual.where("conv = family").withColumn("whole", F.lit(True))
    if some_long:
        long_rows = slim.join(long_ids, "conv", "left_semi").drop("family")
        long_heads = _placed(long_rows.where(F.col("conv") == _family(F.col("conv"))), "long-heads").where(F.col("place") < HEADS)
        lent = Window.partitionBy("conv").orderBy(*(F.col(c).asc_nulls_first() for c in ORDER))
        wanted = long_ids.select(_family(F.col("conv")).alias("family")).distinct()
        usual_heads = base.join(wanted, "family", "left_semi").withColumn("place", F.row_number().over(lent)).where(F.col("place") < HEADS)
        heads = long_heads.select(F.col("conv").alias("family"), "digest", "n_bytes", "place").unionByName(usual_heads.select("family", "digest", "n_bytes", "place"))
        paths = _long_paths(long_rows, materialize(heads, "heads"))
        base = base.unionByName(long_heads.drop("place").withColumn("family", F.col("conv")).withColumn("whole", F.lit(False)).select(*base.columns))
    members = usual.where("conv <> family")
    nodes = materialize(members.groupBy("family").cogroup(_apart(base).groupBy("o_family")).applyInArrow(_family_trie, NODE), "family-nodes")
    every = nodes
    if some_long:
        end = F.when(F.col("depth") == F.col("length"), F.array("conv")).otherwise(F.array().cast("array<long>"))
        every = nodes.unionByName(paths.select(_family(F.col("conv")).alias("family"), *KEY, "p1", "p2", F.lit(1).cast("long").alias("n"), "conv", "n_bytes", (F.col("after") + F.col("n_bytes")).alias("below"), (F.col("depth") < F.col("length")).alias("inner"), end.alias("ends")))
    # each distinct node goes to the family of its smallest member
    owned = every.groupBy(*KEY).agg(F.min("conv").alias("owner"), (~F.max("inner")).cast("long").alias("leaf")).withColumn("family", _family(F.col("owner")))
    if some_long:
        owned = materialize(owned, "owned")
        mine = owned.join(long_ids.withColumnRenamed("conv", "owner"), "owner", "left_semi").groupBy("owner").agg(F.min("depth").alias("since"), F.max("leaf").alias("leaf"))
        owned = owned.join(long_ids.withColumnRenamed("conv", "owner"), "owner", "left_anti")
    sums = nodes.drop("inner", "ends").groupBy("family").cogroup(_apart(owned).groupBy("o_family")).applyInArrow(_owned_sums, SUMS)
    if some_long:
        sums = sums.unionByName(_long_shares(paths, mine))
    merged = sums.groupBy(*KEY).agg(F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.sum("n").alias("n_convs"), F.min("conv").alias("conv_id"), F.sum("own_children").alias("n_children"), F.sum("own_leaves").alias("n_leaves"), (F.sum("below") - F.sum("own_bytes")).alias("saved_tokens"))
    merged = materialize(merged, "nodes")
    ends = ends_digests(every.select(*KEY, F.explode("ends").alias("conv")))
    parent = merged.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    whole = merged.join(ends, KEY, "left").join(parent, ["depth", "p1", "p2"], "left")
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def _long_shares(paths: DataFrame, mine: DataFrame) -> DataFrame:
    """What long conversations add to the nodes on their paths, as _owned_sums has it: a conversation owns its path from some depth on."""
    owner = mine.withColumnRenamed("owner", "conv")
    since = F.col("since")
    rows = paths.join(owner, "conv", "left")
    # nodes before the first owned one add all that is owned; from there on, what stands at and below them
    first = paths.join(owner, "conv").where(F.col("depth") == since).select("conv", (F.col("after") + F.col("n_bytes")).alias("all_owned"))
    rows = rows.join(first, "conv", "left")
    zero = F.lit(0).cast("long")
    share = F.when(since.isNull(), zero).when(F.col("depth") < since, F.col("all_owned")).otherwise(F.col("after") + F.col("n_bytes"))
    child = F.when((F.col("depth") + 1 >= since) & (F.col("depth") < F.col("length")), 1).otherwise(0).cast("long")
    return rows.select(*KEY, "p1", "p2", F.lit(1).cast("long").alias("n"), "conv", "n_bytes", (F.col("after") + F.col("n_bytes")).alias("below"), share.alias("own_bytes"), F.coalesce("leaf", zero).alias("own_leaves"), child.alias("own_children"))


def oracle() -> str:
    step = "list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, i: xor(a >> 1, (a & 1) * 3988292384))"
    # a byte is taken into the check sum in eight shifts
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)), lambda c, b: {step.replace('[x,', '[xor(c, b),')}), 4294967295)"
    return f"""WITH t AS (SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m, strlen(coalesce(text, '')) AS bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS j FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {crc} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
l AS (SELECT conv_id AS base, count(*) AS n FROM t GROUP BY 1),
r AS (SELECT c.conv_id, b.j AS pos, b.m, b.bytes FROM c JOIN t b ON b.conv_id = c.base AND b.j <= c.h UNION ALL SELECT c.conv_id, o.j - c.h + least(c.h, coalesce(l.n, 0)), o.m, o.bytes FROM c JOIN t o ON o.conv_id = c.conv_id AND o.j > c.h LEFT JOIN l ON l.base = c.base),
w AS (SELECT conv_id, list(m ORDER BY pos) AS ms, list(bytes ORDER BY pos) AS bs FROM r GROUP BY 1),
v AS (SELECT c.conv_id, coalesce(w.ms, []) AS ms, coalesce(w.bs, []) AS bs FROM c LEFT JOIN w USING (conv_id)),
p AS (SELECT conv_id, d, ms[1:d] AS k, d = len(ms) AS ends, CASE WHEN d > 0 THEN bs[d] ELSE 0 END AS bytes FROM (SELECT conv_id, ms, bs, unnest(range(0, len(ms) + 1)) AS d FROM v)),
n AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY d, k),
ch AS (SELECT k[1:d - 1] AS k, count(*) AS n FROM n WHERE d > 0 GROUP BY 1),
x AS (SELECT n.*, coalesce(ch.n, 0) AS n_children FROM n LEFT JOIN ch USING (k)),
s AS (SELECT k[1:a] AS k, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum((n_convs - 1) * bytes)::BIGINT AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM x) GROUP BY 1)
SELECT x.conv_id, x.d AS depth, u.conv_id AS parent_conv_id, x.n_convs, x.n_children, s.n_leaves, s.saved AS saved_tokens, x.ends_sha256 FROM x JOIN s USING (k) LEFT JOIN x u ON x.d > 0 AND u.d = x.d - 1 AND u.k = x.k[1:x.d - 1]"""
