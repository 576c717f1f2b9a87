"""Exact substring de-duplication: later copies of passages go, the first one stays.

A byte goes if a string of ``width`` bytes that covers it also starts in a document with a smaller id.
The suffix order of the corpus is never held in one place. Every ``width``-byte window has a key,
the least hash of the short strings in it, so equal windows have equal keys; runs of windows with
one key ("pieces") are what travels, and one bucket of keys holds all copies of a window:

1. Blocks of documents send each bucket the key, a hash and the smallest id of their distinct
   pieces. A bucket answers for each: no other document has this key; an earlier document has the
   very same piece (all its windows go); or the bytes are needed.
2. Blocks send the bytes of the pieces that are needed. A bucket sorts their windows in suffix order,
   and previous and next smaller values (of document ids) give the longest-previous-factor test:
   does a match of ``width`` bytes with a smaller id exist?
3. Blocks mark the covered bytes.

A key with many different pieces in a block or bucket (text around a passage that very many documents
share) would make one bucket hot: its windows travel one by one and are dealt by their own hash.

Defined results: a null text counts as empty; texts shorter than ``width`` lose nothing; texts of any length are
read whole, each in one task; repeats inside a document stay; documents with equal ids, repeated rows for one, count
as one position in the order (copies among them stay); a null id is smaller than any other; an empty table gives an
empty one; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstrata.llm.storage import materialize, scan_blocks
from docstrata.llm.workers import make_room

GRAM = 24
U = np.uint64
_MIX = [U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)]
_STEP = U(0xD6E8FEB86659FD93)  # odd, so it has an inverse modulo 2**64
_STEP_BACK = U(pow(int(_STEP), -1, 1 << 64))
# Stands for a null id: smaller than any other but the one that marks a crowded key.
NO_ID = -(1 << 63) + 1
NONE, WHOLE, BYTES, SPREAD = 0, 1, 2, 3


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x *= _MIX[1]
    x ^= x >> U(27)
    x *= _MIX[2]
    x ^= x >> U(31)
    return x


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each ``width``-byte string of data, taken in words of eight bytes; the last word may overlap the one before."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    if width < 8:
        out = data[:n].astype(U)
        for i in range(1, width):
            out = (out << U(8)) | data[i : i + n]
        return _mixed(out)
    # the word that starts at each byte, without a copy
    words = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    out = words[:n] * _MIX[0]
    for a in [*range(8, width - 8, 8), *([width - 8] if width > 8 else [])]:
        out ^= out >> U(32)
        out += words[a : a + n]
        out *= _MIX[1]
    return _mixed(out)


def sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    power = 1
    while 2 * power <= n:
        x = np.minimum(x[: len(x) - power], x[power:])
        power *= 2
    rest = n - power
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def ordered(key: np.ndarray, *then: np.ndarray) -> np.ndarray:
    """The order by key, then the others, then the place; only what shares its key is compared further."""
    order = np.argsort(key)
    k = key[order]
    same = k[1:] == k[:-1]
    tied = np.zeros(len(k), bool)
    tied[1:] |= same
    tied[:-1] |= same
    at = np.flatnonzero(tied)
    own = order[at]
    order[at] = own[np.lexsort((own, *(t[own] for t in reversed(then)), key[own]))]
    return order


SPAN = 4096
# Windows hashed at a time: their hashes stay in a core's cache.
TILE = 1 << 15
_UP, _DOWN = (np.cumprod(np.concatenate([[U(1)], np.full(SPAN - 1, base, U)]), dtype=U) for base in (_STEP, _STEP_BACK))


def _running_total(x: np.ndarray) -> None:
    """In place: the sums of x[0..i] times powers of the step, without an array of powers."""
    far, leap, total = 1, pow(int(_STEP), SPAN, 1 << 64), U(0)
    for a in range(0, len(x), SPAN):
        part = x[a : a + SPAN]
        part *= _UP[: len(part)] * U(far)
        far = far * leap % (1 << 64)
        part[:1] += total
        np.cumsum(part, out=part)
        total = part[-1]


def _stepped_back(at: np.ndarray) -> np.ndarray:
    """The inverses of the step's powers ``at``."""
    leaps = int(at.max()) // SPAN if len(at) else 0
    far = np.cumprod(np.concatenate([[U(1)], np.full(leaps, pow(int(_STEP_BACK), SPAN, 1 << 64), U)]), dtype=U)
    return far[at // SPAN] * _DOWN[at % SPAN]


class Block:
    """The documents of a block in id order, their pieces, and the distinct pieces in a fixed order."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], width: int, hot: int) -> None:
        self.order = order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.ids, self.width = np.asarray(ids, np.int64)[order], width
        self.texts = [texts[i] for i in order]
        size = np.array([len(t) for t in self.texts], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(size)])
        self.data = np.frombuffer(bytearray(b"".join(self.texts)), np.uint8)
        n = max(0, len(self.data) - width + 1)
        self.start = self.stop = self.doc = np.zeros(0, np.int64)
        key = mark = np.zeros(0, U)
        if n:
            grams, self.start, key = self._runs(n)
            stop = np.append(self.start[1:], n)
            self.doc = np.searchsorted(self.begin, self.start, side="right") - 1
            stop = np.minimum(stop, self.begin[self.doc + 1] - width + 1)
            real = stop > self.start
            self.start, self.stop, self.doc, key = self.start[real], stop[real], self.doc[real], key[real]
            _running_total(grams)
            before = np.where(self.start > 0, grams[self.start - 1], U(0))
            mark = (grams[self.stop + width - GRAM - 1] - before) * _stepped_back(self.start)
            mark = _mixed(mark ^ (self.stop - self.start).astype(U))
            del grams
        # distinct pieces by key and hash; the first of each in id order stands for all
        by = ordered(key, mark)
        k, m = key[by], mark[by]
        new = np.ones(len(by), bool)
        new[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
        self.first = by[new]  # equal ones are in their places' order, and pieces in id order
        self.piece = np.empty(len(by), np.int64)  # piece -> distinct piece
        self.piece[by] = np.cumsum(new) - 1
        self.key, self.mark = k[new], m[new]
        fresh = np.ones(len(self.key), bool)
        fresh[1:] = self.key[1:] != self.key[:-1]
        group = np.cumsum(fresh) - 1
        self.crowded = np.bincount(group, minlength=1)[group] > hot if len(group) else np.zeros(0, bool)
        # a crowded key is told once, without its pieces
        self.told = np.flatnonzero(~self.crowded | fresh)

    def _runs(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all short strings, and where runs of windows with one key begin, with their keys."""
        grams, starts, keys, last = np.empty(len(self.data) - GRAM + 1, U), [], [], None
        for a in range(0, n, TILE):
            b = min(a + TILE, n)
            own = rolling(self.data[a : b + self.width - 1], GRAM)
            grams[a : a + len(own)] = own
            least = sliding_least(own, self.width - GRAM + 1)[: b - a]
            first = np.ones(b - a, bool)
            np.not_equal(least[1:], least[:-1], out=first[1:])
            first[0] = least[0] != last if last is not None else True
            # runs also break at documents, and the windows that cross an end belong to none
            inner = self.begin[1:-1]
            first[inner[np.searchsorted(inner, a) : np.searchsorted(inner, b)] - a] = True
            at = np.flatnonzero(first)
            starts.append(at + a)
            keys.append(least[at])
            last = least[-1]
        return grams, np.concatenate(starts), np.concatenate(keys)

    def owner(self, distinct: np.ndarray) -> np.ndarray:
        return self.ids[self.doc[self.first[distinct]]]

    def by_bucket(self, buckets: int):
        """(bucket, indexes of told entries) in bucket order; the same whenever the block is made."""
        b = (self.key[self.told] % U(buckets)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        cut = np.flatnonzero(np.diff(b[order])) + 1
        return [(int(b[i[0]]), self.told[i]) for i in np.split(order, cut) if len(i)]


def _block(group: pa.Table, width: int, hot: int) -> Block:
    make_room("suffixes")
    return Block(group["doc_id"].to_numpy(), [t.as_py() for t in group["bytes"]], width, hot)


KEYS = "bucket long, block long, keys binary, marks binary, docs binary"
ANSWERS = "block long, stage int, bucket long, answers binary"
PIECES = "bucket long, block long, bytes binary, sizes binary, docs binary"


def _send_keys(width: int, hot: int, buckets: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        block, rows = _block(group, width, hot), []
        for b, i in block.by_bucket(buckets):
            docs = np.where(block.crowded[i], -1, block.owner(i))
            rows.append((b, key[0].as_py(), block.key[i].tobytes(), np.where(block.crowded[i], U(0), block.mark[i]).tobytes(), np.where(block.crowded[i], np.iinfo(np.int64).min, docs).astype(np.int64).tobytes()))
        return _table(rows, KEYS)

    return run


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows)) or [[]] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields)], names=[n for n, _ in fields])


def _joined(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    parts = [v.as_py() for v in column]
    return np.frombuffer(b"".join(parts), kind), np.array([len(p) for p in parts]) // np.dtype(kind).itemsize


def answer_keys(key: np.ndarray, mark: np.ndarray, doc: np.ndarray, hot: int) -> np.ndarray:
    """For each entry: is its piece new, wholly seen earlier, or are the bytes needed? Least doc: a crowded key."""
    order = ordered(key, mark, doc)
    k, m, d = key[order], mark[order], doc[order]
    new_key = np.ones(len(k), bool)
    new_key[1:] = k[1:] != k[:-1]
    new = new_key.copy()
    new[1:] |= m[1:] != m[:-1]
    group, piece = np.cumsum(new_key) - 1, np.cumsum(new) - 1
    begin = np.flatnonzero(new_key)
    most, least = np.maximum.reduceat(d, begin), np.minimum.reduceat(d, begin)
    pieces = np.add.reduceat(new.astype(np.int64), begin)
    out = np.full(len(k), NONE, np.uint8)
    out[((pieces > 1) & (most != least))[group]] = BYTES
    out[d[np.flatnonzero(new)][piece] < d] = WHOLE
    out[((pieces > hot) & (most != least) | (least == np.iinfo(np.int64).min))[group]] = SPREAD
    answers = np.empty(len(k), np.uint8)
    answers[order] = out
    return answers


def _answer_keys(hot: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        keys, sizes = _joined(group["keys"], U)
        answers = answer_keys(keys, _joined(group["marks"], U)[0], _joined(group["docs"], np.int64)[0], hot)
        parts = np.split(answers, np.cumsum(sizes)[:-1])
        return _table([(b, 1, key[0].as_py(), p.tobytes()) for b, p in zip(group["block"].to_pylist(), parts)], ANSWERS)

    return run


def _states(block: Block, answers: pa.Table, buckets: int) -> np.ndarray:
    """What is known of each distinct piece after the first answers."""
    told = {b: a for s, b, a in zip(answers["stage"].to_pylist(), answers["bucket"].to_pylist(), answers["answers"].to_pylist()) if s == 1}
    state = np.zeros(len(block.key), np.uint8)
    for b, i in block.by_bucket(buckets):
        state[i] = np.frombuffer(told[b], np.uint8)
    state[block.crowded] = SPREAD
    return state


def _needed(block: Block, state: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, starts, numbers of windows, owners) of the strings to send, in a fixed order."""
    whole = np.flatnonzero(state == BYTES)
    p = block.first[whole]
    start, count, doc, bucket = block.start[p], (block.stop - block.start)[p], block.owner(whole), (block.key[whole] % U(buckets)).astype(np.int64)
    spread = np.flatnonzero(state == SPREAD)
    if len(spread):
        p = block.first[spread]
        n = (block.stop - block.start)[p]
        at = np.repeat(block.start[p] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        owner = np.repeat(block.owner(spread), n)
        h = _hash_at(block.data, at, block.width)
        order = np.lexsort((at, owner, h))
        keep = order[np.concatenate([[True], h[order][1:] != h[order][:-1]])]  # the first of equal windows
        start, count, doc = np.concatenate([start, at[keep]]), np.concatenate([count, np.ones(len(keep), np.int64)]), np.concatenate([doc, owner[keep]])
        bucket = np.concatenate([bucket, (h[keep] % U(buckets)).astype(np.int64)])
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    return [(int(bucket[i[0]]), start[i], count[i], doc[i]) for i in np.split(order, cut) if len(i)]


def _hash_at(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A hash of the strings that start at ``at``, word by word."""
    out, windows = np.empty(len(at), U), np.lib.stride_tricks.sliding_window_view(data, width)
    for a in range(0, len(at), 200_000):
        x = np.zeros((len(at[a : a + 200_000]), -(-width // 8) * 8), np.uint8)
        x[:, :width] = windows[at[a : a + 200_000]]
        h = np.zeros(len(x), U)
        for word in x.view("<u8").T:
            h = _mixed((h ^ word) * _MIX[0] + _MIX[2])
        out[a : a + 200_000] = h
    return out


def _send_pieces(width: int, hot: int, buckets: int):
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table([], PIECES)
        block = _block(docs, width, hot)
        data, rows = block.data.tobytes(), []
        for b, start, count, owner in _needed(block, _states(block, answers, buckets), buckets):
            strings = b"".join([data[s : s + n + width - 1] for s, n in zip(start.tolist(), count.tolist())])
            rows.append((b, key[0].as_py(), strings, count.astype(np.int32).tobytes(), owner.tobytes()))
        return _table(rows, PIECES)

    return run


def earlier_match(rank: np.ndarray, order: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Longest-previous-factor test in suffix order: has a position of the same rank a smaller doc?

    In suffix order, positions whose common prefix is long enough are neighbours. A previous or next
    smaller value exists in such a run if its running minimum from either end is smaller.
    """
    r, d = rank[order], np.unique(doc, return_inverse=True)[1][order]
    new = np.ones(len(r), bool)
    new[1:] = r[1:] != r[:-1]
    run, most = np.cumsum(new) - 1, (int(d.max()) + 1 if len(d) else 1)
    previous = run * most + (most - 1) - np.maximum.accumulate(run * most + (most - 1 - d))  # smallest so far
    back = run[::-1][:1] - run[::-1] if len(run) else run
    after = (back * most + (most - 1) - np.maximum.accumulate(back * most + (most - 1 - d[::-1])))[::-1]
    out = np.empty(len(r), bool)
    # within a run, base + (most - 1) - maximum is the least doc from that end; runs never mix
    out[order] = (previous < d) | (after < d)
    return out


def _window_starts(count: np.ndarray, width: int) -> np.ndarray:
    """Where the windows of concatenated pieces start."""
    begin = np.concatenate([[0], np.cumsum(count + width - 1)[:-1]])
    return np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())


def may_repeat(h: np.ndarray) -> np.ndarray:
    """False only for values that occur once: two tables of counts by different bits."""
    bits = U(max(8, int(len(h)).bit_length() + 3))
    mask = (U(1) << bits) - U(1)
    low, high = (h & mask).astype(np.int64), (h >> (U(64) - bits)).astype(np.int64)
    return (np.bincount(low)[low] > 1) & (np.bincount(high)[high] > 1)


def window_hashes(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows that start at ``at``, which ascend."""
    out = np.empty(len(at), U)
    for a in range(0, len(at), TILE):
        own = at[a : a + TILE]
        out[a : a + TILE] = rolling(data[own[0] : own[-1] + width], width)[own - own[0]]
    return out


def window_ranks(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each suffix that starts at ``at`` among all of them, by its first ``width`` bytes, and their numbers in that order."""
    words = np.zeros((len(at), -(-width // 8) * 8), np.uint8)
    words[:, :width] = np.lib.stride_tricks.sliding_window_view(data, width)[at]
    words = words.view(">u8").astype(U)
    order = ordered(*words.T)
    words = words[order]
    new = np.ones(len(at), bool)
    np.any(words[1:] != words[:-1], axis=1, out=new[1:])
    rank = np.empty(len(at), np.int64)
    rank[order] = np.cumsum(new)
    return rank, order


def answer_pieces(data: np.ndarray, count: np.ndarray, doc: np.ndarray, width: int, most: int = 500_000) -> np.ndarray:
    """For each window of the concatenated pieces: does an earlier document hold it?

    Windows whose hash does not occur again cannot match and are left out of the suffix order. The others are put in order by their bytes, a range of
    hashes at a time, since windows of different hashes never match.
    """
    count = count.astype(np.int64)
    out = np.zeros(int(count.sum()), bool)
    at, doc = _window_starts(count, width), np.repeat(doc, count)
    h = window_hashes(data, at, width)
    again = np.flatnonzero(may_repeat(h))
    ranges = 1 + len(again) // most
    own = ((h[again] >> U(32)) * U(ranges)) >> U(32)
    for r in range(ranges):
        some = again[own == U(r)] if ranges > 1 else again
        if len(some):
            out[some] = earlier_match(*window_ranks(data, at[some], width), doc[some])
    return out


def _answer_pieces(width: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        make_room("suffixes")
        group = group.sort_by("block")
        data, _ = _joined(group["bytes"], np.uint8)
        count, per = _joined(group["sizes"], np.int32)
        out = answer_pieces(data, count, _joined(group["docs"], np.int64)[0], width)
        windows = np.add.reduceat(count.astype(np.int64), np.concatenate([[0], np.cumsum(per)[:-1]]))
        parts = np.split(out, np.cumsum(windows)[:-1])
        return _table([(b, 2, key[0].as_py(), np.packbits(p).tobytes()) for b, p in zip(group["block"].to_pylist(), parts)], ANSWERS)

    return run


def _covered(block: Block, answers: pa.Table, buckets: int) -> np.ndarray:
    """Which bytes of the block go."""
    state = _states(block, answers, buckets)
    told = {b: a for s, b, a in zip(answers["stage"].to_pylist(), answers["bucket"].to_pylist(), answers["answers"].to_pylist()) if s == 2}
    n, width = len(block.data), block.width
    gone = np.zeros(n, bool)  # windows, by start
    for b, start, count, owner in _needed(block, state, buckets):
        bits = np.unpackbits(np.frombuffer(told[b], np.uint8), count=int(count.sum())).astype(bool)
        at = np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        gone[at] = bits
    # later copies of a distinct piece inside the block, and pieces wholly seen in another one
    first_doc = block.ids[block.doc[block.first]][block.piece]
    own_doc = block.ids[block.doc]
    whole = (first_doc < own_doc) | (state[block.piece] == WHOLE)
    same = (first_doc == own_doc) & (state[block.piece] == BYTES) & (block.first[block.piece] != np.arange(len(block.piece)))
    for i in np.flatnonzero(same):  # a repeat inside one document: as its first copy
        j = block.first[block.piece[i]]
        gone[block.start[i] : block.stop[i]] = gone[block.start[j] : block.stop[j]]
    crowded = np.flatnonzero(state[block.piece] == SPREAD)
    if len(crowded):
        length = (block.stop - block.start)[crowded]
        at = np.repeat(block.start[crowded] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        doc = np.repeat(own_doc[crowded], length)
        h = _hash_at(block.data, at, width)
        order = np.lexsort((at, doc, h))
        new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
        head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]  # the window that was sent for each
        gone[at[order]] = gone[at[head]] | (doc[head] < doc[order])
    edge = np.zeros(n + 1, np.int64)
    runs = np.flatnonzero(whole)
    np.add.at(edge, block.start[runs], 1)
    np.add.at(edge, block.stop[runs] + width - 1, -1)
    at = np.flatnonzero(gone)
    edge[at] += 1
    if len(at):
        np.add.at(edge, at + width, -1)
    return np.cumsum(edge)[:n] > 0


def _finish(width: int, hot: int, buckets: int, keep_text: bool, carry: list[str]):
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        schema = RESULT + (", text string" if keep_text else "")
        if not docs.num_rows:
            return _carried(_table([], schema), docs, carry, [])
        block = _block(docs, width, hot)
        gone, rows = _covered(block, answers, buckets), []
        for i, doc in enumerate(block.ids.tolist()):
            own = gone[block.begin[i] : block.begin[i + 1]]
            removed = int(own.sum())
            spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if removed else 0
            kept = block.data[block.begin[i] : block.begin[i + 1]][~own].tobytes() if removed else block.texts[i]
            rows.append((doc, len(own), removed, spans, hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "ignore")] if keep_text else [])))
        return _carried(_table(rows, schema), docs, carry, block.order)

    return run


def _carried(out: pa.Table, docs: pa.Table, carry: list[str], order: list[int]) -> pa.Table:
    for i, name in enumerate(carry):
        out = out.append_column(name, docs[f"carry_{i}"].take(pa.array(order, pa.int64())))
    return out


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, width: int = 50, hot: int = 64, block_bytes: int = 5_000_000, keep_text: bool = False, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each document; with keep_text, the text that is left.

    A character of which only some bytes go is left out of that text whole. ``carry``: columns to add.

    ``block_bytes``: stored bytes of documents in a block, from which the numbers of blocks and buckets
    follow. ``hot``: how many different pieces of a key a block or a bucket takes before the key's
    windows are spread by their own hash; results do not depend on either.
    """
    blocks = scan_blocks(docs, block_bytes)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), text.alias("bytes"), *(F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry))).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    by_block: Callable = lambda df: df.groupBy("block")
    lean = rows.select("doc_id", "bytes", "block")
    keys = by_block(lean).applyInArrow(_send_keys(width, hot, blocks), KEYS)
    first = materialize(keys.groupBy("bucket").applyInArrow(_answer_keys(hot), ANSWERS), "suffix-keys")
    pieces = by_block(lean).cogroup(by_block(first)).applyInArrow(_send_pieces(width, hot, blocks), PIECES)
    second = materialize(pieces.groupBy("bucket").applyInArrow(_answer_pieces(width), ANSWERS), "suffix-pieces")
    schema = T._parse_datatype_string(RESULT + (", text string" if keep_text else ""))
    schema = T.StructType([*schema, *(T.StructField(c, docs.schema[c].dataType) for c in carry)])
    done = by_block(rows).cogroup(by_block(first.unionByName(second))).applyInArrow(_finish(width, hot, blocks, keep_text, list(carry)), schema)
    return done.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
