"""Packing of documents into fixed-length token sequences (bounded-space online best fit).

Each partition keeps a fixed number of open windows. A document's full windows are closed at once;
its rest goes to the open window with the least space that holds it. When none holds it, a new
window is opened while fewer than the fixed number are open; otherwise the fullest one is topped up
with the head of the piece (documents may be cut freely) and emitted. What is left open at the end
of the partitions is merged, without cutting, in groups of bounded size.

With ``by``, a sequence holds documents of one value of that column only. A partition then keeps that many open windows
for each value, and no more than ``most_values`` values open: those of the value that was used least recently are left to the merge.

Defined results: a null text counts as empty and gives the single end token; texts of any length are packed
whole; every row is packed, so repeated rows (and repeated ids) give pieces each; of equally good
windows the one opened first is taken; a null of ``by`` is a value of its own; an empty table gives no piece; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.storage import materialize
from docstrata.llm.workers import hold, make_room

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_LOCAL_BITS = 33
_MERGED = 1 << 62
_BLANK_PAIR = re.compile(r" \s")
# A single line break between other characters, and a comma or full stop between a Latin letter or digit and a blank: boundaries of the pre-tokenizer.
_LINE = re.compile(r"\n(?<=\S\n)(?=\S)")
_STOP = re.compile("([.,])(?<=[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f][.,])(?= |\\Z)")
_MARKS = ("\n", "\t")
# Words of a block that are handed to the tokenizer as one text.
_FRESH = 1000


class Encoder:
    """Ids of whole texts by the tokenizer file, as little-endian unsigned 32-bit bytes.

    In the byte-level pre-tokenizer a boundary always stands before a single blank that a non-blank
    follows, and between a letter and a full stop or comma, so a text without blank pairs is encoded
    word by word with a memo of bounded size (two generations; words in use move to the young
    one); any other text goes to the tokenizer whole, and so does a text that holds an added token of
    the file, such as the end of a text, which the tokenizer reads as that token.
    """

    def __init__(self, path: str, memo: int = 700_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        blank = self.tokenizer.encode(" x", add_special_tokens=False).tokens[0][0]
        line = self.tokenizer.encode("\nx", add_special_tokens=False).tokens[0][0]
        self.begins = {lead: np.zeros(self.tokenizer.get_vocab_size(), bool) for lead in " \n"}
        for lead, mark in ((" ", blank), ("\n", line)):
            self.begins[lead][[i for t, i in self.tokenizer.get_vocab().items() if t.startswith(mark)]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.memo = memo
        self.ends = {c: self.whole(c) for c in ".,"}

    def whole(self, text: str) -> bytes:
        return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if _BLANK_PAIR.search(text) or any(t in text for t in self.added):
            return self.whole(text)
        words = text.split(" ")
        found = list(map(self.young.get, words))
        found[0] = self.whole(words[0]) if words[0] else b""  # the first word has no blank before it
        at, missing = -1, []
        try:
            while True:
                at = found.index(None, at + 1)
                missing.append(at)
        except ValueError:
            pass
        if missing:
            new = self._words({words[i] for i in missing})
            for i in missing:
                found[i] = new[words[i]]
            self.young |= new
            if len(self.young) > self.memo:
                self.old, self.young = self.young, {}
        return b"".join(found)

    def encode_all(self, texts: list[str], end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts, each with ``end`` after it, and where each text's begin and the last one's end.

        Each different word of all texts is looked up once. Line breaks and stops are words of their own here, with a mark that
        no blank was before them: a blank and a line break or tab, which do not stand together in a text that is cut into words.
        """
        heads: list[str | bytes] = []
        tails: list[str | None] = []
        for text in texts:
            if _BLANK_PAIR.search(text) or any(t in text for t in self.added):
                heads.append(self.whole(text))
                tails.append(None)
            else:
                head, blank, tail = _STOP.sub(r" \t\1", _LINE.sub(" \n", text)).partition(" ")
                heads.append(head)  # the first word has no blank before it
                tails.append(tail if blank else None)
        first = iter(self.tokenizer.encode_batch_fast([h for h in heads if isinstance(h, str)], add_special_tokens=False))
        heads = [_bytes(next(first).ids) if isinstance(h, str) else h for h in heads]
        lists = pc.split_pattern(pa.array(tails, pa.large_string()), " ")
        coded = lists.values.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.young.get, words))
        if missing := [w for w, ids in zip(words, found) if ids is None]:
            new = self._marked([w for w in missing if w[:1] in _MARKS])
            plain = [w for w in missing if w[:1] not in _MARKS]
            for k in range(0, len(plain), _FRESH):
                new |= self._words(plain[k : k + _FRESH])
            found = [new[w] if ids is None else ids for w, ids in zip(words, found)]
            self.young |= new
            if len(self.young) > self.memo:
                self.old, self.young = self.young, {}
        # each text: its head, its words, the end
        ends, n = lists.offsets.to_numpy(), len(texts)
        own = np.arange(len(words), len(words) + n, dtype=np.int32)
        codes = np.insert(coded.indices.to_numpy(), np.repeat(ends, 2)[1:-1], np.stack([own, np.full(n, len(words) + n, np.int32)], 1).ravel())
        found += [*heads, end]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        places = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        ids = pa.ListArray.from_arrays(places, np.frombuffer(b"".join(found), "<u4")).take(pa.array(codes))
        return ids.values.to_numpy(), ids.offsets.to_numpy()[ends + 2 * np.arange(n + 1)].astype(np.int64)

    def _words(self, words: Iterable[str]) -> dict[str, bytes]:
        """The ids of words with a blank before each: from the old generation, or a known core and its end, or fresh."""
        out, pending, old, young, ends = {}, [], self.old.get, self.young.get, self.ends.get
        for w in words:
            ids = old(w)
            if ids is None:
                end = ends(w[-1:])
                if end is not None and w[-2:-1].isalpha():
                    core = w[:-1]
                    ids = young(core) or old(core)
                    if ids is None:
                        pending.append((w, core, end))
                        continue
                    ids += end
                else:
                    pending.append((w, w, b""))
                    continue
            out[w] = ids
        if pending:
            fresh = list({core for _, core, _ in pending})
            got = dict(zip(fresh, self._fresh(fresh)))
            out.update(got)
            for w, core, end in pending:
                out[w] = got[core] + end
        return out

    def _marked(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words of ``encode_all`` that have no blank before them."""
        old = self.old.get
        out = {w: self.ends[w[1:]] if w[0] == "\t" else old(w) for w in words}
        lines = [w for w, ids in out.items() if ids is None]
        for k in range(0, len(lines), _FRESH):
            some = lines[k : k + _FRESH]
            out.update(zip(some, self._fresh([w[1:] for w in some], "\n")))
        return out

    def _fresh(self, words: list[str], lead: str = " ") -> list[bytes]:
        """The ids of words with a blank (or line break) before each, encoded as one text: a token with that in front begins a word."""
        if all(words):
            (one,) = self.tokenizer.encode_batch_fast([lead + lead.join(words)], add_special_tokens=False)
            ids = np.array(one.ids, "<u4")
            begins = np.flatnonzero(self.begins[lead][ids]).tolist()
            if len(begins) == len(words):
                data = ids.tobytes()
                return [data[4 * a : 4 * b] for a, b in zip(begins, [*begins[1:], len(ids)])]
        return [_bytes(e.ids) for e in self.tokenizer.encode_batch_fast([f"{lead}{w}" for w in words], add_special_tokens=False)]


def _bytes(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder != "little":
        packed.byteswap()
    return packed.tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str, memo: int = 700_000) -> Encoder:
    """The worker's encoder of a file; one that was made with another memo takes this one's bound from now on."""
    make_room("packing")
    if path not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = Encoder(path)
        hold("packing", _encoders.clear)
    _encoders[path].memo = memo
    return _encoders[path]


class Windows:
    """A bounded set of open windows; ``place`` returns the windows that it closes."""

    def __init__(self, length: int, most: int) -> None:
        self.length, self.most = length, most
        self.open: list[tuple[int, list]] = []  # (tokens used, pieces)

    def place(self, piece: tuple, cut) -> list[list]:
        closed = []
        while True:
            n = piece[2]
            fits = [(self.length - used - n, i) for i, (used, _) in enumerate(self.open) if used + n <= self.length]
            if fits:
                left, i = min(fits)
                used, pieces = self.open[i]
                pieces.append((*piece, used))
                if left:
                    self.open[i] = (used + n, pieces)
                else:
                    closed.append(self.open.pop(i)[1])
                return closed
            if len(self.open) < self.most:
                self.open.append((0, []))
                continue
            used, pieces = self.open.pop(max(range(len(self.open)), key=lambda i: self.open[i][0]))
            head, piece = cut(piece, self.length - used)
            pieces.append((*head, used))
            closed.append(pieces)


def _pieces(path: str, length: int, eos: int, windows: int, by: str | None, most_values: int):
    end = np.asarray([eos], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(path), TaskContext.get().partitionId()
        states: dict[str | None, Windows] = {}  # the value used last is the last one
        number = part << _LOCAL_BITS
        rows: list[tuple] = []

        def emit(pieces: list[tuple], still_open: bool, value: str | None) -> None:
            nonlocal number
            rows.extend((*p[:5], number, p[5], still_open, value) for p in pieces)
            number += 1

        for batch in batches:
            values = batch.column(2).to_pylist() if by else [None] * batch.num_rows
            for doc, text, value in zip(batch.column(0).to_pylist(), batch.column(1), values):
                states[value] = state = states.pop(value, None) or Windows(length, windows)
                if len(states) > most_values:
                    oldest = next(iter(states))
                    for _, pieces in states.pop(oldest).open:
                        emit(pieces, True, oldest)
                ids = enc.encode(text.as_py() or "") + end
                total = len(ids) // 4
                crc = lambda a, n: zlib.crc32(ids[4 * a : 4 * (a + n)])  # noqa: B023, E731
                full = total // length
                for k in range(full):
                    emit([(doc, k * length, length, crc(k * length, length), total, 0)], False, value)
                if rest := total - full * length:
                    # only the document in hand is ever cut: its bytes are still here
                    cut = lambda p, n: ((doc, p[1], n, crc(p[1], n), total), (doc, p[1] + n, p[2] - n, crc(p[1] + n, p[2] - n), total))  # noqa: B023, E731
                    for pieces in state.place((doc, full * length, rest, crc(full * length, rest), total), cut):
                        emit(pieces, False, value)
            yield _batch(rows, part, by)
            rows.clear()
        for value, state in states.items():
            for _, pieces in state.open:
                emit(pieces, True, value)
        yield _batch(rows, part, by)

    return run


def _batch(rows: list[tuple], part: int, by: str | None) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 9
    kinds = [pa.int64()] * 7 + [pa.bool_(), pa.string()]
    arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "still_open", "value", "part"]
    own = [*range(8), *([8] if by else [])]
    return pa.RecordBatch.from_arrays([*(arrays[i] for i in own), pa.array([part] * len(rows), pa.int64())], names=[*(names[i] for i in own), "part"])


def merge_leftovers(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best fit by falling length: the window number and the offset of each piece."""
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces = windows = 0  # bit s of spaces: a window with s tokens of space is there
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if above := spaces >> n:
            space = n + (above & -above).bit_length() - 1
            w = by_space[space].pop()
            if not by_space[space]:
                spaces &= ~(1 << space)
        else:
            w, space, windows = windows, capacity, windows + 1
        number[i], offset[i] = w, capacity - space
        by_space[space - n].append(w)
        if space > n:
            spaces |= 1 << (space - n)
    return number, offset


def _merge(length: int, by: str | None):
    own = ["value"] if by else []

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([*((v, "ascending") for v in own), ("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("part", "ascending")])
        lengths, ends = group["length"].to_numpy(), [len(group)]
        if by:
            ends = np.cumsum([len(list(run)) for _, run in groupby(group["value"].to_pylist())]).tolist()
        number, offset, begin, used = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64), 0, 0
        for end in ends:
            windows, offset[begin:end] = merge_leftovers(lengths[begin:end], length)
            number[begin:end] = used + windows
            begin, used = end, used + int(windows.max()) + 1
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        ids = _MERGED | (np.int64(key[0].as_py()) << _LOCAL_BITS) | number
        return pa.table([*(group[n] for n in names), pa.array(ids, pa.int64()), pa.array(offset, pa.int64()), *(group[v] for v in own)], names=[*names, "sequence_id", "offset", *own])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0, open_windows: int = 32, group_pieces: int = 50_000, id_col: str = "doc_id", text_col: str = "text", by: str | None = None, most_values: int = 256) -> DataFrame:
    """One row per piece. ``tokenizer``: path of the tokenizer file, there on every machine. ``by``: a column, of whose values a sequence holds one only; it comes along, as a string.

    The pieces (a few numbers each, no text) are written to the shared folder before the leftovers are
    merged, so that a repeated task cannot pack in another order. ``group_pieces`` bounds how many
    leftover pieces one task merges; with more, there are more groups.
    """
    own = ["value"] if by else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(by).cast("string").alias(v) for v in own))
    typed = "".join(f", {v} string" for v in own)
    packed = materialize(rows.mapInArrow(_pieces(tokenizer, length, end_id, open_windows, by, most_values), f"{PIECE_SCHEMA}, still_open boolean{typed}, part long"), "packing")
    left = packed.where("still_open")
    groups = -(-left.count() // group_pieces) or 1
    # with many values a partition may leave any number of windows, so that these are dealt one by one
    dealt = F.xxhash64("sequence_id") if by else F.col("part")
    merged = left.withColumn("g", F.pmod(dealt, F.lit(groups))).groupBy("g").applyInArrow(_merge(length, by), PIECE_SCHEMA + typed)
    return packed.where("NOT still_open").drop("still_open", "part").unionByName(merged).withColumnsRenamed({v: by for v in own})
