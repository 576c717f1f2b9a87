"""SentencePiece segmentations, sampled without replacement by Gumbel top-k over the lattice.

The pieces of a model that occur in a text span a lattice; a path through it is a segmentation. A
piece's weight falls with its rank in the vocabulary (a power law, ``alpha``); sums over the rest of the
text, from the end backwards, make the step probabilities, so that a whole path's probabilities
multiply to its share. Each lattice state on the search frontier carries the largest Gumbel-perturbed
log probability of any path through it: the bound of an A* search that is exact, so the frontier
gives whole paths in falling order. The first k are a sample without replacement; the next bound is the threshold
for the inclusion score of each. Draws are seeded by the row key.

Characters without a piece are spelt in byte pieces. Lattice parts of frequent words are kept in a memo
of bounded size.

Defined results: a null text counts as empty; the empty text has one segmentation, of no pieces, with
probability and inclusion 1; a text with fewer than k segmentations gives all of them, each with inclusion 1; rows with
equal keys and texts get equal samples; a null key is a key like any other; texts of any length are read whole; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import random
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.workers import hold, make_room

BLANK = "▁"
_UNITS = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")


class Lattice:
    """``unit(text)``: for each position the steps (next position, ids, log probability given the position)."""

    def __init__(self, path: str, alpha: float = 1.0, memo: int = 80_000) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.weight: dict[str, tuple[int, float]] = {}
        size = self.model.vocab_size()
        self.bytes: dict[int, int] = {}
        normal = [i for i in range(size) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i) or self.model.is_byte(i))]
        for rank, i in enumerate(normal):
            self.weight[self.model.id_to_piece(i)] = (i, -alpha * math.log(rank + 2))
        self.spelt = -alpha * math.log(size + 2)
        for i in range(size):
            if self.model.is_byte(i):
                self.bytes[int(self.model.id_to_piece(i)[3:5], 16)] = i
        self.longest = max(map(len, self.weight), default=1)
        # pieces that hold a blank after another character would cross units
        assert not any(BLANK in p.lstrip(BLANK) for p in self.weight)
        self.units: dict[str, list] = {}
        self.memo = memo

    def unit(self, text: str) -> list[list[tuple[int, tuple[int, ...], float]]]:
        found = self.units.get(text)
        if found is None:
            found = self._unit(text)
            if len(self.units) >= self.memo:
                self.units.clear()
            if len(text) <= 64:
                self.units[text] = found
        return found

    def _unit(self, text: str):
        n = len(text)
        below, out = [0.0] * (n + 1), [[] for _ in range(n)]
        for i in range(n - 1, -1, -1):
            steps = []
            for j in range(i + 1, min(n, i + self.longest) + 1):
                if (hit := self.weight.get(text[i:j])) is not None:
                    steps.append((j, (hit[0],), hit[1] + below[j]))
            if not steps or steps[0][0] != i + 1:
                data = text[i].encode("utf-8", "surrogatepass")
                steps.append((i + 1, tuple(self.bytes[b] for b in data), self.spelt * len(data) + below[i + 1]))
            top = max(s[2] for s in steps)
            below[i] = top + math.log(sum(math.exp(s[2] - top) for s in steps))
            out[i] = [(j, ids, w - below[i]) for j, ids, w in steps]
        return out

    def sample(self, text: str, k: int, seed: int) -> list[tuple[list[int], float, float]]:
        """Up to k distinct (ids, log probability, inclusion), in falling order of their perturbed values."""
        if not text:
            return [([], 0.0, 1.0)]
        units = [self.unit(u) for u in _UNITS.findall(BLANK + text.replace(" ", BLANK))]
        draw, log = random.Random(seed).random, math.log
        # states by rising bound: (bound, number, log probability, unit, position, path)
        frontier = [(-log(-log(draw() or 1e-300)), 0, 0.0, 0, 0, None)]
        number, found = 0, []
        while frontier and len(found) < k:
            bound, _, phi, u, at, path = frontier.pop()
            room = k - len(found)  # every state holds a path as good as its bound: others than the best ones are never reached
            cut = frontier[0][0] if len(frontier) >= room else -math.inf
            while u < len(units):
                steps = units[u][at]
                if len(steps) == 1:
                    j, ids, w = steps[0]
                else:
                    perturbed = [phi + w - log(-log(draw() or 1e-300)) for _, _, w in steps]
                    most = max(perturbed)
                    lead = perturbed.index(most)
                    least = -math.inf if cut == -math.inf else bound - _logaddexp(_logexpm1(bound - cut), bound - most)
                    for i, p in enumerate(perturbed):
                        if p > least and i != lead:
                            # the draw, given that the largest of the siblings is the bound
                            v = bound - p + _log1mexp(p - most)
                            value = bound - max(0.0, v) - math.log1p(math.exp(-abs(v)))
                            j, ids, w = steps[i]
                            number -= 1
                            nu, nj = (u + 1, 0) if j == len(units[u]) else (u, j)
                            bisect.insort(frontier, (value, number, phi + w, nu, nj, (path, ids)))
                            if len(frontier) > room:
                                del frontier[0]
                            cut = frontier[0][0] if len(frontier) == room else -math.inf
                    j, ids, w = steps[lead]
                phi, path = phi + w, (path, ids)
                u, at = (u + 1, 0) if j == len(units[u]) else (u, j)
            parts = []
            while path is not None:
                path, ids = path
                parts.append(ids)
            found.append(([i for ids in reversed(parts) for i in ids], phi))
        threshold = frontier[-1][0] if frontier else -math.inf
        return [(ids, phi, -math.expm1(-math.exp(min(700.0, phi - threshold))) if frontier else 1.0) for ids, phi in found]

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


def _log1mexp(x: float) -> float:
    """log(1 - exp(x)) for x <= 0."""
    if x >= 0:
        return -math.inf
    return math.log(-math.expm1(x)) if x > -0.693 else math.log1p(-math.exp(x))


def _logexpm1(x: float) -> float:
    """log(exp(x) - 1) for x >= 0."""
    return -math.inf if x <= 0 else x if x > 40 else math.log(math.expm1(x))


def _logaddexp(a: float, b: float) -> float:
    a, b = max(a, b), min(a, b)
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


_lattices: dict[tuple, Lattice] = {}


def lattice(path: str, alpha: float) -> Lattice:
    make_room("sampling")
    if (path, alpha) not in _lattices:
        _lattices[path, alpha] = Lattice(path, alpha)
        hold("sampling", _lattices.clear)
    return _lattices[path, alpha]


def sample_segmentations(rows: DataFrame, keys: list[str], model: str, k: int = 4, alpha: float = 1.0, text_col: str = "text", seed: int = 0) -> DataFrame:
    """keys, sample (from 1), ids, log_prob, inclusion. keys: long columns; ``model``: a file there on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model, alpha)
        for batch in batches:
            at, numbers, ids, logs, shares = [], [], [], [], []
            columns = [batch.column(f"key_{i}").to_pylist() for i in range(len(keys))]
            for i, text in enumerate(batch.column("text")):
                key = zlib.crc32(repr((seed, *(c[i] for c in columns))).encode())
                for number, (path, phi, share) in enumerate(lat.sample(text.as_py() or "", k, key), 1):
                    at.append(i), numbers.append(number), ids.append(path), logs.append(phi), shares.append(share)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(f"key_{i}").take(take) for i in range(len(keys))), pa.array(numbers, pa.int32()), pa.array(ids, pa.list_(pa.int32())), pa.array(logs, pa.float64()), pa.array(shares, pa.float64())], names=[*keys, "sample", "ids", "log_prob", "inclusion"])

    named = rows.select(*(F.col(c).cast("long").alias(f"key_{i}") for i, c in enumerate(keys)), F.col(text_col).alias("text"))
    return named.mapInArrow(run, ", ".join(f"`{c}` long" for c in keys) + ", sample int, ids array<int>, log_prob double, inclusion double")


def decode_ids(samples: DataFrame, model: str, alpha: float = 1.0) -> DataFrame:
    """The columns of ``samples`` and ``decoded``, the text that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model, alpha)
        for batch in batches:
            texts = [lat.decode(v.as_py()) if v.is_valid and len(v) else "" for v in batch.column("ids")]
            yield batch.append_column("decoded", pa.array(texts, pa.string()))

    from pyspark.sql import types as T

    return samples.mapInArrow(run, T.StructType([*samples.schema, T.StructField("decoded", T.StringType())]))
