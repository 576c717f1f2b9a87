"""Language identification with a byte convolutional network, trained in numpy on labelled texts.

A text is cut into fixed-length byte windows, all of it. Filters of several widths slide over a window's
bytes, each filter keeps its largest response, and a softmax layer turns those into languages; a text's
answer is the mean over its windows of the log probabilities.

The fit sees a bounded sample (``sample`` windows aimed at, twice that at most) of labelled rows outside the held-out fold; the text is
the only input. Every text is predicted whole.

Defined results: a null text or one without a letter is ``und`` with score 0; if no labelled row is
there to learn from, so is every text; of languages with equal probabilities the first by name is the answer;
repeated rows are predicted alike, also where they share an id; an empty table gives an empty one; further
columns are ignored, and those of ``keep`` come along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstrata.llm.workers import make_room

UNKNOWN = "und"
WIDTHS = (2, 3, 4)
_LIKELY = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """A letter of any script; superscript digits, fractions and Roman numerals are none."""
    return any(m[0].isalpha() for m in _LIKELY.finditer(text))


@dataclass
class ByteNet:
    """filters[w]: (w, 256, n) weights by offset and byte; top: (3n + 1, languages)."""

    languages: list[str]
    window: int
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    top: np.ndarray

    @classmethod
    def fit(cls, texts: list[bytes], labels: list[str], window: int = 256, filters: int = 16, epochs: int = 5, batch: int = 64, rate: float = 0.01, seed: int = 0) -> ByteNet:
        languages = sorted(set(labels))
        r = np.random.default_rng(seed)
        x = np.stack([cut_windows(t, window)[0] for t in texts])
        y = np.array([languages.index(v) for v in labels])
        weight = (len(y) / len(languages) / np.bincount(y, minlength=len(languages)))[y]
        net = cls(languages, window, {w: r.normal(0, 0.1, (w, 256, filters)).astype(np.float32) for w in WIDTHS}, {w: np.zeros(filters, np.float32) for w in WIDTHS}, r.normal(0, 0.1, (len(WIDTHS) * filters + 1, len(languages))).astype(np.float32))
        params = [*net.filters.values(), *net.bias.values(), net.top]
        mean, square, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            for rows in np.array_split(r.permutation(len(x)), max(1, len(x) // batch)):
                step += 1
                for p, g, m, s in zip(params, net._gradients(x[rows], y[rows], weight[rows]), mean, square):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        return net

    def _pooled(self, x: np.ndarray, where: bool = False):
        """The largest response of each filter in each window and, with ``where``, its position."""
        out, at = [], []
        for w, f in self.filters.items():
            n = x.shape[1] - w + 1
            sums = f[0][x[:, :n]]
            for o in range(1, w):
                sums += f[o][x[:, o : o + n]]
            out.append(sums.max(axis=1) + self.bias[w])
            if where:
                at.append(sums.argmax(axis=1))
        return np.maximum(np.concatenate(out, axis=1), 0), at

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self._pooled(x)[0] @ self.top[:-1] + self.top[-1]
        z = z - z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def _gradients(self, x, y, weight):
        pooled, at = self._pooled(x, where=True)
        z = pooled @ self.top[:-1] + self.top[-1]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        d = (p * (weight / len(y))[:, None]).astype(np.float32)
        top = np.vstack([pooled.T @ d, d.sum(axis=0, keepdims=True)])
        back = (d @ self.top[:-1].T) * (pooled > 0)
        grads, bias, n = [], [], self.bias[WIDTHS[0]].size
        for i, (w, f) in enumerate(self.filters.items()):
            own, g = back[:, i * n : (i + 1) * n], np.zeros_like(f)
            for o in range(w):
                np.add.at(g[o], (np.take_along_axis(x, at[i] + o, axis=1), np.arange(n)[None]), own)
            grads.append(g), bias.append(own.sum(axis=0))
        return [*grads, *bias, top]


def cut_windows(data: bytes, window: int) -> np.ndarray:
    """All bytes in rows of ``window``; the last row is filled up with byte 0."""
    rows = max(1, -(-len(data) // window))
    return np.frombuffer(data.ljust(rows * window, b"\0"), np.uint8).reshape(rows, window)


def _predict(net: ByteNet | None, kept: int = 0, most_rows: int = 512):
    def answers(parts: list[np.ndarray]) -> tuple[list[str], list[float]]:
        x = np.concatenate(parts)
        logs = np.concatenate([net.log_probabilities(x[a : a + most_rows]) for a in range(0, len(x), most_rows)])
        begin = np.cumsum([0, *(len(p) for p in parts[:-1])])
        mean = np.add.reduceat(logs.astype(np.float64), begin) / np.array([len(p) for p in parts])[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return [net.languages[i] for i in p.argmax(axis=1)], p.max(axis=1).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("language")
        for batch in batches:
            pred, score = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            waiting, parts, held = [], [], 0

            def settle() -> None:
                for i, name, value in zip(waiting, *answers(parts)):
                    pred[i], score[i] = name, value  # noqa: B023

            # texts in groups of a bounded number of windows (or one long text), so that no batch is held twice
            for i, value in enumerate(batch.column("text")):
                text = value.as_py()
                if text and net is not None and has_letter(text):
                    waiting.append(i)
                    parts.append(cut_windows(text.encode("utf-8", "surrogatepass"), net.window))
                    held += len(parts[-1])
                    if held >= 4 * most_rows:
                        settle()
                        waiting, parts, held = [], [], 0
            if parts:
                settle()
            along = range(2, 2 + kept)
            names = ["doc_id", "held_out", "lang_pred", "score", *(batch.schema.names[i] for i in along)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64()), *(batch.column(i) for i in along)], names=names)

    return run


def learn(docs: DataFrame, sample: int = 4_000, window: int = 256, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteNet | None:
    """Fit on one window of each sampled labelled row; None if there is none."""
    text, lang = F.col(text_col), F.col(lang_col)
    labelled = docs.where(text.isNotNull() & lang.isNotNull() & ~_held_out(id_col))
    n = labelled.select(id_col).count()
    # by id and text, so that rows which share an id are not all chosen or all left out
    turn = F.pmod(F.xxhash64(F.lit(5), F.col(id_col), text), F.lit(max(1, -(-n // sample))))
    start = 1 + F.pmod(F.xxhash64(F.lit(6), F.col(id_col)), F.greatest(F.length(text) - window, F.lit(0)) + 1)
    parts = labelled.where(turn == 0).select(F.col(id_col).cast("long").alias("i"), lang.cast("string").alias("lang"), text.substr(start.cast("int"), F.lit(window)).alias("part"))
    # should more be chosen than twice the sample, the first by a hash are taken, the same in any run
    got = parts.withColumn("h", F.xxhash64(F.lit(7), "i", "part", "lang")).orderBy("h", "i", "part", "lang").limit(2 * sample).toArrow().sort_by([("i", "ascending"), ("part", "ascending"), ("lang", "ascending")])
    rows = [(p.encode("utf-8", "surrogatepass")[:window], v) for p, v in zip(got["part"].to_pylist(), got["lang"].to_pylist()) if has_letter(p)]
    return ByteNet.fit([t for t, _ in rows], [v for _, v in rows], window) if rows else None


def _held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def identify_languages(docs: DataFrame, sample: int = 4_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and the columns ``keep`` of the same row, as kept_<name>."""
    return predict_languages(docs, learn(docs, sample, id_col=id_col, text_col=text_col, lang_col=lang_col), id_col, text_col, keep)


def predict_languages(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The answers of a network that ``learn`` gave, in the form of ``identify_languages``."""
    kept = [F.col(c).alias(f"kept_{c}") for c in keep]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(_held_out(id_col), F.lit(False)).alias("held_out"), *kept, F.col(text_col).cast("string").alias("text"))
    schema = T._parse_datatype_string("doc_id long, held_out boolean, lang_pred string, score double")
    schema = T.StructType([*schema, *(T.StructField(f"kept_{c}", docs.schema[c].dataType) for c in keep)])
    return rows.mapInArrow(_predict(net, len(keep)), schema)
